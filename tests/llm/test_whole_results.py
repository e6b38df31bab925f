"""The queries of the training-data operators against their SQL, over whole tables."""

import pytest

import oracle
from quorana.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert oracle.difference(queries.queries()[name](spark, SF), oracle.connection(SF), queries.oracle_sql()[name]) is None
