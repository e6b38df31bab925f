"""Every query of the reference's operators against its SQL, on the smallest tables."""

import pytest

import oracle
from quorana.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert oracle.difference(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) is None
