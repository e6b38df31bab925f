"""Joins whose smaller side would not fit the driver are not broadcast, whatever Spark takes the files for."""

import pytest

from quorana import workdir
from quorana.llm import line_dedup, near_dedup
from quorana.workdir import Scratch


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("rows", "limits", "joins"), [(1000, (100, 1 << 20), "SortMergeJoin"), (1000, (10000, 900), "SortMergeJoin"), (1000, (10000, 1 << 20), "BroadcastHashJoin")])
def test_large_tables_are_not_broadcast(spark, monkeypatch, rows, limits, joins):
    monkeypatch.setattr(workdir, "MOST_ROWS", limits[0])
    monkeypatch.setattr(workdir, "MOST_BYTES", limits[1])
    table = Scratch(spark, "test").joinable(spark.range(rows).selectExpr("id", "array(id, id + 1) AS a", "struct(id, id AS k) AS s", "string(id) AS t"), "table")
    joined = spark.range(5000).join(table.select("id", "t"), "id", "left")
    assert joins in planned(joined) and joined.where("t IS NOT NULL").count() == rows


def test_rows_that_are_dealt_to_many_places_are_not_broadcast(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('one two three four five six ', id % 8) AS text")
    got = near_dedup.near_duplicates(docs)
    assert "BroadcastHashJoin" not in planned(got) and sum(r.kept for r in got.collect()) == 8


def test_stage_of_the_pipeline_broadcasts_no_table_beyond_the_limit(spark, monkeypatch):
    """Neither what is dropped nor the rows of classes; every text is there 4 times."""
    monkeypatch.setattr(workdir, "MOST_ROWS", 20)
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('one two three four five six ', id % 10) AS text")
    got = near_dedup.near_dedup(docs)
    assert "BroadcastHashJoin" not in planned(got) and sorted(r.doc_id for r in got.collect()) == list(range(10))


def test_neighbourhoods_are_not_broadcast(spark):
    """Of the joins for candidates, the one with the few shared keys may be a broadcast; the one between neighbourhoods never is."""
    written = {}
    with pytest.MonkeyPatch.context() as patch:
        counted = Scratch.counted
        patch.setattr(Scratch, "counted", lambda self, df, name, **m: (written.setdefault(name, planned(df)), counted(self, df, name, **m))[1])
        docs = spark.range(30).selectExpr("id AS doc_id", "concat('a line of some words that is number ', repeat('x', int(id % 3)), id % 5) AS text")
        rows = line_dedup.line_report(docs).collect()
    plan = written["candidates"].split("== Initial Plan ==")[0]
    assert len(rows) == 30 and "SortMergeJoin" in plan and plan.count("BroadcastExchange") == 1
