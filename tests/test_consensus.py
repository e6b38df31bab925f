"""Known answers for cells, tiers, votes, medians and pools."""

import pytest
from pyspark.sql import functions as F

from quorana.operators import consensus as C


@pytest.fixture(scope="module")
def rows(spark):
    said = [("alpha", 0, "rates"), ("alpha", 1, "rates"), ("alpha", 2, "rates"), ("alpha", 2, "rates"), ("alpha", 3, "risk"), ("beta", 0, "rates"), ("beta", 1, "rates"), ("gamma", 0, "equity")]
    totals = spark.createDataFrame([("alpha", 4), ("beta", 4), ("gamma", 3), ("delta", 4)], "rater string, k long")
    return C.cells(spark.createDataFrame(said, "rater string, sample int, key string"), totals)


def test_cells_count_a_sample_once_and_fill_with_zero(rows):
    got = {(r.key, r.rater): r.cell for r in rows.collect()}
    assert got["rates", "alpha"] == 0.75 and got["rates", "beta"] == 0.5 and got["rates", "delta"] == 0.0
    assert got["risk", "alpha"] == 0.25 and got["equity", "gamma"] == 0.333333 and len(got) == 12


def test_matrix_tiers(rows):
    got = {r.key: (r.model_support, r.tier) for r in C.matrix(rows, None).collect()}
    assert got == {"rates": (2, "MODERATE"), "risk": (0, "WEAK"), "equity": (0, "WEAK")}


@pytest.mark.parametrize(("n", "want"), [(4, "WWMMS"), (6, "WWWMMSS"), (5, "WWWMSS"), (1, "WS"), (0, "W")])
def test_tier_thresholds(spark, n, want):
    got = spark.range(n + 1).select("id", C.tier(F.col("id"), F.lit(n)).alias("t")).orderBy("id").collect()
    assert "".join(r.t[0] for r in got) == want


def test_scalar_vote_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("b", None), ("b", None), ("c", None), ("d", "x"), ("d", None), ("d", None)], "k string, v string")
    assert {r.k: r.v for r in C.scalar_vote(df, ["k"], "v", "multi", "v").collect()} == {"a": "x", "b": "multi", "c": "multi", "d": "x"}


def test_list_vote_needs_more_than_half_and_counts_empty_lists(spark):
    df = spark.createDataFrame([("a", ["x", "x", "y"]), ("a", ["x"]), ("a", []), ("b", ["x"]), ("b", None), ("c", [])], "k string, v array<string>")
    assert {r.k: r.o for r in C.list_vote(df, ["k"], "v", "GLOBAL", "o").collect()} == {"a": ["x"], "b": ["GLOBAL"], "c": ["GLOBAL"]}


def test_median_and_first_wins(spark):
    df = spark.createDataFrame([("a", 1.0, 3, "late"), ("a", 4.0, 1, "first"), ("a", 2.0, 2, "second"), ("a", 9.0, 9, "last")], "k string, v double, o int, t string")
    assert C.median_of(df, ["k"], "v", "m").first().m == 3.0
    assert C.first_wins(df, ["k"], ["o"]).first().t == "first" == C.first_wins_window(df, ["k"], ["o"]).first().t


def test_pivot_formats_half_even(rows):
    r = C.pivoted(rows, ["alpha", "gamma"]).where("key = 'equity'").first()
    assert (r.alpha, r.gamma) == ("0.0000", "0.3333")


def test_result_does_not_depend_on_partitions(spark, rows):
    before = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, rows.repartition(7).collect())) == before
