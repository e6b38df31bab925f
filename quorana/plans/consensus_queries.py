"""Consensus queries over the order tables: a rater is a region, a sample a shipping month, a key a brand and type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorana.operators import consensus as C
from quorana.tables import read


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """(rater, sample, key, flag, ...): one row per line item."""
    li = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_discount", F.date_format("l_shipdate", "yyyy-MM").alias("sample")
    )
    raters = (
        read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("rater"), "n_name")
    )
    part = read(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("key"), "p_size")
    return li.join(raters, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))


BASE = """
WITH base AS (
  SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m') AS sample, r_name AS rater, n_name,
         p_brand || ' ' || p_type AS key, p_size, l_returnflag, l_linestatus, l_extendedprice, l_discount
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey),
totals AS (SELECT rater, count(DISTINCT sample) AS k FROM base GROUP BY rater),
hits AS (SELECT key, rater, count(DISTINCT sample) AS n FROM base WHERE l_returnflag = 'R' GROUP BY key, rater),
cells AS (SELECT g.key, t.rater, coalesce(h.n, 0) AS n, t.k, coalesce(round_even(h.n / t.k, 6), 0.0) AS cell
  FROM (SELECT DISTINCT key FROM hits) g CROSS JOIN totals t LEFT JOIN hits h ON h.key = g.key AND h.rater = t.rater)
"""


def long_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples(spark, sf).select("key", "rater", "sample", "l_returnflag")
    return C.cells(rows.where("l_returnflag = 'R'"), C.sample_counts(rows))


def consensus_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return C.matrix(long_cells(spark, sf), None, support_at=0.4)


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def matrix_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return C.pivoted(long_cells(spark, sf), REGIONS)


def axis_vote_scalar(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples(spark, sf).select("key", "l_returnflag", F.when((F.col("l_linenumber") % 5 != 0) & ~F.col("key").startswith("Brand#3"), F.col("l_linestatus")).alias("side"))
    flag = C.scalar_vote(rows, ["key"], "l_returnflag", "multi", "flag")
    return flag.join(C.scalar_vote(rows, ["key"], "side", "both", "side"), "key")


def axis_vote_list(spark: SparkSession, sf: str) -> DataFrame:
    lists = samples(spark, sf).groupBy("rater", "sample", "key").agg(F.collect_set("l_returnflag").alias("flags"))
    return C.list_vote(lists, ["key"], "flags", "GLOBAL", "flags").select("key", F.array_join("flags", ",").alias("flags"))


def seat_pool_median(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples(spark, sf).withColumn("seat", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    pool = rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("functions"), F.countDistinct("p_size").alias("tasks"))
    return C.median_of(rows, ["key"], "seat", "seat_median").join(C.median_of(rows, ["key"], "l_extendedprice", "price_median"), "key").join(pool, "key")


def first_wins_pool(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples(spark, sf).select("key", "p_size", "rater", "sample", "l_orderkey", "l_linenumber", "n_name")
    return C.first_wins(rows, ["key", "p_size"], ["rater", "sample", "l_orderkey", "l_linenumber"])


def first_wins_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples(spark, sf).select("key", "p_size", "rater", "sample", "l_orderkey", "l_linenumber", "n_name")
    return C.first_wins_window(rows, ["key", "p_size"], ["rater", "sample", "l_orderkey", "l_linenumber"])


def eligible_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of all raters, votes of those that are not excluded."""
    found = long_cells(spark, sf)
    excluded = spark.createDataFrame([("ASIA",)], "rater string")
    kept = found.join(F.broadcast(excluded), "rater", "left_anti")
    return C.matrix(kept, None, support_at=0.4)


def panel_diversity(spark: SparkSession, sf: str) -> DataFrame:
    """Vendors with enough valid samples: a supplier nation is a vendor, a month valid if it returned nothing."""
    rows = samples(spark, sf)
    months = rows.groupBy("n_name", "rater", "sample").agg(F.bool_or(F.col("l_returnflag") == "R").alias("bad"))
    per = months.groupBy("n_name", "rater").agg(F.count("*").alias("k"), F.count_if(~F.col("bad")).alias("valid"))
    return per.groupBy("rater").agg(F.count("*").alias("vendors"), F.countDistinct(F.when(F.col("valid") >= 3, F.col("n_name"))).alias("eligible")).withColumn("passed", F.col("eligible") >= 4)


QUERIES = {
    "consensus_matrix": consensus_matrix, "matrix_long_cells": long_cells, "matrix_pivot": matrix_pivot, "axis_vote_scalar": axis_vote_scalar, "axis_vote_list": axis_vote_list, "seat_pool_median": seat_pool_median,
    "first_wins_pool": first_wins_pool, "first_wins_window": first_wins_window, "eligible_policy": eligible_policy, "panel_diversity": panel_diversity,
}
TIERS = """SELECT key, count(*) FILTER (cell >= 0.4) AS model_support,
  CASE WHEN count(*) FILTER (cell >= 0.4) >= ceil(0.8 * count(*)) THEN 'STRONG'
       WHEN count(*) FILTER (cell >= 0.4) >= ceil(0.5 * count(*)) THEN 'MODERATE' ELSE 'WEAK' END AS tier
FROM cells {where} GROUP BY key"""
VOTE = """SELECT key, CASE WHEN count(v) = 1 THEN min(v) ELSE '{tie}' END AS {out} FROM
  (SELECT key, v, rank() OVER (PARTITION BY key ORDER BY n DESC) AS r FROM (SELECT key, {value} AS v, count({value}) AS n FROM base GROUP BY ALL)) WHERE r = 1 GROUP BY key"""
FIRST = """SELECT key, p_size, rater, sample, l_orderkey, l_linenumber, n_name FROM (SELECT *, row_number() OVER (PARTITION BY key, p_size ORDER BY rater, sample, l_orderkey, l_linenumber) AS rn FROM base) WHERE rn = 1"""
SQL = {
    "matrix_long_cells": BASE + "SELECT key, rater, n, k, cell FROM cells",
    "consensus_matrix": BASE + TIERS.format(where=""),
    "matrix_pivot": BASE + "SELECT key, " + ", ".join(f"max(printf('%.4f', round_even(cell, 4))) FILTER (rater = '{r}') AS \"{r}\"" for r in REGIONS) + " FROM cells GROUP BY key",
    "axis_vote_scalar": BASE + "SELECT * FROM (" + VOTE.format(tie="multi", out="flag", value="l_returnflag") + ") JOIN (" + VOTE.format(tie="both", out="side", value="CASE WHEN l_linenumber % 5 <> 0 AND key NOT LIKE 'Brand#3%' THEN l_linestatus END") + ") USING (key)",
    "axis_vote_list": BASE + """, lists AS (SELECT DISTINCT rater, sample, key FROM base), held AS (SELECT key, l_returnflag AS f, count(*) AS n FROM (SELECT DISTINCT rater, sample, key, l_returnflag FROM base) GROUP BY ALL)
SELECT l.key, coalesce(string_agg(f, ',' ORDER BY f), 'GLOBAL') AS flags FROM (SELECT key, count(*) AS n FROM lists GROUP BY key) l LEFT JOIN held h ON h.key = l.key AND h.n * 2 > l.n GROUP BY l.key""",
    "seat_pool_median": BASE + "SELECT key, median(l_extendedprice * (1 - l_discount)) AS seat_median, median(l_extendedprice) AS price_median, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS functions, count(DISTINCT p_size) AS tasks FROM base GROUP BY key",
    "first_wins_pool": BASE + FIRST, "first_wins_window": BASE + FIRST,
    "eligible_policy": BASE + TIERS.format(where="WHERE rater <> 'ASIA'"),
    "panel_diversity": BASE + """, m AS (SELECT n_name, rater, sample, bool_or(l_returnflag = 'R') AS bad FROM base GROUP BY ALL), p AS (SELECT n_name, rater, count(*) FILTER (NOT bad) AS valid FROM m GROUP BY ALL)
SELECT rater, count(*) AS vendors, count(DISTINCT n_name) FILTER (valid >= 3) AS eligible, count(DISTINCT n_name) FILTER (valid >= 3) >= 4 AS passed FROM p GROUP BY rater""",
}
