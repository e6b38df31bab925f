"""The overlay's public view over parts' brands and types, and replayed runs over orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorana.operators import observatory as O
from quorana.sources import providers
from quorana.tables import read


def _divisions(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("division")).distinct()


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as overlay rows of their part's division; those with a high discount paint."""
    li = read(spark, sf, "lineitem").where("l_tax > 0.02").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    status = F.when((F.col("l_returnflag") == "A") & (F.col("l_discount") > 0.08), "RATIFIED_MAPPING").when(F.col("l_returnflag") == "R", "REJECTED").otherwise("PENDING")
    return li.where("p_size % 3 <> 0").select(
        F.concat_ws("/", "p_brand", "p_type").alias("division"), F.col("l_orderkey").alias("case_id"), status.alias("mapping_status"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("row_id"),
        F.when(status == "RATIFIED_MAPPING", F.col("l_linenumber")).otherwise(0).alias("weight"),
    )


def observatory(spark: SparkSession, sf: str) -> DataFrame:
    return O.built(_divisions(spark, sf), _rows(spark, sf), "division")


def observatory_cards(spark: SparkSession, sf: str) -> DataFrame:
    return O.card(observatory(spark, sf), "division")


def observatory_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return O.fallback(_divisions(spark, sf), "division", _rows(spark, sf).where("case_id % 2 = 0"))


def stale_divisions(spark: SparkSession, sf: str) -> DataFrame:
    """Against a view that was recorded before the orders with even numbers came in."""
    return O.stale(observatory(spark, sf), O.built(_divisions(spark, sf).where("division <> 'Brand#1/PROMO'"), _rows(spark, sf).where("case_id % 97 <> 0"), "division"), "division")


def replayed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as a panel of up to eight samples, orders as the recorded responses of their customer's nation."""
    n = F.col("n_nationkey")
    panel = read(spark, sf, "nation").select(F.lit("recorded").alias("provider"), F.col("n_name").alias("model_id"), F.when(n % 3 != 0, F.concat(F.lit("V"), F.col("n_regionkey").cast("string"))).alias("vendor"), (n % 9).alias("samples"))
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf, "nation"), F.col("c_nationkey") == n)
    first = o.groupBy(F.col("n_name").alias("model_id"), (F.col("o_orderkey") % 11).cast("int").alias("sample_idx")).agg(F.max("o_orderkey").alias("k"))
    records = first.where("k % 5 <> 1").select("model_id", "sample_idx", F.when(F.col("k") % 2 == 0, "recorded vendor").alias("vendor"), F.concat(F.lit("answer "), F.col("k").cast("string")).alias("response_raw"))
    return providers.provider({"provider": "recorded"})(panel, records)


def anchor_problems(spark: SparkSession, sf: str) -> DataFrame:
    n, digest = F.col("n_nationkey"), F.sha2("n_name", 256)
    proof = providers.anchored(F.when(n % 4 == 1, F.sha2(F.lit("other"), 256)).otherwise(digest), F.lit("2024-01-01T00:00:00Z"))
    proof = F.when(n % 5 == 2, proof.withField("provider", F.lit("elsewhere"))).when(n % 7 != 3, proof)
    return providers.anchor_problems(read(spark, sf, "nation").select(F.col("n_name").alias("name"), digest.alias("digest"), proof.alias("proof")))


QUERIES = {f.__name__: f for f in (observatory, observatory_cards, observatory_fallback, stale_divisions, replayed_runs, anchor_problems)}

_ROWS = """WITH d AS (SELECT DISTINCT p_brand || '/' || p_type AS division FROM part), r AS (SELECT p_brand || '/' || p_type AS division, l_orderkey AS c, CASE WHEN l_returnflag = 'A' AND l_discount > 0.08 THEN 'RATIFIED_MAPPING' WHEN l_returnflag = 'R' THEN 'REJECTED' ELSE 'PENDING' END AS s, l_linenumber AS w
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_tax > 0.02 AND p_size % 3 <> 0)"""
_VIEW = """(SELECT d.division, count(DISTINCT c) AS n_cases, count(*) FILTER (s = 'RATIFIED_MAPPING') AS ratified_mapping, count(*) FILTER (s = 'PENDING') AS pending, count(*) FILTER (s = 'REJECTED') AS rejected,
  coalesce(sum(w) FILTER (s = 'RATIFIED_MAPPING'), 0) AS saturation, count(*) FILTER (s = 'RATIFIED_MAPPING' AND w > 0) AS painted_rows, count(*) FILTER (s = 'RATIFIED_MAPPING' AND w > 0) = 0 AS void FROM {d} d LEFT JOIN {r} r ON r.division = d.division GROUP BY d.division)"""
_NOW, _THEN = _VIEW.format(d="d", r="r"), _VIEW.format(d="(SELECT * FROM d WHERE division <> 'Brand#1/PROMO')", r="(SELECT * FROM r WHERE c % 97 <> 0)")
SQL = {
    "observatory": f"{_ROWS} SELECT * FROM {_NOW}",
    "observatory_cards": f"""{_ROWS} SELECT division, '## ' || division || chr(10) || chr(10) || n_cases || ' cases: ' || ratified_mapping || ' ratified, ' || pending || ' pending, ' || rejected || ' rejected' || chr(10) || chr(10) ||
  CASE WHEN void THEN 'Nothing paints this division.' ELSE 'Saturation ' || saturation || ' from ' || painted_rows || ' rows.' END AS card FROM {_NOW}""",
    "observatory_fallback": f"{_ROWS} SELECT d.division, count(DISTINCT c) AS n_cases, 0 AS ratified_mapping, 0 AS pending, 0 AS rejected, 0 AS saturation, 0 AS painted_rows, true AS void FROM d LEFT JOIN (SELECT * FROM r WHERE c % 2 = 0) r USING (division) GROUP BY d.division",
    "stale_divisions": f"{_ROWS} SELECT coalesce(a.division, b.division) AS division FROM {_NOW} a FULL JOIN {_THEN} b ON a.division = b.division WHERE a IS DISTINCT FROM b",
    "replayed_runs": """WITH p AS (SELECT n_name AS m, CASE WHEN n_nationkey % 3 <> 0 THEN 'V' || n_regionkey END AS v, unnest(range(0, n_nationkey % 9)) AS i FROM nation), f AS (SELECT n_name AS m, o_orderkey % 11 AS i, max(o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
r AS (SELECT m, i, CASE WHEN k % 2 = 0 THEN 'recorded vendor' END AS rv, 'answer ' || k AS raw FROM f WHERE k % 5 <> 1)
SELECT p.m AS model_id, coalesce(v, rv, 'recorded') AS vendor, 'recorded' AS provider, p.i AS sample_idx, CASE WHEN raw IS NULL THEN 'ERROR' ELSE 'OK' END AS status, raw AS response_raw, sha256(raw) AS response_sha256 FROM p LEFT JOIN r ON p.m = r.m AND p.i = r.i""",
    "anchor_problems": "SELECT 'anchor' AS gate, n_name AS subject, CASE WHEN n_nationkey % 5 = 2 THEN 'provider' ELSE 'digest' END AS problem FROM nation WHERE n_nationkey % 5 = 2 OR (n_nationkey % 7 <> 3 AND n_nationkey % 4 = 1)",
}
