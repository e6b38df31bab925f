"""Token, list and ordering queries over customers, orders, parts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorana.operators import catalogue, redaction
from quorana.sources import sinks
from quorana.tables import read


def made_tokens(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    kind = F.when(k == 0, "DATE").when(k == 1, "AMOUNT_EXACT").otherwise("PERSON")
    said = F.when(k == 0, F.date_format("o_orderdate", "d MMM yyyy")).when(k == 1, F.concat(F.lit("EUR "), F.floor("o_totalprice").cast("string"))).otherwise("Ann")
    return read(spark, sf, "orders").select("o_orderkey", redaction.make_token(kind, said, F.lit("ABCDEFGHIJ")).alias("token"))


def listed_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Nation names in odd spellings against lists of nations and regions."""
    nations = read(spark, sf, "nation")
    lists = nations.select(F.when(F.col("n_nationkey") % 2 == 0, "CLIENT").otherwise("LOCATION").alias("list"), F.col("n_name").alias("term"))
    lists = lists.unionByName(nations.where("n_nationkey % 3 = 0").select(F.lit("COUNTERPARTY").alias("list"), F.col("n_name").alias("term"))).unionByName(nations.where("n_nationkey % 5 = 0").select(F.lit("ALLOW").alias("list"), F.col("n_name").alias("term")))
    terms = nations.select("n_nationkey", F.concat(F.lit(" ("), F.lower("n_name"), F.lit("), ")).alias("t")).unionByName(nations.select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.concat("n_name", F.lit(" bank")).alias("t")))
    return redaction.listed_class(terms, lists, "t").select("n_nationkey", "class", "allowed")


def refused_spans(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    spans = e.select("user_id", "event_id", F.floor(F.col("value") * 100).cast("long").alias("start"), (F.floor(F.col("value") * 100) + 150).cast("long").alias("end"), F.col("event_type").alias("class"))
    return redaction.refused_spans(spans, "user_id", ["click", "view", "purchase"]).groupBy("reason").agg(F.count("*").alias("n"))


def merged_roots(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("root"))
    old = docs.where("doc_id % 2 = 0").withColumn("root", F.lit("old"))
    return redaction.merged_roots(old, docs.where("doc_id % 3 = 0"), "doc_id", F.col("doc_id") % 10 != 4)


def numbered_rows(spark: SparkSession, sf: str) -> DataFrame:
    return redaction.numbered(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return redaction.seeded_sample(read(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 50, 11)


def safe_paths(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 5
    path = F.when(k == 0, F.concat(F.lit("/"), "url")).when(k == 1, F.concat(F.lit("a/../"), F.col("page_id").cast("string"))).when(k == 2, "C:x").when(k == 3, "a\\b").otherwise(F.concat(F.lit("a/"), F.col("page_id").cast("string"), F.lit("..json")))
    return read(spark, sf, "pages").select("page_id", redaction.safe_path(path).alias("safe"))


def report_sections(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.report_sections(read(spark, sf, "nation"), "n_regionkey", "n_name", F.concat(F.col("n_name"), F.lit(" ("), F.col("n_nationkey").cast("string"), F.lit(")")))


def public_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.public_rows(read(spark, sf, "part"), "p_brand", ["Brand#1", "Brand#3"]).select("p_partkey")


def overridden_roles(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select("c_custkey", F.lit("static").alias("role"))
    return catalogue.overriding(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0").withColumn("role", F.lit("dynamic")), "c_custkey")


QUERIES = {f.__name__: f for f in (made_tokens, listed_classes, refused_spans, merged_roots, numbered_rows, seeded_sample, safe_paths, report_sections, public_rows, overridden_roles)}
SQL = {
    "made_tokens": """WITH a AS (SELECT o_orderkey, o_orderdate, floor(o_totalprice) AS v FROM orders) SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '⟦DATE:' || strftime(o_orderdate, '%Y-%m') || '⟧'
  WHEN 1 THEN '⟦AMOUNT:' || CASE WHEN v < 1e3 THEN '<1k' WHEN v < 1e4 THEN '1k-10k' WHEN v < 1e5 THEN '10k-100k' WHEN v < 1e6 THEN '100k-1m' WHEN v < 1e7 THEN '1m-10m' WHEN v < 1e8 THEN '10m-100m' ELSE '>100m' END || '⟧' ELSE '⟦PERSON:ABCDEFGHIJ⟧' END AS token FROM a""",
    "listed_classes": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'COUNTERPARTY' WHEN n_nationkey % 2 = 0 THEN 'CLIENT' ELSE 'LOCATION' END AS class, n_nationkey % 5 = 0 AS allowed FROM nation UNION ALL SELECT n_nationkey + 100, NULL, false FROM nation",
    "refused_spans": """WITH s AS (SELECT user_id, floor(value * 100)::BIGINT AS a, event_type AS c FROM events),
r AS (SELECT CASE WHEN c NOT IN ('click', 'view', 'purchase') THEN 'unknown class' WHEN coalesce(max(a + 150) OVER (PARTITION BY user_id ORDER BY a, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > a THEN 'overlap' END AS reason FROM s)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""",
    "merged_roots": "SELECT doc_id, 'old' AS root FROM documents WHERE doc_id % 2 = 0 AND doc_id % 10 <> 4 AND doc_id % 3 <> 0 UNION ALL SELECT doc_id, sha256(text) FROM documents WHERE doc_id % 3 = 0",
    "numbered_rows": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS number FROM orders",
    "seeded_sample": "SELECT c_custkey, c_name FROM customer ORDER BY md5('11:' || c_custkey::VARCHAR), c_custkey LIMIT 50",
    "safe_paths": r"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' || url WHEN 1 THEN 'a/../' || page_id WHEN 2 THEN 'C:x' WHEN 3 THEN 'a\b' ELSE 'a/' || page_id || '..json' END AS path FROM pages)
SELECT page_id, path <> '' AND NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..') AND NOT contains(path, '\') AND NOT regexp_matches(path, '^[A-Za-z]:') AS safe FROM p""",
    "report_sections": "SELECT n_regionkey, string_agg('- ' || n_name || ' (' || n_nationkey::VARCHAR || ')', chr(10) ORDER BY n_name) AS body FROM nation GROUP BY n_regionkey",
    "public_rows": "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#3%'",
    "overridden_roles": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'dynamic' ELSE 'static' END AS role FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
}
