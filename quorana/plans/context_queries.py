"""Context, vault and holdout queries: sources are institutions, languages areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorana.functions import codes, values
from quorana.operators import chain, context, residual, vault
from quorana.tables import read


def origin_scope(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = docs.select("c_mktsegment", "o_orderpriority", F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))
    got = context.origin_scope(rows, ["c_mktsegment"], "o_orderpriority", "day", "day")
    return got.select("c_mktsegment", F.array_join("institutions", ",").alias("institutions"), "period_start", "period_end")


def concept_counts(spark: SparkSession, sf: str) -> DataFrame:
    return context.counts_by_level(read(spark, sf, "part"), ["p_brand", "p_type"])


def unplaced_documents(spark: SparkSession, sf: str) -> DataFrame:
    return context.unplaced(read(spark, sf, "documents").select("doc_id", "source"), read(spark, sf, "documents").where("lang <> 'en' AND doc_id % 40 = 0").select("source"), "source").select("doc_id")


def resolved_items(spark: SparkSession, sf: str) -> DataFrame:
    return context.resolved(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels"), "doc_id", ["quality", "toxic"])


def context_counts(spark: SparkSession, sf: str) -> DataFrame:
    areas = read(spark, sf, "documents").groupBy("source").agg((F.max("doc_id") % 2 == 0).alias("historical"))
    return context.context_counts(areas, read(spark, sf, "documents").where("doc_id % 60 = 1"), "source", "historical")


def set_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    return context.disagreement(read(spark, sf, "documents").where("doc_id % 7 <> 3"), read(spark, sf, "labels"), ["doc_id"])


def stale_digests(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    recorded = docs.where("doc_id % 17 <> 2").withColumn("digest", F.when(F.col("doc_id") % 29 == 4, F.lit("old")).otherwise(F.col("digest")))
    return context.stale(docs, recorded, ["doc_id"], "digest")


def json_members(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit('{"a": [{"b~": null}, '), "props", F.lit('], "c": {"k": '), F.col("event_id").cast("string"), F.lit("}}"))
    rows = read(spark, sf, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", context.has_pointer(F.col("raw"), "/a/1/k").alias("there"), context.has_pointer(F.col("raw"), "/a/2").alias("beyond"), context.has_pointer(F.col("raw"), "/c/z").alias("absent"), F.array_join(context.keys_within(F.col("raw")), ",").alias("keys"))


def reused_nonces(spark: SparkSession, sf: str) -> DataFrame:
    spans = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.lit(0).alias("start"), F.octet_length("text").alias("end"), F.col("role").alias("class"))
    held = spans.where("doc_id % 3 = 0").withColumn("nonce", F.sha2(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("idx").cast("string")), 256))
    return vault.with_nonces(spans, held, F.lit("fresh")).select("doc_id", "idx", "reused", "nonce")


def opened_commitments(spark: SparkSession, sf: str) -> DataFrame:
    turns = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.lit(0).alias("start"), F.octet_length("text").alias("end"), F.col("role").alias("class"), F.col("text").cast("binary").alias("original"), F.unhex(F.sha2("text", 256)).alias("nonce"))
    told = turns.select("doc_id", "idx", "start", "end", "class", F.lower(F.hex(codes.commitment(F.col("doc_id").cast("string"), F.col("idx"), F.col("start"), F.col("end"), F.col("class"), F.col("original"), F.col("nonce")))).alias("commit"))
    held = turns.where("doc_id % 11 <> 4").withColumn("original", F.when(F.col("doc_id") % 13 == 6, F.lit(b"forged")).otherwise(F.col("original")))
    return vault.openings(told, held)


def leaked_content(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select(F.sha2("text", 256).alias("content_id"), "doc_id")
    return vault.leaked(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "content_id")


def episodes_like_items(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "conversations").where("turn = 0").select(F.col("conv_id").alias("item"), F.col("text").alias("task_text"))
    return vault.episodes_like_items(read(spark, sf, "conversations").where("turn = 0"), items, "conv_id", "text", "item", "task_text", at_least=0.02).where("conv_id <> item").select("conv_id", "item", "jaccard")


def earliest_review(spark: SparkSession, sf: str) -> DataFrame:
    return chain.earliest_by(read(spark, sf, "events"), "event_id", "event_type = 'error' AND value > 20")


def class_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Which order strings satisfy the predicate of the class that they were made for."""
    k = F.col("o_orderkey")
    said = F.when(k % 4 == 0, F.concat(F.lit("TRD-2024-"), F.lpad((k % 10000).cast("string"), 4, "0"))).when(k % 4 == 1, F.concat(F.lit("USD "), F.format_number("o_totalprice", 2))).when(k % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat(F.lit("ACC-"), k.cast("string")))
    row = read(spark, sf, "orders").select("o_orderkey", said.alias("s"))
    return row.select("o_orderkey", *[values.is_of_class(c, F.col("s")).alias(c.lower()) for c in ("TRADE_ID", "AMOUNT_EXACT", "DATE", "ACCOUNT_ID")])


def suspicious_files(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    name = F.when(k % 9 == 0, "keys/vault.json").when(k % 9 == 1, "a/Signing-Key.txt").otherwise(F.concat(F.lit("page"), k.cast("string")))
    content = (
        F.when((k % 9 == 0) & (k % 2 == 0), '{"a": [{"nonce": 1, "b": {"private_key": 2}}]}').when(k % 9 == 0, '{"a":').when(k % 5 == 0, F.sha2("html", 256)).when(k % 7 == 0, "-----BEGIN x").otherwise("plain")
    )
    return read(spark, sf, "pages").select("page_id", F.array_join(residual.suspicious(name, content.cast("binary")), ",").alias("reasons"))


QUERIES = {f.__name__: f for f in (
    origin_scope, concept_counts, unplaced_documents, resolved_items, context_counts, set_disagreement, stale_digests, json_members, reused_nonces, opened_commitments, leaked_content, episodes_like_items, earliest_review, class_predicates, suspicious_files,
)}
def _lp(x: str) -> str:
    return f"unhex(lpad(hex(octet_length({x})), 8, '0')) || {x}"


def _commit(doc: str, idx: str, end: str, kind: str, original: str, nonce: str) -> str:
    number = lambda x: _lp(f"unhex(lpad(hex({x}), 16, '0'))")
    return " || ".join((_lp("encode('COMMIT')"), _lp(f"encode({doc}::VARCHAR)"), number(idx), number("0"), number(end), _lp(f"encode({kind})"), _lp(original), _lp(nonce)))


SHINGLES = "list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"
SQL = {
    "origin_scope": """SELECT c_mktsegment, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS institutions, strftime(min(o_orderdate) FILTER (o_orderkey % 9 <> 0), '%Y-%m-%d') AS period_start, strftime(max(o_orderdate) FILTER (o_orderkey % 9 <> 0), '%Y-%m-%d') AS period_end
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    "concept_counts": "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_type)",
    "unplaced_documents": "SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang <> 'en' AND doc_id % 40 = 0)",
    "resolved_items": "SELECT d.doc_id, quality, toxic, CASE WHEN l.doc_id IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS resolution FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "context_counts": "WITH a AS (SELECT source, max(doc_id) % 2 = 0 AS h FROM documents GROUP BY source) SELECT count(*) FILTER (NOT h) AS present, count(*) FILTER (h) AS historical, count(*) FILTER (source NOT IN (SELECT source FROM documents WHERE doc_id % 60 = 1)) AS unplaced FROM a",
    "set_disagreement": "SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents WHERE doc_id % 7 <> 3 EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE doc_id % 7 <> 3)",
    "stale_digests": """WITH c AS (SELECT doc_id, sha256(text) AS digest FROM documents), r AS (SELECT doc_id, CASE WHEN doc_id % 29 = 4 THEN 'old' ELSE digest END AS told FROM c WHERE doc_id % 17 <> 2)
SELECT coalesce(c.doc_id, r.doc_id) AS doc_id FROM c FULL JOIN r ON c.doc_id = r.doc_id WHERE c.digest IS DISTINCT FROM r.told""",
    "json_members": """WITH r AS (SELECT event_id, ('{"a": [{"b~": null}, ' || props || '], "c": {"k": ' || event_id || '}}')::JSON AS raw FROM events)
SELECT event_id, json_exists(raw, '$.a[1].k') AS there, json_exists(raw, '$.a[2]') AS beyond, json_exists(raw, '$.c.z') AS absent,
  array_to_string(list_sort(list_distinct(json_keys(raw) || json_keys(raw, '$.c') || json_keys(raw, '$.a[0]') || json_keys(raw, '$.a[1]'))), ',') AS keys FROM r""",
    "reused_nonces": "SELECT conv_id AS doc_id, turn AS idx, conv_id % 3 = 0 AS reused, CASE WHEN conv_id % 3 = 0 THEN sha256(conv_id::VARCHAR || '/' || turn::VARCHAR) ELSE 'fresh' END AS nonce FROM conversations",
    "opened_commitments": f"""WITH t AS (SELECT conv_id, turn, octet_length(encode(text)) AS e, role, encode(text) AS o, unhex(sha256(text)) AS nonce FROM conversations),
h AS (SELECT *, CASE WHEN conv_id % 13 = 6 THEN encode('forged') ELSE o END AS held FROM t WHERE conv_id % 11 <> 4),
c AS (SELECT t.conv_id, t.turn, h.held IS NULL AS gone, sha256({_commit("t.conv_id", "t.turn", "t.e", "t.role", "t.o", "t.nonce")}) = sha256({_commit("t.conv_id", "t.turn", "t.e", "t.role", "h.held", "h.nonce")}) AS same FROM t LEFT JOIN h USING (conv_id, turn))
SELECT conv_id AS doc_id, turn AS idx, CASE WHEN gone THEN 'MISSING' WHEN same THEN 'OPEN_OK' ELSE 'OPEN_FAIL' END AS status FROM c""",
    "leaked_content": "SELECT sha256(text) AS content_id FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1",
    "episodes_like_items": f"""WITH d AS (SELECT conv_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM conversations WHERE turn = 0), s AS (SELECT conv_id, {SHINGLES} AS s FROM d), x AS (SELECT conv_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT x.conv_id, y.conv_id AS item, x.n, y.n AS m, count(*) AS c FROM x JOIN x y USING (g) WHERE x.conv_id <> y.conv_id GROUP BY ALL) SELECT conv_id, item, c / (n + m - c) AS jaccard FROM c WHERE c / (n + m - c) >= 0.02""",
    "earliest_review": "SELECT min(event_id) AS earliest FROM events WHERE event_type = 'error' AND value > 20",
    "class_predicates": "WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'TRD-2024-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') WHEN 1 THEN 'USD ' || format('{:,.2f}', o_totalprice) WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'ACC-' || o_orderkey END AS s FROM orders) SELECT o_orderkey, "
    + ", ".join(f"regexp_full_match(s, '{values.PATTERNS[c].removeprefix('(?U)')}') AS {c.lower()}" for c in ("TRADE_ID", "AMOUNT_EXACT", "DATE", "ACCOUNT_ID")) + " FROM s",
    "suspicious_files": """WITH f AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'keys/vault.json' WHEN page_id % 9 = 1 THEN 'a/Signing-Key.txt' ELSE 'page' || page_id END AS name,
  CASE WHEN page_id % 9 = 0 AND page_id % 2 = 0 THEN '{"a": [{"nonce": 1, "b": {"private_key": 2}}]}' WHEN page_id % 9 = 0 THEN '{"a":' WHEN page_id % 5 = 0 THEN sha256(html) WHEN page_id % 7 = 0 THEN '-----BEGIN x' ELSE 'plain' END AS content FROM pages)
SELECT page_id, concat_ws(',', CASE WHEN regexp_matches(name, '(?i)(vault|k_pseud|nonce|secret|seller\\.key|signing[_-]?key|\\.enc$|\\.key$)') THEN 'name' END, CASE WHEN content LIKE '-----BEGIN%' THEN 'magic' END,
  CASE WHEN name LIKE '%.json' THEN CASE WHEN NOT json_valid(content) THEN 'no JSON' WHEN regexp_matches(content, '"(nonce|private_key)" *:') THEN 'key nonce,key private_key' END END,
  CASE WHEN regexp_matches(content, '\\b[0-9a-f]{64}\\b') THEN 'unknown digest' END) AS reasons FROM f""",
}
