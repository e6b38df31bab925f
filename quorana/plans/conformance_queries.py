"""Released tables against their rules: parts are cells and tasks, nations standards and holdouts, events a run ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorana.functions import text as X
from quorana.functions.schema import schema_errors
from quorana.operators import catalogue
from quorana.operators import conformance as C
from quorana.tables import read
from quorana.workdir import Scratch


def _part() -> Column:
    return F.col("p_partkey")


def _key() -> Column:
    """A part's type and brand as a division."""
    return F.concat_ws("/", "p_type", "p_brand")


def gate_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of parts; a type and brand is admitted in the run now if it has a dear part, in the run then if it has a large one."""
    part = read(spark, sf, "part")
    urls = F.array(F.lit("https://a.example/1"), F.when(_part() % 13 == 4, "ftp://b").otherwise("http://b"))
    before = F.concat_ws("/", "p_type", F.when(_part() % 5 == 0, F.col("p_brand")).otherwise("Brand#1"))
    rows = part.select(
        _part().alias("cell_id"), urls.alias("urls"), F.when(_part() % 17 != 2, "filing").alias("public_source"), F.concat(F.lit("about "), F.when(_part() % 11 == 3, "1.2345").otherwise("1.25"), F.lit(" m")).alias("magnitude_band"), F.when(_part() % 7 == 0, "RETIRED").otherwise("LIVE").alias("status"),
        _key().alias("division_key"), F.array(F.struct(F.lit("then").alias("run"), before.alias("division_key"), F.when(_part() % 3 == 0, "UNADMITTED").when(_part() % 3 == 1, "ADMITTED").alias("admission_status"))).alias("history"),
    )
    admitted = part.where("p_retailprice > 1000").select(F.lit("now").alias("run"), _key().alias("division_key")).unionByName(part.where("p_size > 25").select(F.lit("then").alias("run"), _key().alias("division_key")))
    return C.cells(rows, admitted, "now")


def gate_deny(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with an entry of a list: a word, a phrase, a pattern."""
    lines = spark.createDataFrame([("# words",), ("",), ("  License ",), ("hend and",), ("regex:th[aeiou]nt",)], "value string")
    listed = C.deny_list(lines).collect()  # a list that is kept by hand
    texts = read(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), "text")
    return C.denied(texts, sorted(r.entry for r in listed if r.kind == "literal"), sorted(r.entry for r in listed if r.kind == "regex"))


def gate_numbering(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    rows = read(spark, sf, "nation").select(F.when(n == 9, 10).when(n == 8, 7).otherwise(n + 1).alias("number"), (n + 1).alias("position"), F.when(n == 20, "UNKNOWN").when(n % 2 == 0, "EVIDENCED").otherwise("PARTIAL").alias("status"))
    return C.numbered_rows(rows, 26)


def gate_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' segments mapped to nations as standards."""
    n, k = F.col("n_nationkey"), F.col("c_custkey")
    standards = read(spark, sf, "nation").where("n_nationkey % 6 <> 1").select(F.col("n_name").alias("authority"), F.when(n % 7 == 3, "http://x").otherwise("https://x").alias("uri"), F.when(n % 9 != 4, F.col("n_name")).alias("label"), F.lit("classes").alias("use"))
    rows = read(spark, sf, "customer").where("c_custkey % 10 <> 9").join(read(spark, sf, "nation"), F.col("c_nationkey") == n)
    rows = rows.select(F.concat(F.lit("field/"), k.cast("string")).alias("location"), F.col("n_name").alias("authority"), F.when(k % 21 == 0, "sameAs").otherwise("closeMatch").alias("relation"), F.when(k % 19 != 0, F.col("c_mktsegment")).alias("term"))
    objects = read(spark, sf, "customer").where("c_custkey % 5 = 4").select(F.concat(F.lit("field/"), k.cast("string")).alias("location"))
    return C.mappings(rows, standards, ("closeMatch", "broadMatch"), objects)


def gate_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Users whose events do not pass through all states."""
    state = F.when(F.col("event_type") == "click", "directed").when(F.col("event_type") == "view", "scheduled").when(F.col("event_type") == "purchase", "executed").when(F.col("value") > 20, "completed").when(F.col("value") < 1, "verified")
    return C.lacking(read(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), state.alias("value")), "user_id", C.STATES)


def gate_run_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Events as ledger rows: some digests are wrong, some rows repeat, some correct a later row or none."""
    k = F.col("event_id")
    body = F.concat_ws("|", (k - F.when(k % 40 == 7, 1).otherwise(0)).cast("string"), F.lit("row"))
    digest = lambda n: F.sha2(F.concat_ws("|", n.cast("string"), F.lit("row")), 256)
    rows = read(spark, sf, "events").select(
        k.alias("position"), body.alias("body"), F.when(k % 61 == 3, F.sha2(F.lit("forged"), 256)).otherwise(F.sha2(body, 256)).alias("row_sha256"),
        F.when(k % 50 == 11, digest(k - 10)).when(k % 50 == 12, digest(k + 5)).when(k % 50 == 13, digest(k)).alias("replaces"), F.when(k % 83 == 1, "MAYBE").otherwise("PASS").alias("verdict"),
    )
    return C.run_ledger(rows)


def gate_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as released tasks of their brand, in concepts by type; some stand in none, in two, or in another brand's."""
    part = read(spark, sf, "part")
    released = part.select(_part().cast("string").alias("reference_id"), F.col("p_brand").alias("division_key"), F.when(_part() % 4 == 0, "function").otherwise("task").alias("kind"))
    held = part.where("p_partkey % 31 <> 5").select(F.concat_ws(":", "p_brand", "p_type").alias("concept_id"), F.when(_part() % 43 == 6, "Brand#1").otherwise(F.col("p_brand")).alias("division_key"), F.when(_part() % 4 == 0, "function").otherwise("task").alias("kind"), _part().cast("string").alias("reference_id"))
    members = held.unionByName(held.where("cast(reference_id as int) % 37 = 1").withColumn("concept_id", F.lit("second")))
    brands = part.select(F.col("p_brand").alias("division_key"), F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("n")).distinct()
    rulings = brands.where("n % 3 <> 0").select("division_key", F.when(F.col("n") % 5 == 1, " ").otherwise("ann").alias("ruled_by"), F.lit("2024-01-01").alias("ruled_at"), F.lit("argued").alias("basis"))
    return C.concepts(members, released, rulings, brands.select("division_key", F.when(F.col("n") % 2 == 0, "REVIEWED").otherwise("AUTO").alias("review_status")))


def _artifacts(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages").select(F.concat(F.lit("pages/"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit(".json")).alias("path"), F.col("html").alias("content"))
    return catalogue.described(pages).withColumn("role", F.lit("page"))


RELEASE = {"repository": "example", "tag": "v1", "commit_sha": "0" * 40, "generated_at": "2024-01-01T00:00:00Z"}


def gate_release_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest of all pages, and three copies of it that were edited."""
    own = C.manifest(_artifacts(spark, sf), RELEASE)
    rows = own.select(F.explode(F.array(
        F.struct(F.lit("own").alias("name"), F.col("document")), F.struct(F.lit("other tag").alias("name"), F.replace("document", F.lit('"tag":"v1"'), F.lit('"tag":"v2"')).alias("document")),
        F.struct(F.lit("other role").alias("name"), F.regexp_replace("document", '"role":"page"', '"role":"leaf"').alias("document")), F.struct(F.lit("cut").alias("name"), F.substr("document", F.lit(1), F.lit(50)).alias("document")),
    )).alias("x")).select("x.*")
    return C.manifest_problems(rows)


def release_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """What the manifest of all pages says of them."""
    document = C.manifest(_artifacts(spark, sf), RELEASE).select(F.from_json("document", "artifacts array<struct<path: string, size: bigint, media_type: string, sha256: string>>").alias("m"))
    return document.select(F.explode("m.artifacts").alias("a")).select("a.*")


def snapshot_index(spark: SparkSession, sf: str) -> DataFrame:
    n, name = F.col("n_nationkey"), F.col("n_name")
    tag = F.when(n == 4, "-bad").when(n == 6, "NATION_5").otherwise(name)
    rows = read(spark, sf, "nation").select(
        tag.alias("tag"), F.when(n == 8, F.sha2(F.lit("NATION_7"), 256)).when(n == 9, "short").otherwise(F.sha2("n_name", 256)).alias("manifest_sha256"), F.when(n != 10, F.sha2(F.concat(name, F.lit("f")), 256)).alias("manifest_file_sha256"),
        F.when(n == 11, F.upper(F.sha1("n_name"))).otherwise(F.sha1("n_name")).alias("commit_sha"), F.concat(F.lit("reference/release-snapshots/"), F.when(n == 12, F.lit("x")).otherwise(tag)).alias("snapshot_dir"),
    )
    return C.snapshot_index(rows)


def archive_problems(spark: SparkSession, sf: str) -> DataFrame:
    files = read(spark, sf, "pages").select((F.col("page_id") % 5).cast("string").alias("tag"), F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("content"), "page_id")
    listed = files.where("page_id % 17 <> 3").select("tag", "path", F.when(F.col("page_id") % 23 == 4, "old").otherwise(F.sha2("content", 256)).alias("sha256"))
    return C.archive_problems(listed, files.where("page_id % 19 <> 5").drop("page_id"))


def surface_problems(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part").withColumn("division_key", _key())
    return C.surface_problems(part.where("p_size < 45"), part.where("p_retailprice > 950"), part.where("p_partkey % 3 <> 0"))


def resolved_holdouts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    of = lambda where, what: read(spark, sf, "nation").where(where).select(F.col("n_name").alias("holdout_id"), F.concat(F.lit(what), n.cast("string")).alias("items"))
    return C.resolved_items(of("n_nationkey % 3 = 0", "given "), of("n_nationkey % 2 = 0", "kept "), of("true", ""))


def synthesised_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("redacted"), F.lit("root").alias("root"))
    return C.without_text(docs, F.col("doc_id") % 9 == 4)


SCHEMA = """{"type": "object", "required": ["id", "kind", "tags"], "additionalProperties": false, "properties": {"id": {"type": "integer", "minimum": 10}, "kind": {"enum": ["click", "view"]}, "tags": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/tag"}},
 "note": {"type": "string", "maxLength": 3}}, "$defs": {"tag": {"type": "string", "pattern": "^t[0-9]$"}}}"""


def json_schema_errors(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    raw = F.concat(
        F.lit('{"id": '), (k % 50).cast("string"), F.lit(', "kind": "'), F.col("event_type"), F.lit('", "tags": ['), F.when(k % 4 == 0, "").when(k % 4 == 1, '"t1", "x"').otherwise('"t2"'), F.lit("]"),
        F.when(k % 6 == 5, ', "note": "long"').otherwise(""), F.when(k % 9 == 2, ', "more": 1').otherwise(""), F.when(k % 100 != 99, "}").otherwise(""),
    )
    return read(spark, sf, "events").select("event_id", F.array_join(schema_errors(raw, SCHEMA), ",").alias("errors"))


def minhash_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """First turns and items whose sketches agree in an eighth of their places; candidates share a shingle."""
    scratch = Scratch(spark, "sketches")
    sets = lambda table, key: scratch.write(read(spark, sf, table).select(key, X.word_shingles(F.col("text")).alias("s")), f"{table}-sets")
    side = lambda table, key, m: scratch.write(sets(table, key).withColumn(m, X.minhash(F.col("s"))), table)
    a, b = side("documents", "doc_id", "m_a"), side("benchmark", "item_id", "m_b")
    pairs = a.select("doc_id", F.explode("s").alias("g")).join(b.select("item_id", F.explode("s").alias("g")), "g").select("doc_id", "item_id").distinct()
    told = pairs.join(a.select("doc_id", "m_a"), "doc_id").join(b.select("item_id", "m_b"), "item_id")
    return told.select("doc_id", "item_id", X.sketch_similarity(F.col("m_a"), F.col("m_b")).alias("estimate")).where("estimate >= 0.125")


QUERIES = {f.__name__: f for f in (
    gate_cells, gate_deny, gate_numbering, gate_mappings, gate_lifecycle, gate_run_ledger, gate_concepts, gate_release_manifest, release_manifest, snapshot_index, archive_problems, surface_problems, resolved_holdouts, synthesised_documents,
    json_schema_errors, minhash_pairs,
)}

_K = "p_type || '/' || p_brand"
SQL = {
    "gate_cells": f"""WITH c AS (SELECT *, {_K} AS key, p_type || '/' || CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE 'Brand#1' END AS old FROM part), now AS (SELECT DISTINCT {_K} AS key FROM part WHERE p_retailprice > 1000), old AS (SELECT DISTINCT {_K} AS key FROM part WHERE p_size > 25),
h AS (SELECT p_partkey, key, old, p_partkey % 3 <> 0 AS claims, old IN (SELECT key FROM old) AS was FROM c)
SELECT 'S3-G1' AS gate, p_partkey || '#1' AS subject, 'no URL' AS problem FROM c WHERE p_partkey % 13 = 4 UNION ALL SELECT 'S3-G2', p_partkey::VARCHAR, 'no public source' FROM c WHERE p_partkey % 17 = 2 UNION ALL SELECT 'S3-G2', p_partkey::VARCHAR, 'precision' FROM c WHERE regexp_matches('about ' || CASE WHEN p_partkey % 11 = 3 THEN '1.2345' ELSE '1.25' END || ' m', '[0-9]+\\.[0-9]{{3,}}')
UNION ALL SELECT 'S3-G5', p_partkey::VARCHAR, 'not admitted' FROM c WHERE p_partkey % 7 <> 0 AND key NOT IN (SELECT key FROM now) UNION ALL SELECT 'S3-G5', p_partkey || '#0', unnest(list_filter([CASE WHEN key = old THEN 'repeats the current key' END, CASE WHEN claims AND NOT was THEN 'was not admitted' END, CASE WHEN NOT claims AND was THEN 'was admitted' END], lambda x: x IS NOT NULL)) FROM h""",
    "gate_deny": """SELECT 'S3-G3' AS gate, doc_id::VARCHAR AS subject, unnest(list_filter([CASE WHEN contains(lower(text), 'hend and') THEN 'literal hend and' END, CASE WHEN contains(lower(text), 'license') THEN 'literal license' END, CASE WHEN regexp_matches(text, '(?i)th[aeiou]nt') THEN 'pattern th[aeiou]nt' END], lambda x: x IS NOT NULL)) AS problem FROM documents WHERE text IS NOT NULL""",
    "gate_numbering": """WITH r AS (SELECT CASE n_nationkey WHEN 9 THEN 10 WHEN 8 THEN 7 ELSE n_nationkey + 1 END AS number, n_nationkey + 1 AS position, n_nationkey = 20 AS odd FROM nation)
SELECT 'S3-G4' AS gate, 'rows' AS subject, count(*) || ' rows' AS problem FROM r HAVING count(*) < 26 UNION ALL SELECT 'S3-G4', number::VARCHAR, 'number' FROM r WHERE number <> position UNION ALL SELECT 'S3-G4', number::VARCHAR, 'status' FROM r WHERE odd""",
    "gate_mappings": """WITH s AS (SELECT n_name, n_nationkey AS n FROM nation WHERE n_nationkey % 6 <> 1), r AS (SELECT 'field/' || c_custkey AS location, c_custkey AS k, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 9)
SELECT 'S4-G2' AS gate, location AS subject, unnest(list_filter([CASE WHEN n_name NOT IN (SELECT n_name FROM s) THEN 'authority' END, CASE WHEN k % 21 = 0 THEN 'relation' END, CASE WHEN k % 19 = 0 THEN 'term' END], lambda x: x IS NOT NULL)) AS problem FROM r
UNION ALL SELECT 'S4-G2', n_name, unnest(list_filter([CASE WHEN n % 7 = 3 THEN 'uri' END, CASE WHEN n % 9 = 4 THEN 'label' END], lambda x: x IS NOT NULL)) FROM s UNION ALL SELECT 'S4-G3', 'field/' || c_custkey, 'no mapping' FROM customer WHERE c_custkey % 5 = 4 AND 'field/' || c_custkey NOT IN (SELECT location FROM r)""",
    "gate_lifecycle": """WITH e AS (SELECT DISTINCT user_id, CASE event_type WHEN 'click' THEN 'directed' WHEN 'view' THEN 'scheduled' WHEN 'purchase' THEN 'executed' ELSE CASE WHEN value > 20 THEN 'completed' WHEN value < 1 THEN 'verified' END END AS s FROM events), a AS (SELECT DISTINCT user_id, unnest(['directed', 'scheduled', 'executed', 'completed', 'verified']) AS s FROM events)
SELECT 'S5-G2' AS gate, user_id::VARCHAR AS subject, 'lacks ' || s AS problem FROM a ANTI JOIN e USING (user_id, s)""",
    "gate_run_ledger": """WITH b AS (SELECT event_id AS k, (event_id - CASE WHEN event_id % 40 = 7 THEN 1 ELSE 0 END) || '|row' AS body FROM events), r AS (SELECT k, body, CASE WHEN k % 61 = 3 THEN sha256('forged') ELSE sha256(body) END AS h,
  CASE k % 50 WHEN 11 THEN sha256((k - 10) || '|row') WHEN 12 THEN sha256((k + 5) || '|row') WHEN 13 THEN sha256(k || '|row') END AS x, k % 83 = 1 AS odd FROM b), f AS (SELECT h, min(k) AS first FROM r GROUP BY h)
SELECT 'S7-G2' AS gate, k::VARCHAR AS subject, 'digest' AS problem FROM r WHERE h <> sha256(body) UNION ALL SELECT 'S7-G2', k::VARCHAR, 'repeated' FROM r JOIN f USING (h) WHERE k > first
UNION ALL SELECT 'S7-G2', k::VARCHAR, 'replaces no earlier row' FROM r LEFT JOIN f ON f.h = r.x WHERE x IS NOT NULL AND (first IS NULL OR first > k) UNION ALL SELECT 'S7-G3', k::VARCHAR, 'verdict' FROM r WHERE odd""",
    "gate_concepts": """WITH p AS (SELECT p_partkey AS k, p_brand, p_brand || ':' || p_type AS concept, regexp_extract(p_brand, '([0-9]+)$', 1)::INT AS n FROM part), m AS (SELECT k, concept, CASE WHEN k % 43 = 6 THEN 'Brand#1' ELSE p_brand END AS d FROM p WHERE k % 31 <> 5), a AS (SELECT * FROM m UNION ALL SELECT k, 'second', d FROM m WHERE k % 37 = 1),
u AS (SELECT p.k, count(a.k) AS c FROM p LEFT JOIN a USING (k) GROUP BY p.k), b AS (SELECT DISTINCT p_brand, n FROM p)
SELECT 'S8-G2' AS gate, a.concept || '/' || a.k AS subject, 'outside its division or kind' AS problem FROM a JOIN p USING (k) WHERE a.d <> p.p_brand UNION ALL SELECT 'S8-G2', k::VARCHAR, 'in ' || c || ' concepts' FROM u WHERE c <> 1
UNION ALL SELECT 'S8-G3', p_brand, CASE WHEN n % 2 = 0 THEN 'reviewed without a ruling' ELSE 'ruled without a review' END FROM b WHERE (n % 2 = 0 AND (n % 3 = 0 OR n % 5 = 1)) OR (n % 2 <> 0 AND n % 3 <> 0)""",
    "gate_release_manifest": "SELECT 'S4-G5' AS gate, * FROM (VALUES ('other tag', 'digest'), ('other role', 'aggregate'), ('other role', 'digest'), ('cut', 'unreadable')) t(subject, problem)",
    "release_manifest": "SELECT 'pages/' || lpad(page_id::VARCHAR, 6, '0') || '.json' AS path, octet_length(encode(html)) AS size, 'application/json' AS media_type, sha256(html) AS sha256 FROM pages",
    "snapshot_index": """WITH t AS (SELECT n_nationkey AS n, CASE n_nationkey WHEN 4 THEN '-bad' WHEN 6 THEN 'NATION_5' ELSE n_name END AS tag, CASE n_nationkey WHEN 8 THEN sha256('NATION_7') WHEN 9 THEN 'short' ELSE sha256(n_name) END AS m FROM nation)
SELECT 'snapshot' AS gate, tag AS subject, unnest(list_filter([CASE WHEN NOT regexp_matches(tag, '^[A-Za-z0-9][A-Za-z0-9_.-]*$') THEN 'tag' END, CASE WHEN NOT regexp_matches(m, '^[0-9a-f]{64}$') THEN 'manifest digest' END, CASE WHEN n = 10 THEN 'file digest' END, CASE WHEN n = 11 THEN 'commit' END, CASE WHEN n = 12 THEN 'folder' END], lambda x: x IS NOT NULL)) AS problem FROM t
UNION ALL SELECT 'snapshot', tag, 'repeated tag' FROM t GROUP BY tag HAVING count(*) > 1 UNION ALL SELECT 'snapshot', m, 'repeated manifest_sha256' FROM t GROUP BY m HAVING count(*) > 1""",
    "archive_problems": """WITH f AS (SELECT page_id AS k, (page_id % 5) || '/f' || page_id AS subject, sha256(html) AS h FROM pages), l AS (SELECT subject, CASE WHEN k % 23 = 4 THEN 'old' ELSE h END AS h FROM f WHERE k % 17 <> 3), i AS (SELECT subject, h FROM f WHERE k % 19 <> 5)
SELECT 'archive' AS gate, coalesce(l.subject, i.subject) AS subject, CASE WHEN i.h IS NULL THEN 'missing' WHEN l.h IS NULL THEN 'not listed' ELSE 'differs' END AS problem FROM l FULL JOIN i USING (subject) WHERE l.h IS DISTINCT FROM i.h""",
    "surface_problems": f"""WITH c AS (SELECT DISTINCT {_K} AS key FROM part WHERE p_size < 45), g AS (SELECT DISTINCT {_K} AS key FROM part WHERE p_retailprice > 950), m AS (SELECT DISTINCT {_K} AS key FROM part WHERE p_partkey % 3 <> 0), a AS (SELECT key FROM c UNION SELECT key FROM g UNION SELECT key FROM m),
p AS (SELECT key, concat_ws(',', CASE WHEN key NOT IN (SELECT key FROM c) THEN 'catalogue' END, CASE WHEN key NOT IN (SELECT key FROM g) THEN 'concepts' END, CASE WHEN key NOT IN (SELECT key FROM m) THEN 'matrix' END) AS gone FROM a) SELECT 'surface' AS gate, key AS subject, 'not in ' || gone AS problem FROM p WHERE gone <> ''""",
    "resolved_holdouts": "SELECT n_name AS holdout_id, CASE WHEN n_nationkey % 3 = 0 THEN 'given ' || n_nationkey WHEN n_nationkey % 2 = 0 THEN 'kept ' || n_nationkey END AS items, CASE WHEN n_nationkey % 3 = 0 THEN 'given' WHEN n_nationkey % 2 = 0 THEN 'vault' ELSE 'none' END AS source FROM nation",
    "synthesised_documents": "SELECT doc_id, CASE WHEN doc_id % 9 <> 4 THEN sha256(text) END AS redacted, CASE WHEN doc_id % 9 <> 4 THEN 'root' END AS root FROM documents",
    "json_schema_errors": """SELECT event_id, CASE WHEN event_id % 100 = 99 THEN '/: json' ELSE concat_ws(',', CASE WHEN event_id % 9 = 2 THEN '/more: additionalProperties' END, CASE WHEN event_id % 50 < 10 THEN '/id: minimum' END, CASE WHEN event_type NOT IN ('click', 'view') THEN '/kind: enum' END,
  CASE WHEN event_id % 4 = 0 THEN '/tags: minItems' WHEN event_id % 4 = 1 THEN '/tags/1: pattern' END, CASE WHEN event_id % 6 = 5 THEN '/note: maxLength' END) END AS errors FROM events""",
}
