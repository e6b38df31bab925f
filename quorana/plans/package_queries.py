"""Lineage packages made from the documents, through the checks of buyer, examiner and seller.

A document's text with its number behind it is an original; ten characters from its middle on are
redacted. Some packages have other texts, roots, commitments or classes than they should.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorana.functions import codes
from quorana.functions import text as X
from quorana.operators import lineage, redaction, residual
from quorana.operators import package as P
from quorana.plans.text_queries import atoms as conversation_atoms
from quorana.plans.text_queries import mode_checks
from quorana.tables import read
from quorana.workdir import Scratch

CLASSES = ("PERSON", "CLIENT")


def _number_of() -> Column:
    """The document's number."""
    return F.col("k")


def originals(spark: SparkSession, sf: str) -> DataFrame:
    """(k, id, t, mode, redacted, root, segs, b, la, lb, class, nonce, commit): documents before anything was spoilt."""
    t = F.concat("text", F.lit("#"), F.col("doc_id").cast("string"))
    rows = read(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("k"), "lang", "source", t.alias("t"))
    h = F.floor(F.length("t") / 2).cast("int")
    rows = rows.withColumn("id", F.sha2("t", 256)).withColumn("a", F.substr("t", F.lit(1), h)).withColumn("b", F.substr("t", h + 1, F.lit(10))).withColumn("c", F.substr("t", h + 11))
    rows = rows.withColumn("la", F.octet_length("a")).withColumn("lb", F.octet_length("b")).withColumn("n", F.octet_length("t")).withColumn("class", F.when(_number_of() % 23 == 5, "ALIEN").when(_number_of() % 2 == 0, "PERSON").otherwise("CLIENT"))
    rows = rows.withColumn("token", F.concat(F.lit("⟦"), "class", F.lit(":tok"), (_number_of() % 50).cast("string"), F.lit("⟧"))).withColumn("nonce", F.unhex(F.sha2(F.concat(F.lit("n"), _number_of().cast("string")), 256)))
    rows = rows.withColumn("commit", F.lower(F.hex(codes.commitment(F.col("id"), F.lit(1), F.col("la"), F.col("la") + F.col("lb"), F.col("class"), F.col("b"), F.col("nonce")))))
    none = F.lit(None).cast("string")
    seg = lambda i, a, b, kind, c, tok, com: F.struct(F.lit(i).alias("idx"), a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(kind).alias("kind"), c.alias("class"), tok.alias("token"), com.alias("commit"))
    cut, upto = F.length("t") >= 30, F.col("la") + F.col("lb")
    three = F.array(seg(0, F.lit(0), F.col("la"), "KEEP", none, none, none), seg(1, F.col("la"), upto, "REDACT", F.col("class"), F.col("token"), F.col("commit")), seg(2, upto, F.col("n"), "KEEP", none, none, none))
    rows = rows.withColumn("segs", F.when(cut, three).otherwise(F.array(seg(0, F.lit(0), F.col("n"), "KEEP", none, none, none)))).withColumn("redacted", F.when(cut, F.concat("a", "token", "c")).otherwise(F.col("t")))
    rows = rows.withColumn("root", P.rebuilt_root(F.col("id"), F.col("segs"), P.rebuilt(F.col("redacted"), F.col("segs")))).withColumn("mode", F.when(_number_of() % 31 == 7, "SYNTHESISE").otherwise("REDACT"))
    return Scratch(spark, "package").write(rows.select("k", "lang", "source", F.col("id").alias("doc_id"), "mode", "redacted", "root", "segs", "b", "class", "token", cut.alias("cut")), "docs")


def spoilt(rows: DataFrame) -> DataFrame:
    """The package as shipped."""
    segs = F.transform("segs", lambda s: s.withField("commit", F.when(s["commit"].isNotNull() & (_number_of() % 19 == 4), F.sha2(F.lit("x"), 256)).otherwise(s["commit"])))
    return rows.withColumn("redacted", F.when(_number_of() % 13 == 2, F.concat("redacted", F.lit("!"))).otherwise(F.col("redacted"))).withColumn("root", F.when(_number_of() % 17 == 3, F.sha2(F.lit("y"), 256)).otherwise(F.col("root"))).withColumn("segs", segs)


def manifest(rows: DataFrame) -> DataFrame:
    """(doc_id, position): not all documents, some twice, in the order of another digest."""
    listed = rows.where("k % 29 <> 6").select("doc_id").unionByName(rows.where("k % 41 = 8").select("doc_id"))
    return redaction.numbered(listed.withColumn("o", F.md5("doc_id")), ["o"], "number").select("doc_id", (F.col("number") - 1).alias("position"))


def check_manifest(spark: SparkSession, sf: str) -> DataFrame:
    rows = originals(spark, sf)
    # repeated ids share a digest, so their order is fixed as well
    return P.check_manifest(manifest(rows), rows.select("doc_id"), "0" * 64, F.sha2(F.lit("m"), 256), F.sha2(F.lit("m"), 256))


def check_roots(spark: SparkSession, sf: str) -> DataFrame:
    return P.check_roots(spoilt(originals(spark, sf)), CLASSES)


def gate_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest and roots together."""
    rows = originals(spark, sf)
    first = P.check_manifest(manifest(rows), rows.select("doc_id"), "0" * 64, F.lit("m"), F.lit("n"), "B-G3")
    return first.unionByName(P.check_roots(spoilt(rows), CLASSES, "B-G3"))


def _atoms(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_atoms(spark, sf).select(F.col("conv_id").alias("episode_id"), "lineage_class", F.col("text").alias("content"))


def check_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Shipped ratios of which some count a byte too many and some are missing."""
    found = _atoms(spark, sf)
    e = F.col("episode_id")
    shipped = lineage.ratios(found, "episode_id", "lineage_class", "content").where(~F.coalesce(e % 11 == 3, F.lit(False))).withColumn("n_bytes", F.when(e % 7 == 2, F.col("n_bytes") + 1).otherwise(F.col("n_bytes")))
    return P.check_ratios(found, shipped)


def check_marks(spark: SparkSession, sf: str) -> DataFrame:
    """A package per source, marked with its registered tag in three documents of four; some have another's tag, recipient or none registered."""
    docs = read(spark, sf, "documents").where("source IS NOT NULL AND text IS NOT NULL")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("long")
    registry = docs.select("source").distinct().where(number % 5 != 4).select(F.col("source").alias("package_id"), F.when(number % 7 == 2, "someone").otherwise("buyer").alias("recipient_id"), F.lower(F.lpad(F.hex(number * 7919 + 1), 8, "0")).alias("tag"))
    packages = docs.select(F.col("source").alias("package_id"), F.lit("buyer").alias("recipient_id")).distinct()
    tag = F.when(number % 3 == 1, number * 7919 + 2).otherwise(number * 7919 + 1)
    texts = docs.select(F.col("source").alias("package_id"), F.when(F.col("doc_id") % 4 != 1, F.concat("text", F.lit(X.MARK_SEQUENCE), X.encode_tag(tag), F.lit(X.MARK_END))).otherwise(F.col("text")).alias("text"))
    return P.check_marks(packages, registry, texts)


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """The held-out items: the benchmark, with names, answers and the documents that they come from."""
    b = read(spark, sf, "benchmark")
    return b.select(F.concat(F.lit("item-"), F.col("item_id").cast("string"), F.lit(".")).alias("item_name"), F.col("text").alias("task_text"), F.concat(F.lit("⟦PERSON:tok"), F.col("item_id").cast("string"), F.lit("⟧")).alias("answer"), "item_id")


def _files(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(F.lit("redacted/"), _number_of().cast("string")).alias("path"), F.when(_number_of() % 97 == 5, F.concat("redacted", F.lit(" see item-"), (_number_of() % 7).cast("string"), F.lit("."))).otherwise(F.col("redacted")).alias("content"))


def _episodes(spark: SparkSession, sf: str) -> DataFrame:
    """First turns, and every ninth item in other words."""
    own = read(spark, sf, "conversations").where("turn = 0").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("episode_id"), F.col("text").alias("task_text"))
    return own.unionByName(read(spark, sf, "benchmark").where("item_id % 9 = 1").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("episode_id"), F.concat("text", F.lit(" Say why.")).alias("task_text")))


def check_holdout(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    commit = read(spark, sf, "nation").select(F.col("n_name").alias("holdout_id"), F.when(n % 4 == 1, "short").otherwise(F.sha2("n_name", 256)).alias("items_commit"), F.when(n % 5 == 2, "soon").otherwise("2024-05-01T10:00:00Z").alias("created_utc"))
    return P.check_holdout(commit, _files(originals(spark, sf)), _episodes(spark, sf), _items(spark, sf))


def gate_leakage(spark: SparkSession, sf: str) -> DataFrame:
    rows = originals(spark, sf)
    sources = rows.select(F.col("k").alias("item_id"), F.array("doc_id").alias("source_doc_ids"))
    items = _items(spark, sf).join(sources, "item_id", "left").withColumn("source_doc_ids", F.coalesce("source_doc_ids", F.array().cast("array<string>")))
    return P.check_leakage(rows.where("k % 2 = 0"), _files(rows), _episodes(spark, sf), items)


def check_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").where("text IS NOT NULL").withColumnRenamed("doc_id", "k")
    path = F.when(_number_of() % 9 == 0, F.concat(F.lit("keys/vault"), _number_of().cast("string"), F.lit(".json"))).otherwise(F.concat(F.lit("d/"), _number_of().cast("string"), F.lit(".txt")))
    content = F.when(_number_of() % 5 == 0, F.sha2(F.concat("text", _number_of().cast("string")), 256)).when(_number_of() % 6 == 0, '{"original": 1}').otherwise("plain")
    known = docs.where("k % 10 = 0").select(F.sha2(F.concat("text", _number_of().cast("string")), 256).alias("digest"))
    return P.check_files(docs.select(path.alias("path"), content.cast("binary").alias("content")), known)


def gate_canary(spark: SparkSession, sf: str) -> DataFrame:
    """A registry per source, a line per document; some links are forged, some packages have no line."""
    from quorana.operators.chain import chained

    docs = read(spark, sf, "documents").where("text IS NOT NULL").select(F.col("source").alias("registry"), F.col("doc_id").alias("position"), F.col("text").alias("payload"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("package_id"), F.lit("r").alias("recipient_id"))
    lines = chained(docs, ["registry"], "position", "payload").withColumn("told", F.when(F.col("position") % 47 == 9, "forged").otherwise(F.col("prev_hash"))).drop("prev_hash", "line_hash")
    packages = docs.select(F.when(F.col("position") % 50 == 0, F.concat("package_id", F.lit("x"))).otherwise(F.col("package_id")).alias("package_id"), "recipient_id")
    return P.check_registry(lines, packages)


def gate_floor(spark: SparkSession, sf: str) -> DataFrame:
    found = _atoms(spark, sf)
    c = F.col("episode_id")
    meta = found.select("episode_id").distinct().withColumn("marketed_tier", F.when(c % 4 != 0, F.when(c % 2 == 0, "VERIFIED").otherwise("MIXED"))).withColumn("tier_label", F.when(c % 5 < 3, "VERIFIED").otherwise("MIXED"))
    return P.check_floor(P.tiers(found, "episode_id"), meta, "episode_id")


def gate_mode(spark: SparkSession, sf: str) -> DataFrame:
    return P.broken(mode_checks(spark, sf), "B-G7", F.col("doc_id"), F.col("problem"))


def gate_determinism(spark: SparkSession, sf: str) -> DataFrame:
    rows = originals(spark, sf)
    return P.check_again(spoilt(rows), rows.where("k % 37 <> 1"))


def gate_holdout(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").where("source IS NOT NULL")
    audit = docs.select(F.col("source").alias("package_id"), F.when(F.col("doc_id") % 3 == 0, "external_review").otherwise("export").alias("event"), F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T08:00:00Z")).alias("ts"))
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    commits = docs.select("source").distinct().select(F.col("source").alias("package_id"), F.when(number % 6 == 5, "later").when(number % 2 == 0, "2024-01-01T08:00:00Z").otherwise("2024-01-02T07:00:00+00:00").alias("created_utc"))
    return P.check_precedence(commits, audit)


def _entries(rows: DataFrame) -> DataFrame:
    shipped = F.when(_number_of() % 43 == 1, F.concat("token", F.lit("z"))).otherwise(F.col("token"))
    return rows.where("cut").select("doc_id", F.lit(1).alias("idx"), F.when(_number_of() % 8 == 0, "DATE").otherwise(F.col("class")).alias("class"), F.col("b").alias("original"), F.col("token").alias("expected"), shipped.alias("shipped"))


def check_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    return P.check_pseudonyms(_entries(originals(spark, sf)))


def check_originals(spark: SparkSession, sf: str) -> DataFrame:
    rows = originals(spark, sf)
    vault = rows.where("cut AND k % 59 <> 2").select("doc_id", F.lit(1).alias("idx"), F.when(_number_of() % 53 == 3, "forged").otherwise(F.col("b")).alias("original"))
    return P.check_originals(rows, vault, manifest(rows).select("doc_id"))


def check_origin(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    origins = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("institution"), day.alias("period_start"), day.alias("period_end"))
    return P.check_origin(origins, ("1-URGENT", "2-HIGH", "5-LOW"), "1996-01-01", "1998-12-31")


SEGMENTS, PLACES = ("building", "household", "machinery", "automobile", "furniture"), ("nation_1", "nation_12", "nation_2", "nation_20")


def rare_tuples(spark: SparkSession, sf: str) -> DataFrame:
    """What customers' notes say of segment, amount, month and nation."""
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, F.concat(F.lit(" holds ⟦AMOUNT:"), (k % 4).cast("string"), F.lit("k⟧"))).when(k % 3 == 1, F.concat(F.lit(" holds USD "), (k * 7).cast("string"))).otherwise("")
    text = F.concat("c_mktsegment", F.lit(" at "), "n_name", said, F.when(k % 2 == 0, F.concat(F.lit(" since ⟦DATE:1995-0"), (k % 3 + 1).cast("string"), F.lit("⟧"))).otherwise(""))
    return P.rare_tuples(c.select(k.cast("string").alias("doc_id"), text.alias("redacted")), SEGMENTS, PLACES)


def residual_findings(spark: SparkSession, sf: str) -> DataFrame:
    """R1, R2 and R4 over all redacted documents; offsets need Python."""
    rows = originals(spark, sf).select("k", P.text_findings(F.col("redacted"), residual.Detector()).alias("f"))
    return rows.select("k", F.inline("f"))


def residual_gate(spark: SparkSession, sf: str) -> DataFrame:
    found = residual_findings(spark, sf)
    return P.severity_counts(found, F.lit(1000))


QUERIES = {f.__name__: f for f in (
    check_manifest, check_roots, gate_manifest, check_ratios, check_marks, check_holdout, gate_leakage, check_files, gate_canary, gate_floor, gate_mode, gate_determinism, gate_holdout, check_pseudonyms, check_originals, check_origin, rare_tuples,
    residual_findings, residual_gate,
)}


def _lp(x: str) -> str:
    return f"unhex(lpad(hex(octet_length({x})), 8, '0')) || {x}"


def _number(x: str) -> str:
    return _lp(f"unhex(lpad(hex({x}), 16, '0'))")


def _kept(idx: str, start: str, end: str, data: str) -> str:
    return "unhex(sha256(" + " || ".join((_lp("encode('KEEP')"), _lp("encode(id)"), _number(idx), _number(start), _number(end), _lp(f"encode({data})"))) + "))"


def _node(a: str, b: str) -> str:
    return f"unhex(sha256({_lp("encode('NODE')")} || {_lp(a)} || {_lp(b)}))"


DOCS = f"""WITH o AS (SELECT doc_id AS k, lang, source, text || '#' || doc_id AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, sha256(t) AS id, length(t) >= 30 AS cut, left(t, length(t) // 2) AS a, substr(t, length(t) // 2 + 1, 10) AS b, substr(t, length(t) // 2 + 11) AS c, CASE WHEN k % 23 = 5 THEN 'ALIEN' WHEN k % 2 = 0 THEN 'PERSON' ELSE 'CLIENT' END AS cls FROM o),
q AS (SELECT *, octet_length(encode(a)) AS la, octet_length(encode(b)) AS lb, octet_length(encode(t)) AS n, '⟦' || cls || ':tok' || (k % 50) || '⟧' AS tok FROM p),
r AS (SELECT *, unhex(sha256({" || ".join((_lp("encode('COMMIT')"), _lp("encode(id)"), _number("1"), _number("la"), _number("la + lb"), _lp("encode(cls)"), _lp("encode(b)"), _lp("unhex(sha256('n' || k))")))})) AS com,
  {_kept("0", "0", "la", "a")} AS l0, {_kept("2", "la + lb", "n", "c")} AS l2, {_kept("0", "0", "n", "t")} AS whole FROM q),
s AS (SELECT *, CASE WHEN k % 19 = 4 THEN unhex(sha256('x')) ELSE com END AS told_com, CASE WHEN cut THEN a || tok || c ELSE t END AS redacted, k % 31 = 7 AS synth FROM r),
u AS (SELECT *, lower(hex(CASE WHEN cut THEN {_node(_node("l0", "com"), _node("l2", "l2"))} ELSE whole END)) AS root, lower(hex(CASE WHEN cut THEN {_node(_node("l0", "told_com"), _node("l2", "l2"))} ELSE whole END)) AS again FROM s),
d AS (SELECT *, redacted || CASE WHEN k % 13 = 2 THEN '!' ELSE '' END AS told_redacted, CASE WHEN k % 17 = 3 THEN sha256('y') ELSE root END AS told_root FROM u),
m AS (SELECT id FROM d WHERE k % 29 <> 6 UNION ALL SELECT id FROM d WHERE k % 41 = 8)"""
MANIFEST = """SELECT '{g}' AS gate, id AS subject, 'repeated' AS problem FROM m GROUP BY id HAVING count(*) > 1
UNION ALL SELECT '{g}', 'manifest', 'order' FROM (SELECT row_number() OVER (ORDER BY id) AS a, row_number() OVER (ORDER BY md5(id)) AS b FROM m) HAVING count(*) FILTER (a <> b) > 0
UNION ALL SELECT '{g}', 'manifest', 'root' UNION ALL SELECT '{g}', id, 'not in the manifest' FROM d WHERE id NOT IN (SELECT id FROM m)"""
ROOTS = """SELECT '{g}' AS gate, id AS subject, unnest(list_filter([CASE WHEN octet_length(encode(told_redacted)) <> octet_length(encode(redacted)) THEN 'text' END, CASE WHEN cut AND cls NOT IN ('PERSON', 'CLIENT') THEN 'class' END, CASE WHEN again <> told_root THEN 'root' END], lambda x: x IS NOT NULL)) AS problem FROM d WHERE NOT synth"""
EPISODES = """, ep AS (SELECT 'c' || conv_id AS e, text FROM conversations WHERE turn = 0 UNION ALL SELECT 'b' || item_id, text || ' Say why.' FROM benchmark WHERE item_id % 9 = 1),
fl AS (SELECT 'redacted/' || k AS path, redacted || CASE WHEN k % 97 = 5 THEN ' see item-' || (k % 7) || '.' ELSE '' END AS content FROM d), it AS (SELECT 'item-' || item_id || '.' AS name, * FROM benchmark),
w1 AS (SELECT e, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM ep), w2 AS (SELECT name, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM it),
s1 AS (SELECT e, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w1),
s2 AS (SELECT name, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w2),
x1 AS (SELECT e, len(s) AS n, unnest(s) AS g FROM s1), x2 AS (SELECT name, len(s) AS m, unnest(s) AS g FROM s2), cc AS (SELECT e, name, n, m, count(*) AS c FROM x1 JOIN x2 USING (g) GROUP BY ALL), near AS (SELECT e, name FROM cc WHERE c / (n + m - c) >= 0.8)"""
ATOMS = """WITH a AS (SELECT conv_id AS e, CASE WHEN role = 'user' THEN 'SPAN_VERIFIED' WHEN turn % 3 = 1 THEN 'PSEUDONYMISED_TRACEABLE' ELSE 'SYNTHETIC_UNPROVABLE' END AS c, octet_length(encode(text)) AS b FROM conversations)"""
SQL = {
    "check_manifest": DOCS + " " + MANIFEST.format(g="V1"),
    "check_roots": DOCS + " " + ROOTS.format(g="V2"),
    "gate_manifest": DOCS + " " + MANIFEST.format(g="B-G3") + " UNION ALL SELECT 'B-G3', 'manifest', 'digest' UNION ALL " + ROOTS.format(g="B-G3"),
    "check_ratios": ATOMS + """, g AS (SELECT e, c, count(*) AS n, sum(b) AS s FROM a GROUP BY GROUPING SETS ((e, c), (c))), t AS (SELECT e, c, n, s + CASE WHEN e % 7 = 2 THEN 1 ELSE 0 END AS s FROM g WHERE NOT coalesce(e % 11 = 3, false))
SELECT 'V4' AS gate, coalesce(coalesce(g.e, t.e)::VARCHAR, 'all') || '/' || coalesce(g.c, t.c) AS subject, CASE WHEN t.n IS NULL THEN 'not shipped' WHEN g.n IS NULL THEN 'not recomputed' ELSE 'differs' END AS problem FROM g FULL JOIN t ON g.e IS NOT DISTINCT FROM t.e AND g.c = t.c WHERE g.n IS DISTINCT FROM t.n OR g.s IS DISTINCT FROM t.s""",
    "check_marks": """WITH d AS (SELECT source, regexp_extract(source, '([0-9]+)$', 1)::INT AS n, doc_id FROM documents WHERE source IS NOT NULL AND text IS NOT NULL), p AS (SELECT source, any_value(n) AS n, count(*) FILTER (doc_id % 4 <> 1) AS marked FROM d GROUP BY source)
SELECT 'V5' AS gate, source AS subject, unnest(list_filter([CASE WHEN n % 5 = 4 THEN 'not registered' END, CASE WHEN n % 5 <> 4 AND n % 7 = 2 THEN 'recipient' END, CASE WHEN n % 5 <> 4 AND (marked < 3 OR n % 3 = 1) THEN 'mark' END], lambda x: x IS NOT NULL)) AS problem FROM p""",
    "check_holdout": DOCS + EPISODES + """ SELECT 'V6' AS gate, n_name AS subject, 'commitment' AS problem FROM nation WHERE length(CASE WHEN n_nationkey % 4 = 1 THEN 'short' ELSE sha256(n_name) END) <> 64 UNION ALL SELECT 'V6', n_name, 'time' FROM nation WHERE TRY_CAST(CASE WHEN n_nationkey % 5 = 2 THEN 'soon' ELSE '2024-05-01T10:00:00Z' END AS TIMESTAMPTZ) IS NULL
UNION ALL SELECT 'V6', path, 'names ' || name FROM fl JOIN it ON contains(content, name) UNION ALL SELECT 'V6', e, 'like ' || name FROM near""",
    "gate_leakage": DOCS + EPISODES + """, tk AS (SELECT unnest(regexp_extract_all(content, '⟦[A-Z_]+:[^⟦⟧]*⟧')) AS t FROM fl) SELECT 'B-G1' AS gate, id AS subject, 'document' AS problem FROM d WHERE k % 2 = 0 AND k IN (SELECT item_id FROM benchmark)
UNION ALL SELECT DISTINCT 'B-G1', t, 'token' FROM tk WHERE t IN (SELECT '⟦PERSON:tok' || item_id || '⟧' FROM benchmark) UNION ALL SELECT 'B-G1', e, 'like ' || name FROM near UNION ALL SELECT DISTINCT 'B-G1', name, 'item name' FROM fl JOIN it ON contains(content, name)""",
    "check_files": """WITH f AS (SELECT doc_id AS k, CASE WHEN doc_id % 9 = 0 THEN 'keys/vault' || doc_id || '.json' ELSE 'd/' || doc_id || '.txt' END AS path, CASE WHEN doc_id % 5 = 0 THEN sha256(text || doc_id) WHEN doc_id % 6 = 0 THEN '{"original": 1}' ELSE 'plain' END AS content, sha256(text || doc_id) AS h FROM documents WHERE text IS NOT NULL)
SELECT 'V7' AS gate, path AS subject, unnest(list_filter([CASE WHEN contains(path, 'vault') THEN 'name' END, CASE WHEN path LIKE '%.json' AND NOT json_valid(content) THEN 'no JSON' END, CASE WHEN path LIKE '%.json' AND contains(content, '"original"') THEN 'key original' END,
  CASE WHEN regexp_matches(content, '\\b[0-9a-f]{64}\\b') AND content NOT IN (SELECT h FROM f WHERE k % 10 = 0) THEN 'unknown digest' END], lambda x: x IS NOT NULL)) AS problem FROM f""",
    "gate_canary": """WITH l AS (SELECT source, doc_id, coalesce(lag(sha256(text)) OVER (PARTITION BY source ORDER BY doc_id), repeat('0', 64)) AS prev FROM documents WHERE text IS NOT NULL)
SELECT 'B-G2' AS gate, source || '/' || doc_id AS subject, 'link' AS problem FROM l WHERE prev <> CASE WHEN doc_id % 47 = 9 THEN 'forged' ELSE prev END
UNION ALL SELECT 'B-G2', 'p' || doc_id || 'x', 'no registered salt' FROM l WHERE doc_id % 50 = 0""",
    "gate_floor": ATOMS + """, t AS (SELECT e, CASE WHEN coalesce(sum(b) FILTER (c <> 'SYNTHETIC_UNPROVABLE') / nullif(sum(b), 0), 0) >= 0.8 THEN 'VERIFIED' ELSE 'MIXED' END AS tier FROM a GROUP BY e),
m AS (SELECT *, CASE WHEN e % 4 = 0 OR e % 2 = 0 THEN 'VERIFIED' ELSE 'MIXED' END AS marketed, CASE WHEN e % 5 < 3 THEN 'VERIFIED' ELSE 'MIXED' END AS label FROM t)
SELECT 'B-G4' AS gate, e::VARCHAR AS subject, tier || ' as ' || label AS problem FROM m WHERE NOT CASE WHEN marketed = 'VERIFIED' THEN tier = 'VERIFIED' AND label = 'VERIFIED' ELSE label = 'MIXED' END""",
    "gate_mode": """WITH r AS (SELECT user_id AS k, bool_or(value >= 60) AS v, bool_or(value < 1.5) AS s, max(event_id) % 4 = 0 AS m FROM events GROUP BY user_id)
SELECT 'B-G7' AS gate, k::VARCHAR AS subject, 'synthesised document cited' AS problem FROM r WHERE v AND m UNION ALL SELECT 'B-G7', k::VARCHAR, 'mixed modes' FROM r WHERE v AND s""",
    "gate_determinism": DOCS + " SELECT 'B-G8' AS gate, id AS subject, CASE WHEN k % 37 = 1 THEN 'no source' ELSE 'differs' END AS problem FROM d WHERE NOT synth AND (k % 37 = 1 OR redacted <> told_redacted OR root <> told_root)",
    "gate_holdout": """WITH a AS (SELECT source, min(('2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T08:00:00Z')::TIMESTAMPTZ) FILTER (doc_id % 3 = 0) AS first FROM documents WHERE source IS NOT NULL GROUP BY source),
c AS (SELECT *, TRY_CAST(CASE WHEN n % 6 = 5 THEN 'later' WHEN n % 2 = 0 THEN '2024-01-01T08:00:00Z' ELSE '2024-01-02T07:00:00+00:00' END AS TIMESTAMPTZ) AS created FROM (SELECT *, regexp_extract(source, '([0-9]+)$', 1)::INT AS n FROM a))
SELECT 'B-G9' AS gate, source AS subject, CASE WHEN created IS NULL THEN 'no time' ELSE 'after the review' END AS problem FROM c WHERE created IS NULL OR created >= first""",
    "check_pseudonyms": DOCS + """, e AS (SELECT id, CASE WHEN k % 8 = 0 THEN id ELSE '*' END AS scope, CASE WHEN k % 8 = 0 THEN 'DATE' ELSE cls END || ':' || b AS o, tok, tok || CASE WHEN k % 43 = 1 THEN 'z' ELSE '' END AS shipped FROM d WHERE cut)
SELECT 'E4' AS gate, id || '#1' AS subject, 'token' AS problem FROM e WHERE shipped <> tok UNION ALL SELECT 'E4', o, 'split' FROM e GROUP BY scope, o HAVING count(DISTINCT shipped) > 1 UNION ALL SELECT 'E4', shipped, 'collision' FROM e GROUP BY scope, shipped HAVING count(DISTINCT o) > 1""",
    "check_originals": DOCS + """, v AS (SELECT *, CASE WHEN NOT cut THEN t WHEN k % 59 = 2 THEN NULL ELSE a || CASE WHEN k % 53 = 3 THEN 'forged' ELSE b END || c END AS whole_again FROM d WHERE NOT synth)
SELECT 'E5' AS gate, id AS subject, unnest(list_filter([CASE WHEN coalesce(sha256(whole_again) <> id, true) THEN 'original' END, CASE WHEN id NOT IN (SELECT id FROM m) THEN 'not in the manifest' END], lambda x: x IS NOT NULL)) AS problem FROM v""",
    "check_origin": """SELECT 'E7' AS gate, o_orderkey::VARCHAR AS subject, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') THEN 'institution' ELSE 'period' END AS problem FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') OR NOT (strftime(o_orderdate, '%Y-%m-%d') >= '1996-01-01' AND strftime(o_orderdate, '%Y-%m-%d') <= '1998-12-31')""",
    "rare_tuples": f"""WITH t AS (SELECT c_custkey AS k, lower(c_mktsegment || ' at ' || n_name) AS low, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 4) || 'k' WHEN c_custkey % 3 = 1 THEN CASE WHEN c_custkey * 7 < 1e3 THEN '<1k' WHEN c_custkey * 7 < 1e4 THEN '1k-10k' WHEN c_custkey * 7 < 1e5 THEN '10k-100k' WHEN c_custkey * 7 < 1e6 THEN '100k-1m' ELSE '1m-10m' END END AS band,
  CASE WHEN c_custkey % 2 = 0 THEN '1995-0' || (c_custkey % 3 + 1) END AS bucket FROM customer JOIN nation ON c_nationkey = n_nationkey),
q AS (SELECT k, list_filter({sorted(SEGMENTS, key=len, reverse=True)}, lambda x: contains(low, x))[1] AS product, band, bucket, list_filter({sorted(PLACES, key=len, reverse=True)}, lambda x: contains(low, x))[1] AS venue FROM t),
g AS (SELECT *, count(*) OVER (PARTITION BY product, band, bucket, venue) AS n FROM q)
SELECT 'R3' AS gate, k::VARCHAR AS subject, 'k = ' || n AS problem FROM g WHERE n < 5 AND (product IS NOT NULL)::INT + (band IS NOT NULL)::INT + (bucket IS NOT NULL)::INT + (venue IS NOT NULL)::INT >= 2""",
}
