"""Ledger, chain, hierarchy and roll-up queries: labels are the checked ledger of documents, events an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorana.operators import catalogue, chain, ledger, overlay
from quorana.operators import validate as V
from quorana.tables import read

KINDS = ("A1", "A2", "A3")


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """(division_key, anchor_type, anchor_text): a document is an anchor of its source, of the kind that its language has."""
    kind = F.when(F.col("lang") == "en", "A1").when(F.col("lang") == "fr", "A2").when(F.col("lang") == "de", "A3").otherwise("A4")
    return read(spark, sf, "documents").select(F.col("source").alias("division_key"), kind.alias("anchor_type"), F.col("doc_id").alias("anchor_text"))


def checked(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger: a labelled document is VERIFIED, PARTIAL, REFUTED or UNVERIFIED by its labels."""
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "VERIFIED").when(F.col("quality") == 1, "PARTIAL").when(F.col("toxic") == 1, "REFUTED").otherwise("UNVERIFIED")
    return read(spark, sf, "labels").select("doc_id", status.alias("status")).join(claims(spark, sf), F.col("doc_id") == F.col("anchor_text")).drop("doc_id")


KEYS = ["division_key", "anchor_type", "anchor_text"]


def ledger_worst_status(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.worst_status(claims(spark, sf), checked(spark, sf), KEYS)


def corroboration_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.summary(ledger_worst_status(spark, sf), "division_key", "anchor_type")


def ledger_missing(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.missing(claims(spark, sf), checked(spark, sf), KEYS)


def ledger_extend(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.extended(checked(spark, sf), claims(spark, sf), KEYS).select(*KEYS, "status")


def grid_join(spark: SparkSession, sf: str) -> DataFrame:
    tiers = read(spark, sf, "documents").groupBy(F.col("source").alias("division_key")).agg(F.countDistinct("lang").alias("model_support"))
    tiers = tiers.withColumn("tier", F.when(F.col("model_support") >= 4, "STRONG").otherwise("MODERATE"))
    return ledger.grid(tiers, corroboration_summary(spark, sf), "division_key")


def grid_axes(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.axes(read(spark, sf, "documents"), ["lang", "source"]).select("axis", F.array_join("values", ",").alias("values"))


def ledger_problems(spark: SparkSession, sf: str) -> DataFrame:
    rows = checked(spark, sf).withColumn("checked_by", F.when(F.col("anchor_text") % 7 != 0, "agent")).withColumn("status", F.when(F.col("anchor_text") % 31 == 0, "DONE").otherwise(F.col("status")))
    return ledger.problems(rows).select("anchor_text", F.array_join("problems", ",").alias("problems"))


def admission_filter(spark: SparkSession, sf: str) -> DataFrame:
    """An order is a division: its lines are anchors, parts are tasks, prices the seat range."""
    per = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("anchors"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.max("l_discount").alias("fraction"), F.countDistinct("l_partkey").alias("tasks"))
    value = V.recomputed(F.col("low"), F.col("high"), F.col("fraction"))
    got = V.admission(per, F.col("anchors"), value, F.col("tasks"), 2500.0)
    return got.select("l_orderkey", "admitted", F.array_join("reasons", ",").alias("reasons"))


def arith_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    return li.join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", V.mismatch(F.col("o_totalprice"), F.col("value")).alias("mismatch"))


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("user_id", "event_id", F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props").alias("payload"))


def hash_chain(spark: SparkSession, sf: str) -> DataFrame:
    return chain.chained(event_lines(spark, sf), ["user_id"], "event_id", "payload").select("user_id", "event_id", "line_hash", "prev_hash")


def hash_chain_broken(spark: SparkSession, sf: str) -> DataFrame:
    lines = chain.chained(event_lines(spark, sf), ["user_id"], "event_id", "payload").withColumn("told", F.when(F.col("event_id") % 97 == 0, F.lit("0" * 64)).otherwise(F.col("prev_hash"))).drop("line_hash", "prev_hash")
    return chain.broken_links(lines, ["user_id"], "event_id", "payload", "told").select("user_id", "event_id")


def corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a ledger in which every error replaces the event ten before it, and some name one that is yet to come."""
    replaces = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), F.col("event_id") - 10).when(F.col("event_id") % 1001 == 7, F.col("event_id") + 5)
    return read(spark, sf, "events").select("event_id", "event_type", replaces.alias("replaces"))


def ledger_supersede(spark: SparkSession, sf: str) -> DataFrame:
    return chain.current(corrections(spark, sf), "event_id", "replaces").select("event_id", "event_type")


def ledger_dangling(spark: SparkSession, sf: str) -> DataFrame:
    rows = corrections(spark, sf).withColumn("position", F.col("event_id"))
    return chain.dangling(rows, "event_id", "replaces", "position").select("event_id", "replaces")


def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select(F.sha2("text", 256).alias("doc"), "doc_id")
    return chain.version_diff(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 5 <> 0"), "doc")


def hierarchy_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """Customers under the customer with half their number, the first hundred each under the one before; one points forward and closes a cycle."""
    k = F.col("c_custkey")
    nodes = read(spark, sf, "customer").select(k.alias("id"), F.when(k == 3, F.lit(13)).when(k.between(14, 100), k - 1).when(k > 1, F.floor(k / 2)).cast("long").alias("parent"))
    return chain.ancestors(nodes, "id", "parent").select("child", "ancestor", "cycle")


def division_rollup_voids(spark: SparkSession, sf: str) -> DataFrame:
    """Parts are divisions, line items rows that paint by priority of their order and return flag."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    weights = {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1}
    rows = read(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    status, channel = F.when(F.col("l_returnflag") == "A", "RATIFIED_MAPPING").otherwise("PENDING"), F.when(F.col("o_orderstatus") == "F", "public").otherwise("private")
    rows = rows.withColumn("weight", overlay.paint_weight(status, channel, F.col("l_linestatus") == "F", F.lit("division"), F.col("o_orderpriority"), weights)).withColumn("row_id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    divisions = read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"))
    got = overlay.rollup(divisions, rows, "l_partkey", "weight", "row_id")
    return got.select(F.col("l_partkey").alias("division"), "saturation", "painted_rows", "void", F.array_join("row_ids", ",").alias("row_ids"))


def rollup_summary(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.rollup_summary(division_rollup_voids(spark, sf).withColumnRenamed("division", "division_key"))


def evidence_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations touch the depths that their turns stand for."""
    points = read(spark, sf, "conversations").select("conv_id", F.get(F.array(*[F.lit(d) for d in overlay.DEPTHS]), (F.col("turn") % 6).cast("int")).alias("depth"), F.when(F.col("role") == "user", "RATIFIED_MAPPING").otherwise("PROPOSED").alias("status"))
    proven = overlay.deepest(points, "conv_id", "depth", "status", overlay.PAINTING, "evidence_depth")
    return proven.join(overlay.deepest(points, "conv_id", "depth", "status", ("PROPOSED", "PENDING"), "candidate_depth"), "conv_id")


def judge_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Users are cases; clicks and errors of five days of the week are two judges' sheets of five families."""
    e = read(spark, sf, "events").select("user_id", "event_id", "value", F.when(F.col("event_id") % 2 == 0, "first").otherwise("second").alias("assessor"), (F.floor(F.col("event_id") / 2) % 5).alias("family"))
    one = e.groupBy("user_id", "assessor", "family").agg(F.max("value").alias("v"))
    sheets = one.select("user_id", "assessor", F.col("family").cast("string").alias("family"), F.when(F.col("v") > 60, "PASS").when(F.col("v") > 40, "NOT_APPLICABLE").otherwise("FAIL").alias("verdict"), F.when(F.col("user_id") % 3 == 0, "FAIL").otherwise("PASS").alias("promotion"))
    return overlay.judged(sheets, "user_id", [str(k) for k in range(5)], ("first", "second"))


def judge_agreed(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return overlay.agreed(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"])


def unresolved_references(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, F.col("doc_id") % 60).alias("item_id"))
    got = overlay.unresolved(rows, {"item_id": (read(spark, sf, "benchmark"), "item_id"), "doc_id": (read(spark, sf, "documents").where("doc_id % 11 <> 0"), "doc_id")})
    return got.select("doc_id", F.array_join("problems", ",").alias("problems"))


def partition_problems(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return overlay.partition_problems(read(spark, sf, "labels").select("doc_id").union(docs.where("doc_id % 50 = 0").select("doc_id")), docs, "doc_id")


def generations(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select(F.concat_ws(":", "source", "lang").alias("key"), "doc_id")
    got = overlay.generations(docs.where("doc_id % 4 < 2"), docs.where("doc_id % 4 >= 2 AND source <> 'src1'"), "key")
    return got.select("key", F.array_join("bindings", ",").alias("bindings"), "historical")


def catalogue_definitions(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part")
    return catalogue.definitions(part.select(F.col("p_brand").alias("division_key")).distinct(), part.select(F.lit("task").alias("kind"), F.col("p_brand").alias("division_key"), F.col("p_type").alias("label")))


def release_check(spark: SparkSession, sf: str) -> DataFrame:
    files = read(spark, sf, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".json")).alias("path"), F.col("html").cast("binary").alias("content"))
    manifest = catalogue.described(files).withColumn("size", F.when(F.crc32(F.col("path").cast("binary")) % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("sha256", F.when(F.crc32(F.col("path").cast("binary")) % 11 == 0, F.lit("0" * 64)).otherwise(F.col("sha256")))
    return catalogue.release_problems(manifest, files.where(F.crc32(F.col("path").cast("binary")) % 13 != 0))


QUERIES = {f.__name__: f for f in (
    ledger_worst_status, corroboration_summary, ledger_missing, ledger_extend, grid_join, grid_axes, ledger_problems, admission_filter, arith_mismatch, hash_chain, hash_chain_broken, ledger_supersede, ledger_dangling, manifest_diff,
    hierarchy_ancestors, division_rollup_voids, rollup_summary, evidence_depth, judge_verdicts, judge_agreed, unresolved_references, partition_problems, generations, catalogue_definitions, release_check,
)}

CLAIMS = """WITH claims AS (SELECT source AS division_key, CASE lang WHEN 'en' THEN 'A1' WHEN 'fr' THEN 'A2' WHEN 'de' THEN 'A3' ELSE 'A4' END AS anchor_type, doc_id AS anchor_text FROM documents),
ledger AS (SELECT c.*, CASE WHEN quality = 1 AND toxic = 0 THEN 'VERIFIED' WHEN quality = 1 THEN 'PARTIAL' WHEN toxic = 1 THEN 'REFUTED' ELSE 'UNVERIFIED' END AS status FROM labels l JOIN claims c ON l.doc_id = c.anchor_text),
worst AS (SELECT division_key, anchor_type, anchor_text, min(CASE status WHEN 'REFUTED' THEN 0 WHEN 'UNVERIFIED' THEN 1 WHEN 'PARTIAL' THEN 2 ELSE 3 END) AS w FROM ledger GROUP BY ALL),
checked AS (SELECT c.*, coalesce(['REFUTED', 'UNVERIFIED', 'PARTIAL', 'VERIFIED'][w + 1], 'MISSING') AS status FROM claims c LEFT JOIN worst USING (division_key, anchor_type, anchor_text))"""
COUNTS = ", ".join(f"count(*) FILTER (anchor_type = '{k}' AND status = '{s}') AS {k.lower()}_{s.lower()}" for k in KINDS for s in (*ledger.STATUSES, "MISSING"))
SUMMARY = CLAIMS + f""", counted AS (SELECT division_key, {COUNTS}, min(CASE WHEN anchor_type = 'A4' THEN CASE status WHEN 'REFUTED' THEN 0 WHEN 'PARTIAL' THEN 2 WHEN 'VERIFIED' THEN 3 ELSE 1 END END) AS l,
  max(CASE WHEN anchor_type = 'A4' AND status = 'MISSING' THEN 1 END) AS gone FROM checked GROUP BY division_key),
told AS (SELECT * EXCLUDE (l, gone), CASE WHEN gone IS NOT NULL OR l IS NULL THEN 'MISSING' ELSE ['REFUTED', 'UNVERIFIED', 'PARTIAL', 'VERIFIED'][l + 1] END AS last_status,
  ((a1_verified > 0)::INT + (a2_verified > 0)::INT + (a3_verified > 0)::INT) AS verified_types,
  ((a1_verified + a1_unverified + a1_partial + a1_missing > 0)::INT + (a2_verified + a2_unverified + a2_partial + a2_missing > 0)::INT + (a3_verified + a3_unverified + a3_partial + a3_missing > 0)::INT) AS non_refuted_types FROM counted),
summed AS (SELECT *, a1_unverified + a1_missing + a2_unverified + a2_missing + a3_unverified + a3_missing + (last_status IN ('UNVERIFIED', 'MISSING'))::INT AS unverified_count FROM told),
summary AS (SELECT *, verified_types >= 2 AND last_status = 'VERIFIED' AND unverified_count = 0 AS publishable, non_refuted_types < 2 OR last_status = 'REFUTED' AS rejected_post FROM summed)"""
LINES = """WITH lines AS (SELECT user_id, event_id, sha256(event_id::VARCHAR || '|' || event_type || '|' || props) AS line_hash FROM events),
chained AS (SELECT *, coalesce(lag(line_hash) OVER (PARTITION BY user_id ORDER BY event_id), repeat('0', 64)) AS prev_hash FROM lines)"""
CORRECTIONS = """WITH c AS (SELECT event_id, event_type, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN event_id - 10 WHEN event_id % 1001 = 7 THEN event_id + 5 END AS replaces FROM events)"""
ROLLUP = """WITH r AS (SELECT l_partkey, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS row_id, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' AND o_orderstatus = 'F' AND l_linestatus = 'F'),
rolled AS (SELECT p_partkey AS division, coalesce(sum(w), 0) AS saturation, count(row_id) AS painted_rows, count(row_id) = 0 AS void, coalesce(string_agg(row_id, ',' ORDER BY row_id), '') AS row_ids FROM part LEFT JOIN (SELECT * FROM r WHERE w > 0) ON l_partkey = p_partkey GROUP BY p_partkey)"""
DEPTH_LIST = "['none', 'division', 'function_concept', 'task_concept', 'terminal_task', 'control_point']"
SQL = {
    "ledger_worst_status": CLAIMS + " SELECT * FROM checked",
    "corroboration_summary": SUMMARY + " SELECT * FROM summary",
    "ledger_missing": CLAIMS + " SELECT * FROM claims c ANTI JOIN ledger l ON c.division_key = l.division_key AND c.anchor_type = l.anchor_type AND c.anchor_text = l.anchor_text",
    "ledger_extend": CLAIMS + " SELECT division_key, anchor_type, anchor_text, status FROM ledger UNION ALL SELECT DISTINCT c.*, 'UNVERIFIED' FROM claims c ANTI JOIN ledger l ON c.division_key = l.division_key AND c.anchor_type = l.anchor_type AND c.anchor_text = l.anchor_text",
    "grid_join": SUMMARY + """, tiers AS (SELECT source AS division_key, count(DISTINCT lang) AS model_support, CASE WHEN count(DISTINCT lang) >= 4 THEN 'STRONG' ELSE 'MODERATE' END AS consensus_tier FROM documents GROUP BY source)
SELECT t.division_key, model_support, consensus_tier, CASE WHEN rejected_post THEN 'REJECTED_POST_CORROBORATION' ELSE consensus_tier END AS tier, coalesce(publishable, false) AS corroborated, coalesce(verified_types, 0) AS verified_types FROM tiers t LEFT JOIN summary s USING (division_key)""",
    "grid_axes": "SELECT axis, string_agg(v, ',' ORDER BY v) AS values FROM (SELECT DISTINCT 'lang' AS axis, lang AS v FROM documents UNION ALL SELECT DISTINCT 'source', source FROM documents) WHERE v IS NOT NULL GROUP BY axis",
    "ledger_problems": CLAIMS + """, l AS (SELECT anchor_text, CASE WHEN anchor_text % 31 = 0 THEN 'DONE' ELSE status END AS status, anchor_text % 7 <> 0 AS named FROM ledger)
SELECT anchor_text, CASE WHEN status = 'DONE' THEN 'status' ELSE 'checked_by' END AS problems FROM l WHERE status = 'DONE' OR (status = 'VERIFIED' AND NOT named)""",
    "admission_filter": """WITH p AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS a, (min(l_extendedprice) + max(l_extendedprice)) / 2 * max(l_discount) AS v, count(DISTINCT l_partkey) AS t FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, a >= 2 AND v >= 2500 AND t >= 3 AS admitted, concat_ws(',', CASE WHEN a < 2 THEN 'R_ANCHORS_LT2' END, CASE WHEN v < 2500 THEN 'R_SEAT_BELOW_THRESHOLD' END, CASE WHEN t < 3 THEN 'R_TERMINALITY_LT3' END) AS reasons FROM p""",
    "arith_mismatch": """WITH v AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN value = 0 THEN o_totalprice <> 0 ELSE abs(o_totalprice - value) / abs(value) > 0.05 END AS mismatch FROM v JOIN orders ON l_orderkey = o_orderkey""",
    "hash_chain": LINES + " SELECT * FROM chained",
    "hash_chain_broken": LINES + " SELECT user_id, event_id FROM chained WHERE event_id % 97 = 0 AND prev_hash <> repeat('0', 64)",
    "ledger_supersede": CORRECTIONS + " SELECT event_id, event_type FROM c ANTI JOIN (SELECT replaces FROM c WHERE replaces IS NOT NULL) r ON c.event_id = r.replaces",
    "ledger_dangling": CORRECTIONS + " SELECT c.event_id, c.replaces FROM c LEFT JOIN c e ON e.event_id = c.replaces WHERE c.replaces IS NOT NULL AND (e.event_id IS NULL OR e.event_id >= c.event_id)",
    "manifest_diff": """WITH o AS (SELECT DISTINCT sha256(text) AS doc FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT DISTINCT sha256(text) AS doc FROM documents WHERE doc_id % 5 <> 0)
SELECT doc, 'added' AS change FROM n ANTI JOIN o USING (doc) UNION ALL SELECT doc, 'removed' FROM o ANTI JOIN n USING (doc)""",
    "hierarchy_ancestors": """WITH RECURSIVE nodes AS (SELECT c_custkey AS id, CASE WHEN c_custkey = 3 THEN 13 WHEN c_custkey BETWEEN 14 AND 100 THEN c_custkey - 1 WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent FROM customer),
paths AS (SELECT id AS child, parent AS ancestor FROM nodes WHERE parent IS NOT NULL UNION SELECT p.child, n.parent FROM paths p JOIN nodes n ON p.ancestor = n.id WHERE n.parent IS NOT NULL AND p.child <> p.ancestor)
SELECT child, ancestor, child = ancestor AS cycle FROM paths""",
    "division_rollup_voids": ROLLUP + " SELECT * FROM rolled",
    "rollup_summary": ROLLUP + " SELECT count(*) AS admitted, count(*) FILTER (NOT void) AS painted, count(*) FILTER (void) AS voids, sum(painted_rows) AS painted_rows, max(saturation) AS max_saturation FROM rolled",
    "evidence_depth": f"""SELECT conv_id, {DEPTH_LIST}[1 + coalesce(max(turn % 6) FILTER (role = 'user'), 0)] AS evidence_depth, {DEPTH_LIST}[1 + coalesce(max(turn % 6) FILTER (role <> 'user'), 0)] AS candidate_depth FROM conversations GROUP BY conv_id""",
    "judge_verdicts": """WITH one AS (SELECT user_id, event_id % 2 AS a, (event_id // 2) % 5 AS f, max(value) AS v FROM events GROUP BY ALL),
s AS (SELECT user_id, a, count(*) AS n, bool_and(v > 40) AS ok FROM one GROUP BY ALL), c AS (SELECT user_id, count(*) AS sheets, bool_and(n = 5) AS complete, bool_and(ok) AS ok FROM s GROUP BY user_id)
SELECT user_id, CASE WHEN sheets < 2 OR NOT complete THEN 'FAIL' WHEN ok AND user_id % 3 <> 0 THEN 'PASS' WHEN user_id % 3 = 0 THEN 'FAIL' ELSE 'UNCERTAIN' END AS verdict FROM c""",
    "judge_agreed": "SELECT user_id, event_type FROM events WHERE event_id % 2 = 0 INTERSECT SELECT user_id, event_type FROM events WHERE event_id % 2 = 1",
    "unresolved_references": """WITH r AS (SELECT doc_id, CASE WHEN quality = 1 THEN doc_id % 60 END AS item_id FROM labels),
f AS (SELECT r.doc_id, CASE WHEN r.item_id IS NOT NULL AND b.item_id IS NULL THEN 'unknown item_id' END AS x, CASE WHEN r.doc_id IS NOT NULL AND d.doc_id IS NULL THEN 'unknown doc_id' END AS y
  FROM r LEFT JOIN benchmark b ON r.item_id = b.item_id LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 11 <> 0) d ON r.doc_id = d.doc_id)
SELECT doc_id, concat_ws(',', x, y) AS problems FROM f WHERE x IS NOT NULL OR y IS NOT NULL""",
    "partition_problems": """WITH m AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents WHERE doc_id % 50 = 0), c AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id)
SELECT coalesce(c.doc_id, d.doc_id) AS doc_id, coalesce(n, 0) AS n FROM c FULL JOIN documents d ON c.doc_id = d.doc_id WHERE n IS NULL OR n <> 1 OR d.doc_id IS NULL""",
    "generations": """WITH b AS (SELECT DISTINCT source || ':' || lang AS key, 'older' AS g FROM documents WHERE doc_id % 4 < 2 UNION SELECT DISTINCT source || ':' || lang, 'newer' FROM documents WHERE doc_id % 4 >= 2 AND source <> 'src1')
SELECT key, string_agg(g, ',' ORDER BY g) AS bindings, count(*) FILTER (g = 'newer') = 0 AS historical FROM b GROUP BY key""",
    "catalogue_definitions": """WITH d AS (SELECT DISTINCT 'division' AS kind, p_brand AS division_key, p_brand AS label FROM part UNION SELECT DISTINCT 'task', p_brand, p_type FROM part)
SELECT *, kind || ':' || division_key || ':' || substr(sha256('["' || kind || '","' || division_key || '","' || label || '"]'), 1, 24) AS reference_id FROM d""",
}
