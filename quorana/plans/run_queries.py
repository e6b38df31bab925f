"""Run records over the order tables, through the whole panel pipeline and its gates.

A model is a customer's nation, a vendor its region, a sample an order, a division a line item of
it. The responses are JSON text; some are cut short, lack fields, reject nothing, name a division
before its anchors or speak of themselves, and the stored tables were edited in places.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorana.functions.text import slug_key
from quorana.operators import panel_gates as G
from quorana.operators import runs as R
from quorana.tables import read
from quorana.workdir import Scratch

PATTERNS = ("(?i)as an ai", "(?i)my training")
PROMPT, THRESHOLD = "List divisions of {CURRENCY} desks. Do not rate yourself: as an AI.", 9000.0
ALLOWED = ("as an AI",)


def _order() -> Column:
    """The order that a sample is."""
    return F.col("o_orderkey")


def _division() -> Column:
    """One line item as a division of a response."""
    f, tasks = F.col, F.transform(F.sequence(F.lit(1), (2 + F.col("l_partkey") % 3).cast("int")), lambda i: F.struct(F.concat(F.col("p_type"), F.lit(" task "), i.cast("string")).alias("task")))
    middle = f("q") * 1500 * (f("q") % 4) * 0.25
    return F.struct(
        F.when(f("l_returnflag") != "R", F.array(F.struct(f("l_returnflag").alias("regime"), f("l_linestatus").alias("jurisdiction"), F.concat(F.lit("Rule "), f("p_brand")).alias("citation")))).alias("a1_regulatory"),
        F.when(f("l_discount") > 0.02, F.array(F.struct(F.concat(F.lit("Bank "), f("p_brand")).alias("bank"), F.lit("10-K").alias("filing"), F.year("l_shipdate").alias("fiscal_year"), f("p_type").alias("line_item")))).alias("a2_segment"),
        F.when(f("l_tax") > 0.03, F.array(F.struct(f("p_brand").alias("publisher"), f("p_type").alias("series"), f("p_size").alias("value"), F.lit("USD").alias("unit"), F.date_format("l_shipdate", "yyyy-MM").alias("as_of")))).alias("a3_market_size"),
        F.struct(
            f("p_name").alias("function"), F.array(f("q") * 1000, f("q") * 2000).alias("cost_per_seat"), ((f("q") % 4) * 0.25).alias("determinable_fraction"),
            F.when(f("l_partkey") % 11 == 0, middle * 2).otherwise(middle).alias("addressable_seat_cost"), tasks.alias("terminality"),
        ).alias("a4_seat"),
        F.concat(F.lit("The "), f("p_type"), F.lit(" Desk, "), f("p_brand")).alias("name"),
        F.struct(
            f("p_type").alias("business_line"), F.when(f("l_linenumber") % 3 != 0, f("l_linestatus")).alias("side"), F.array(f("l_returnflag")).alias("region"),
            F.when(f("l_linenumber") % 2 == 0, F.array(f("l_linestatus"), f("l_returnflag"))).alias("product"), f("l_returnflag").alias("office"),
        ).alias("axis"),
        F.lit(0.5).alias("confidence"),
    )


def records(spark: SparkSession, sf: str) -> DataFrame:
    """The run records."""
    li = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("q", F.col("l_quantity").cast("int"))
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", _division().alias("d"))
    per = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["d"]).alias("divisions"))
    kind = dict(per.dtypes)["divisions"]
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    note = F.when(_order() % 37 == 0, "as an AI I cannot").otherwise("")
    rejected = F.when(_order() % 23 == 0, F.array().cast("array<struct<name: string, reason_codes: array<string>, note: string>>")).otherwise(F.array(F.struct(F.lit("x").alias("name"), F.array(F.lit("R_ANCHORS_LT2")).alias("reason_codes"), note.alias("note"))))
    text = F.to_json(F.struct(F.coalesce("divisions", F.array().cast(kind)).alias("divisions"), rejected.alias("rejected")), {"ignoreNullFields": "false"})
    faulty = (
        F.when(_order() % 41 == 0, F.lit(None)).when(_order() % 29 == 0, F.substr(text, F.lit(1), F.lit(60))).when(_order() % 31 == 0, F.replace(text, F.lit('"a1_regulatory"'), F.lit('"b1_regulatory"')))
        .when(_order() % 47 == 0, F.replace(text, F.lit('"cost_per_seat"'), F.lit('"cost"'))).otherwise(text)
    )
    got = o.join(per, _order() == F.col("l_orderkey"), "left").select(
        F.col("n_name").alias("model_id"), F.concat(F.lit("V"), F.col("n_regionkey").cast("string")).alias("vendor"), _order().alias("sample_idx"), F.when(_order() % 41 == 0, "ERROR").otherwise("OK").alias("status"), faulty.alias("response_raw"),
        F.when(_order() % 19 == 3, F.lit("other")).otherwise(F.sha2(F.lit(PROMPT), 256)).alias("prompt_sha256"), F.create_map(F.lit("temperature"), F.lit(0.0), F.lit("top_p"), F.lit(1.0), F.lit("max_tokens"), F.lit(64.0), F.when(_order() % 67 == 5, "salt").otherwise("seed"), F.lit(7.0)).alias("params"),
        F.struct(F.lit(False).alias("tools"), (_order() % 71 == 9).alias("browsing"), F.lit(False).alias("retrieval"), F.when(_order() % 73 != 11, F.lit(0)).alias("prior_turns"), F.lit(True).alias("provider_cold_guarantee")).alias("cold"),
    )
    return got.withColumn("response_sha256", F.when(F.col("sample_idx") % 43 == 0, F.sha2(F.concat("response_raw", F.lit(" ")), 256)).otherwise(F.sha2("response_raw", 256)))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """The assessed records, written once per query: each step after it reads the parsed responses."""
    return Scratch(spark, "samples").write(R.assessed(records(spark, sf), PATTERNS), "samples")


def alias_table(spark: SparkSession, sf: str) -> DataFrame:
    """(canon, key): types and brands, the first two brands as one; brands that end in 4 have none."""
    names = read(spark, sf, "part").select("p_type", "p_brand").distinct()
    n = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    rows = names.select(F.concat(F.lower("p_type"), F.lit(" brand "), n.cast("string")).alias("canon"), slug_key(F.concat("p_type", F.lit(" "), F.greatest(n, F.lit(2)).cast("string"))).alias("key"))
    return rows.where(~F.col("canon").endswith("4"))


def divs(spark: SparkSession, sf: str, assessed: DataFrame | None = None) -> DataFrame:
    """The divisions with their keys, written once per query."""
    found = R.divisions(samples(spark, sf) if assessed is None else assessed, THRESHOLD, accents=False)
    return Scratch(spark, "divisions").write(R.keyed(found, alias_table(spark, sf)), "divisions")


def stored_samples(assessed: DataFrame) -> DataFrame:
    """The stored sample table, in which every third sample was marked VALID by hand."""
    rows = assessed.select("model_id", "sample_idx", "sample_status", "reasons")
    edited = F.col("sample_idx") % 3 == 0
    return rows.withColumn("sample_status", F.when(edited, "VALID").otherwise(F.col("sample_status"))).withColumn("reasons", F.when(edited, F.array().cast("array<string>")).otherwise(F.col("reasons")))


def run_samples(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).select("model_id", "sample_idx", "sample_status", F.array_join("reasons", ",").alias("reasons"))


def run_divisions(spark: SparkSession, sf: str) -> DataFrame:
    return divs(spark, sf).select("sample_idx", "index", "canon", "division_key", "recomputed", "arith_mismatch", "admitted", F.array_join("reasons", ",").alias("reasons"))


def unaliased_names(spark: SparkSession, sf: str) -> DataFrame:
    return R.unaliased(divs(spark, sf))


def excluded(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "nation").where("n_nationkey % 7 = 3").select(F.col("n_name").alias("model_id"), F.when(F.col("n_nationkey") != 10, "too few answers").otherwise(" ").alias("reason"))


def run_cells(spark: SparkSession, sf: str) -> DataFrame:
    found = samples(spark, sf)
    return R.matrix(divs(spark, sf, found), found, excluded(spark, sf))[0]


def run_matrix(spark: SparkSession, sf: str) -> DataFrame:
    found = samples(spark, sf)
    return R.matrix(divs(spark, sf, found), found, excluded(spark, sf))[1]


def run_axis_votes(spark: SparkSession, sf: str) -> DataFrame:
    return R.axis_votes(divs(spark, sf))


def anchor_pool(spark: SparkSession, sf: str) -> DataFrame:
    return R.anchor_pool(divs(spark, sf), accents=False)


def seat_texts(spark: SparkSession, sf: str) -> DataFrame:
    return R.seat_text(R.seat_pool(divs(spark, sf), accents=False))


def _ledger(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """What is expected, and the ledger: most rows checked, some partial, refuted, unsigned or left out."""
    found = divs(spark, sf)
    expected = Scratch(spark, "expected").write(R.expected_rows(R.anchor_pool(found, accents=False), R.seat_pool(found, accents=False)), "expected")
    h = F.conv(F.substr(F.md5("anchor_text"), F.lit(1), F.lit(4)), 16, 10).cast("int")
    status = F.when(h % 17 == 0, "REFUTED").when(h % 13 == 0, "PARTIAL").when(h % 29 == 0, "UNVERIFIED").when(h % 97 == 0, "MAYBE").otherwise("VERIFIED")
    rows = expected.where(h % 31 != 0).withColumn("status", status).withColumn("checked_by", F.when(h % 19 == 1, " ").otherwise("ann"))
    return expected, rows


def corroboration_problems(spark: SparkSession, sf: str) -> DataFrame:
    return G.corroboration(*_ledger(spark, sf))


def prompt_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The prompts that were sent, one per language, and the benchmark's items as further ones."""
    own = spark.createDataFrame([("prompt", PROMPT), ("system", "Answer as desks do; my training is no topic.")], "name string, text string")
    return own.unionByName(read(spark, sf, "benchmark").select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("name"), "text"))


def gate_contamination(spark: SparkSession, sf: str) -> DataFrame:
    hashed = read(spark, sf, "benchmark").where("item_id < 3").select(F.sha2(F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), F.lit(1), F.lit(2)), " "), 256).alias("digest"))
    return G.contamination(records(spark, sf), prompt_texts(spark, sf), ("desks", "the", "un"), hashed, ALLOWED, sha256(PROMPT.encode()).hexdigest())


def gate_schema(spark: SparkSession, sf: str) -> DataFrame:
    found = samples(spark, sf)
    return G.schema(found, stored_samples(found))


def gate_order(spark: SparkSession, sf: str) -> DataFrame:
    found = samples(spark, sf)
    return G.order(found, stored_samples(found))


def gate_rejection(spark: SparkSession, sf: str) -> DataFrame:
    found = samples(spark, sf)
    return G.rejection(found, stored_samples(found))


def gate_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Stored divisions of which some were admitted by hand, some have another value, and some are gone."""
    found = samples(spark, sf)
    d, k = divs(spark, sf, found), F.col("sample_idx")
    stored = d.where(~((k % 59 == 2) & (F.col("index") == 0))).withColumn("admitted", F.when(k % 17 == 1, True).otherwise(F.col("admitted"))).withColumn("recomputed", F.when(k % 61 == 4, F.col("recomputed") + 1).otherwise(F.col("recomputed")))
    return G.admission(d, found.select("model_id", "sample_idx", "sample_status"), stored)


def gate_corroboration(spark: SparkSession, sf: str) -> DataFrame:
    return corroboration_problems(spark, sf)


def gate_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of the matrix against an alias table that has lost one type since."""
    table = alias_table(spark, sf).where("key NOT LIKE 'promo%'")
    return G.aliases(table, divs(spark, sf).where("admitted AND division_key IS NOT NULL"), F.sha2(F.lit("table now"), 256), F.sha2(F.lit("table now"), 256), F.sha2(F.lit("table then"), 256))


def gate_self_assessment(spark: SparkSession, sf: str) -> DataFrame:
    found = samples(spark, sf)
    return G.self_assessment(found, stored_samples(found), prompt_texts(spark, sf), PATTERNS, ALLOWED)


def gate_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The stored cells, of which some were raised, one model's were dropped and one was added, against a replay."""
    again = Scratch(spark, "replay").write(run_cells(spark, sf), "cells")
    stored = again.where("rater <> 'NATION_7'").withColumn("cell", F.when(F.col("rater").isin("NATION_1", "NATION_2"), F.col("cell") + 0.25).otherwise(F.col("cell")))
    stored = stored.unionByName(again.where("rater = 'NATION_3'").withColumn("rater", F.lit("NOBODY")))
    return G.replay(again, stored)


def gate_panel(spark: SparkSession, sf: str) -> DataFrame:
    """With a model that has one sample, and exclusions of which one has no reason and one no model."""
    runs = samples(spark, sf)
    lone = runs.where("sample_idx = 1").withColumn("model_id", F.lit("LONE"))
    barred = excluded(spark, sf).unionByName(spark.createDataFrame([("GHOST", "never ran")], "model_id string, reason string"))
    return G.panel(runs.unionByName(lone), stored_samples(runs), barred)


QUERIES = {f.__name__: f for f in (
    run_samples, run_divisions, unaliased_names, run_cells, run_matrix, run_axis_votes, anchor_pool, seat_texts, gate_contamination, gate_schema, gate_order, gate_rejection, gate_admission, gate_corroboration, gate_aliases,
    gate_self_assessment, gate_replay, gate_panel,
)}

NOTE = "STRUCT(name VARCHAR, reason_codes VARCHAR[], note VARCHAR)[]"
RUNS = f"""WITH li AS (SELECT *, l_quantity::INT AS q FROM lineitem JOIN part ON l_partkey = p_partkey),
dv AS (SELECT l_orderkey, list({{
  'a1_regulatory': CASE WHEN l_returnflag <> 'R' THEN [{{'regime': l_returnflag, 'jurisdiction': l_linestatus, 'citation': 'Rule ' || p_brand}}] END,
  'a2_segment': CASE WHEN l_discount > 0.02 THEN [{{'bank': 'Bank ' || p_brand, 'filing': '10-K', 'fiscal_year': year(l_shipdate), 'line_item': p_type}}] END,
  'a3_market_size': CASE WHEN l_tax > 0.03 THEN [{{'publisher': p_brand, 'series': p_type, 'value': p_size, 'unit': 'USD', 'as_of': strftime(l_shipdate, '%Y-%m')}}] END,
  'a4_seat': {{'function': p_name, 'cost_per_seat': [q * 1000, q * 2000], 'determinable_fraction': (q % 4) * 0.25::DOUBLE, 'addressable_seat_cost': q * 1500 * (q % 4) * 0.25::DOUBLE * CASE WHEN l_partkey % 11 = 0 THEN 2 ELSE 1 END,
    'terminality': list_transform(range(1, 3 + (l_partkey % 3)::INT), lambda i: {{'task': p_type || ' task ' || i}})}},
  'name': 'The ' || p_type || ' Desk, ' || p_brand,
  'axis': {{'business_line': p_type, 'side': CASE WHEN l_linenumber % 3 <> 0 THEN l_linestatus END, 'region': [l_returnflag], 'product': CASE WHEN l_linenumber % 2 = 0 THEN [l_linestatus, l_returnflag] END, 'office': l_returnflag}},
  'confidence': 0.5}} ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS divisions FROM li GROUP BY l_orderkey),
j AS (SELECT o_orderkey AS k, n_name AS model_id, 'V' || n_regionkey AS vendor, to_json({{'divisions': coalesce(divisions, []), 'rejected': CASE WHEN o_orderkey % 23 = 0 THEN []::{NOTE}
  ELSE [{{'name': 'x', 'reason_codes': ['R_ANCHORS_LT2'], 'note': CASE WHEN o_orderkey % 37 = 0 THEN 'as an AI I cannot' ELSE '' END}}]::{NOTE} END}})::VARCHAR AS t
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN dv ON o_orderkey = l_orderkey),
w AS (SELECT k, model_id, vendor, CASE WHEN k % 41 = 0 THEN 'ERROR' ELSE 'OK' END AS status, CASE WHEN k % 41 = 0 THEN NULL WHEN k % 29 = 0 THEN left(t, 60) WHEN k % 31 = 0 THEN replace(t, '"a1_regulatory"', '"b1_regulatory"')
  WHEN k % 47 = 0 THEN replace(t, '"cost_per_seat"', '"cost"') ELSE t END AS raw FROM j),
runs AS (SELECT *, CASE WHEN k % 43 = 0 THEN sha256(raw || ' ') ELSE sha256(raw) END AS sha, CASE WHEN k % 19 = 3 THEN 'other' ELSE sha256('{PROMPT}') END AS prompt_sha FROM w),
a1 AS (SELECT *, coalesce(json_valid(raw), false) AS parses FROM runs),
a2 AS (SELECT *, CASE WHEN parses THEN json_extract(raw, '$.divisions[*]') END AS ds, CASE WHEN parses THEN json_array_length(raw, '$.rejected') END AS n_rejected, coalesce(regexp_matches(raw, '(?i)as an ai|my training'), false) AS hit FROM a1),
a3 AS (SELECT *, coalesce(len(ds) > 0 AND len(list_filter(ds, lambda d: json_array_length(d, '$.a4_seat.cost_per_seat') = 2 AND (d->>'$.a4_seat.determinable_fraction')::DOUBLE BETWEEN 0 AND 1 AND d->>'$.name' <> '')) = len(ds), false) AS schema_ok,
  coalesce(len(ds) > 0 AND len(list_filter(ds, lambda d: coalesce(list_position(json_keys(d), 'a1_regulatory') < list_position(json_keys(d), 'name'), false))) = len(ds), false) AS ordered FROM a2),
smp AS (SELECT *, CASE WHEN status = 'ERROR' THEN ['RUN_ERROR'] WHEN sha <> sha256(raw) THEN ['SHA_MISMATCH'] ELSE list_filter([CASE WHEN NOT parses THEN 'PARSE_ERROR' END, CASE WHEN parses AND NOT schema_ok THEN 'SCHEMA_INVALID' END,
  CASE WHEN schema_ok AND NOT ordered THEN 'ORDER_VIOLATION' END, CASE WHEN parses AND n_rejected < 1 THEN 'REJECTED_EMPTY' END, CASE WHEN hit THEN 'SELF_ASSESSMENT_LANGUAGE' END], lambda x: x IS NOT NULL) END AS reasons FROM a3),
sto AS (SELECT model_id, k, CASE WHEN k % 3 = 0 THEN []::VARCHAR[] ELSE reasons END AS why FROM smp),
d1 AS (SELECT model_id, vendor, k, unnest(ds) AS d, generate_subscripts(ds, 1) - 1 AS idx FROM smp WHERE len(reasons) = 0),
d2 AS (SELECT *, d->>'$.name' AS name, (coalesce(json_array_length(d, '$.a1_regulatory'), 0) > 0)::INT + (coalesce(json_array_length(d, '$.a2_segment'), 0) > 0)::INT + (coalesce(json_array_length(d, '$.a3_market_size'), 0) > 0)::INT AS anchors,
  ((d->>'$.a4_seat.cost_per_seat[0]')::DOUBLE + (d->>'$.a4_seat.cost_per_seat[1]')::DOUBLE) / 2 AS middle, (d->>'$.a4_seat.determinable_fraction')::DOUBLE AS fraction, (d->>'$.a4_seat.addressable_seat_cost')::DOUBLE AS claimed, json_array_length(d, '$.a4_seat.terminality') AS tasks FROM d1),
d3 AS (SELECT *, middle * fraction AS value, array_to_string(list_filter(string_split(trim(regexp_replace(lower(name), '[^0-9a-z]+', ' ', 'g')), ' '), lambda x: x NOT IN ('the', 'desk')), ' ') AS canon FROM d2),
al AS (SELECT DISTINCT lower(p_type) || ' brand ' || n AS canon, lower(p_type) || '_' || greatest(n, 2) AS key FROM (SELECT DISTINCT p_type, regexp_extract(p_brand, '([0-9]+)$', 1)::INT AS n FROM part) WHERE n % 10 <> 4),
div AS (SELECT d3.*, al.key, CASE WHEN value = 0 THEN claimed <> 0 ELSE abs(claimed - value) / abs(value) > 0.05 END AS mismatch,
  list_filter([CASE WHEN anchors < 2 THEN 'R_ANCHORS_LT2' END, CASE WHEN value < {THRESHOLD} THEN 'R_SEAT_BELOW_THRESHOLD' END, CASE WHEN tasks < 3 THEN 'R_TERMINALITY_LT3' END], lambda x: x IS NOT NULL) AS why FROM d3 LEFT JOIN al USING (canon)),
adm AS (SELECT * FROM div WHERE len(why) = 0 AND key IS NOT NULL),
ex AS (SELECT n_name AS model_id, CASE WHEN n_nationkey <> 10 THEN 'too few answers' ELSE ' ' END AS reason FROM nation WHERE n_nationkey % 7 = 3)"""
CELLS = RUNS + """, tot AS (SELECT model_id AS rater, count(DISTINCT k) AS k FROM runs GROUP BY 1), keys AS (SELECT DISTINCT key FROM adm WHERE model_id NOT IN (SELECT model_id FROM ex)),
hit AS (SELECT key, model_id AS rater, count(DISTINCT k) AS n FROM adm GROUP BY ALL),
cel AS (SELECT keys.key, tot.rater, coalesce(hit.n, 0) AS n, tot.k, coalesce(round_even(hit.n / tot.k, 6), 0.0) AS cell FROM keys CROSS JOIN tot LEFT JOIN hit ON hit.key = keys.key AND hit.rater = tot.rater)"""
_VOTE = """(SELECT key, CASE WHEN count(v) = 1 THEN min(v) ELSE '{tie}' END AS {axis} FROM (SELECT key, v, rank() OVER (PARTITION BY key ORDER BY n DESC) AS r FROM (SELECT key, d->>'$.axis.{axis}' AS v, count(d->>'$.axis.{axis}') AS n FROM adm GROUP BY ALL)) WHERE r = 1 GROUP BY key)"""
_LIST = """(SELECT t.key, coalesce(string_agg(v, ',' ORDER BY v), '{tie}') AS {axis} FROM (SELECT key, count(*) AS n FROM adm GROUP BY key) t LEFT JOIN (SELECT key, v, count(*) AS c FROM (SELECT key, unnest(list_distinct(json_extract_string(d, '$.axis.{axis}[*]'))) AS v FROM adm) GROUP BY ALL) h ON h.key = t.key AND 2 * h.c > t.n GROUP BY t.key)"""
_CANON = "array_to_string(list_filter(string_split(trim(regexp_replace(lower({0}), '[^0-9a-z]+', ' ', 'g')), ' '), lambda x: x <> ''), ' ')"
POOL = RUNS + """, anc AS (SELECT key, model_id, k, idx, 'A1' AS kind, generate_subscripts(x, 1) AS pos, unnest(x) AS a FROM (SELECT *, json_extract(d, '$.a1_regulatory[*]') AS x FROM adm)
UNION ALL SELECT key, model_id, k, idx, 'A2', generate_subscripts(x, 1), unnest(x) FROM (SELECT *, json_extract(d, '$.a2_segment[*]') AS x FROM adm) UNION ALL SELECT key, model_id, k, idx, 'A3', generate_subscripts(x, 1), unnest(x) FROM (SELECT *, json_extract(d, '$.a3_market_size[*]') AS x FROM adm)),
txt AS (SELECT *, CASE kind WHEN 'A1' THEN (a->>'regime') || ' | ' || (a->>'jurisdiction') || ' | ' || (a->>'citation') WHEN 'A2' THEN (a->>'bank') || ' | ' || (a->>'filing') || ' | FY' || (a->>'fiscal_year') || ' | ' || (a->>'line_item')
  ELSE (a->>'publisher') || ' | ' || (a->>'series') || ' | ' || (a->>'value') || ' ' || (a->>'unit') || ' | as_of ' || (a->>'as_of') END AS anchor_text,
  CASE kind WHEN 'A1' THEN """ + _CANON.format("a->>'citation'") + " WHEN 'A2' THEN " + _CANON.format("(a->>'bank') || ' ' || (a->>'filing') || ' ' || (a->>'fiscal_year') || ' ' || (a->>'line_item')") + " ELSE " + _CANON.format("(a->>'publisher') || ' ' || (a->>'series') || ' ' || (a->>'as_of')") + """ END AS dedupe FROM anc),
pool AS (SELECT key AS division_key, kind AS anchor_type, dedupe, anchor_text FROM txt QUALIFY row_number() OVER (PARTITION BY key, kind, dedupe ORDER BY model_id, k, idx, pos) = 1),
tsk AS (SELECT key, count(DISTINCT lower(t)) AS n FROM (SELECT key, unnest(json_extract_string(d, '$.a4_seat.terminality[*].task')) AS t FROM adm) GROUP BY key),
seat AS (SELECT adm.key AS division_key, 'A4' AS anchor_type, 'SEAT: ' || string_agg(DISTINCT d->>'$.a4_seat.function', '; ' ORDER BY d->>'$.a4_seat.function') || ' | cost_per_seat midpoint median ' || median(middle) || ' | determinable_fraction median ' || median(fraction) || ' | ' || any_value(tsk.n) || ' terminality tasks' AS anchor_text
  FROM adm JOIN tsk USING (key) GROUP BY adm.key)"""
LEDGER = POOL + """, exp AS (SELECT division_key, anchor_type, anchor_text FROM pool UNION ALL SELECT * FROM seat), hsh AS (SELECT *, ('0x' || left(md5(anchor_text), 4))::INT AS h FROM exp),
led AS (SELECT division_key, anchor_type, anchor_text, CASE WHEN h % 17 = 0 THEN 'REFUTED' WHEN h % 13 = 0 THEN 'PARTIAL' WHEN h % 29 = 0 THEN 'UNVERIFIED' WHEN h % 97 = 0 THEN 'MAYBE' ELSE 'VERIFIED' END AS status, CASE WHEN h % 19 = 1 THEN ' ' ELSE 'ann' END AS checked_by FROM hsh WHERE h % 31 <> 0),
bad AS (SELECT anchor_text AS subject, concat_ws(',', CASE WHEN status = 'MAYBE' THEN 'status' END, CASE WHEN status = 'VERIFIED' AND trim(checked_by) = '' THEN 'checked_by' END) AS problem FROM led),
wst AS (SELECT exp.division_key, exp.anchor_type, coalesce(min(CASE WHEN status IS NULL THEN 9 WHEN status = 'REFUTED' THEN 0 WHEN status = 'PARTIAL' THEN 2 WHEN status = 'VERIFIED' THEN 3 ELSE 1 END), 9) AS w FROM exp LEFT JOIN (SELECT DISTINCT * FROM led) l USING (division_key, anchor_type, anchor_text) GROUP BY exp.division_key, exp.anchor_type, exp.anchor_text, status IS NULL),
sm AS (SELECT division_key, count(DISTINCT anchor_type) FILTER (w = 3 AND anchor_type <> 'A4') AS verified, count(DISTINCT anchor_type) FILTER (w <> 0 AND anchor_type <> 'A4') AS standing, max(w) FILTER (anchor_type = 'A4') AS a4, count(*) FILTER (w IN (1, 9)) AS open FROM wst GROUP BY division_key)"""
_MARK = "(SELECT why FROM sto WHERE sto.model_id = smp.model_id AND sto.k = smp.k)"
SQL = {
    "run_samples": RUNS + " SELECT model_id, k AS sample_idx, CASE WHEN len(reasons) = 0 THEN 'VALID' ELSE 'INVALID' END AS sample_status, array_to_string(reasons, ',') AS reasons FROM smp",
    "run_divisions": RUNS + " SELECT k AS sample_idx, idx AS index, canon, key AS division_key, value AS recomputed, mismatch AS arith_mismatch, len(why) = 0 AS admitted, array_to_string(why, ',') AS reasons FROM div",
    "unaliased_names": RUNS + " SELECT DISTINCT canon FROM div WHERE len(why) = 0 AND key IS NULL",
    "run_cells": CELLS + " SELECT * FROM cel",
    "run_matrix": CELLS + """, e AS (SELECT * FROM cel WHERE rater NOT IN (SELECT model_id FROM ex)), s AS (SELECT key, count(DISTINCT (model_id, k)) AS n_samples FROM adm WHERE model_id NOT IN (SELECT model_id FROM ex) GROUP BY key)
SELECT key, count(*) FILTER (cell >= 0.5) AS model_support, CASE WHEN count(*) FILTER (cell >= 0.5) >= ceil(0.8 * count(*)) THEN 'STRONG' WHEN count(*) FILTER (cell >= 0.5) >= ceil(0.5 * count(*)) THEN 'MODERATE' ELSE 'WEAK' END AS tier, any_value(n_samples) AS n_samples FROM e JOIN s USING (key) GROUP BY key""",
    "run_axis_votes": RUNS + " SELECT * FROM " + reduce(lambda a, b: f"{a} JOIN {b} USING (key)", [_VOTE.format(axis=a, tie=t) for a, t in R.SCALAR_AXES.items()] + [_LIST.format(axis=a, tie=t) for a, t in R.LIST_AXES.items()]),
    "anchor_pool": POOL + " SELECT * FROM pool",
    "seat_texts": POOL + " SELECT * FROM seat",
    "gate_contamination": RUNS + """, p AS (SELECT 'prompt' AS name, replace('""" + PROMPT + """', 'as an AI', ' ') AS text UNION ALL SELECT 'system', 'Answer as desks do; my training is no topic.' UNION ALL SELECT 'item' || item_id, replace(text, 'as an AI', ' ') FROM benchmark),
x AS (SELECT name, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM p), den AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:2], ' ') AS p FROM benchmark WHERE item_id < 3)
SELECT 'A-G1' AS gate, name AS subject, 'token ' || t AS problem FROM x, (SELECT unnest(['desks', 'the', 'un']) AS t) WHERE list_contains(w, t)
UNION ALL SELECT DISTINCT 'A-G1', name, 'digest ' || left(sha256(p), 8) FROM x, den WHERE list_contains(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), p)
UNION ALL SELECT 'A-G1', model_id || '/' || k, 'other prompt' FROM runs WHERE prompt_sha <> sha256('""" + PROMPT + """')""",
    "gate_schema": RUNS + f""", g AS (SELECT model_id || '/' || k AS subject, CASE WHEN list_contains(reasons, 'SHA_MISMATCH') THEN 'digest' WHEN NOT schema_ok AND len({_MARK}) = 0 THEN 'invalid and unmarked' END AS problem FROM smp WHERE status <> 'ERROR')
SELECT 'A-G2' AS gate, subject, problem FROM g WHERE problem IS NOT NULL""",
    "gate_order": RUNS + f" SELECT 'A-G3' AS gate, model_id || '/' || k AS subject, 'order' AS problem FROM smp WHERE status <> 'ERROR' AND schema_ok AND NOT ordered AND NOT list_contains({_MARK}, 'ORDER_VIOLATION')",
    "gate_rejection": RUNS + f" SELECT 'A-G4' AS gate, model_id || '/' || k AS subject, 'nothing rejected' AS problem FROM smp WHERE status <> 'ERROR' AND parses AND n_rejected < 1 AND NOT list_has_any({_MARK}, ['REJECTED_EMPTY', 'SCHEMA_INVALID'])",
    "gate_admission": RUNS + """, st AS (SELECT model_id, k, idx, len(why) = 0 OR k % 17 = 1 AS admitted, value + CASE WHEN k % 61 = 4 THEN 1 ELSE 0 END AS value FROM div WHERE NOT (k % 59 = 2 AND idx = 0)),
b AS (SELECT coalesce(s.model_id, div.model_id) || '/' || coalesce(s.k, div.k) || '/' || coalesce(s.idx, div.idx) AS subject, CASE WHEN s.k IS NULL THEN 'not stored' WHEN div.k IS NULL THEN 'not in the response' WHEN (len(div.why) = 0) <> s.admitted THEN 'admission' WHEN abs(div.value - s.value) > 1e-6 THEN 'value' END AS problem
  FROM st s FULL JOIN div ON s.model_id = div.model_id AND s.k = div.k AND s.idx = div.idx) SELECT 'A-G5' AS gate, subject, problem FROM b WHERE problem IS NOT NULL""",
    "gate_corroboration": LEDGER + """ SELECT 'A-G6' AS gate, subject, problem FROM bad WHERE problem <> ''
UNION ALL SELECT 'A-G6', division_key, verified || ' types, ' || CASE a4 WHEN 0 THEN 'REFUTED' WHEN 1 THEN 'UNVERIFIED' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'VERIFIED' ELSE 'MISSING' END || ', ' || open || ' open' FROM sm WHERE NOT (standing < 2 OR a4 = 0) AND NOT (verified >= 2 AND a4 = 3 AND open = 0)""",
    "gate_aliases": RUNS + " SELECT DISTINCT 'A-G7' AS gate, key AS subject, 'no alias' AS problem FROM adm WHERE key NOT IN (SELECT key FROM al WHERE key NOT LIKE 'promo%') UNION ALL SELECT 'A-G7', 'aliases', 'digest of the matrix' WHERE sha256('table now') <> sha256('table then')",
    "gate_self_assessment": RUNS + f""", p AS (SELECT 'prompt' AS name, replace('{PROMPT}', 'as an AI', ' ') AS text UNION ALL SELECT 'system', 'Answer as desks do; my training is no topic.' UNION ALL SELECT 'item' || item_id, replace(text, 'as an AI', ' ') FROM benchmark)
SELECT 'A-G8' AS gate, name AS subject, 'asked for' AS problem FROM p WHERE regexp_matches(text, '(?i)as an ai|my training') UNION ALL SELECT 'A-G8', model_id || '/' || k, 'unmarked' FROM smp WHERE status <> 'ERROR' AND hit AND NOT list_contains({_MARK}, 'SELF_ASSESSMENT_LANGUAGE')""",
    "gate_replay": CELLS + """, st AS (SELECT key, rater, cell + CASE WHEN rater IN ('NATION_1', 'NATION_2') THEN 0.25 ELSE 0 END AS cell FROM cel WHERE rater <> 'NATION_7' UNION ALL SELECT key, 'NOBODY', cell FROM cel WHERE rater = 'NATION_3')
SELECT 'A-G9' AS gate, coalesce(cel.key, st.key) || '/' || coalesce(cel.rater, st.rater) AS subject, CASE WHEN st.cell IS NULL THEN 'not stored' WHEN cel.cell IS NULL THEN 'not reproduced' ELSE 'differs' END AS problem
FROM cel FULL JOIN st ON cel.key = st.key AND cel.rater = st.rater WHERE cel.cell IS DISTINCT FROM st.cell""",
    "gate_panel": RUNS + """, rr AS (SELECT model_id, vendor, k FROM runs UNION ALL SELECT 'LONE', vendor, k FROM runs WHERE k = 1), xx AS (SELECT * FROM ex UNION ALL SELECT 'GHOST', 'never ran'),
v AS (SELECT model_id, count(*) AS valid FROM sto WHERE len(why) = 0 GROUP BY 1), m AS (SELECT model_id, min(vendor) AS vendor, count(*) AS k, coalesce(any_value(valid), 0) AS valid FROM rr LEFT JOIN v USING (model_id) GROUP BY 1), c AS (SELECT * FROM m WHERE model_id NOT IN (SELECT model_id FROM xx))
SELECT 'A-G10' AS gate, 'panel' AS subject, n || ' vendors' AS problem FROM (SELECT count(DISTINCT vendor) FILTER (valid >= 3) AS n FROM c) WHERE n < 4 UNION ALL SELECT 'A-G10', model_id, 'few samples' FROM c WHERE k < 3 UNION ALL SELECT 'A-G10', model_id, 'few valid samples' FROM c WHERE valid < 3
UNION ALL SELECT 'A-G10', model_id || '/' || k, 'not cold' FROM rr WHERE k % 71 = 9 OR k % 73 = 11 UNION ALL SELECT 'A-G10', model_id || '/' || k, 'lacks seed' FROM rr WHERE k % 67 = 5
UNION ALL SELECT 'A-G10', model_id, 'exclusion' FROM xx WHERE model_id NOT IN (SELECT model_id FROM rr) OR trim(reason) = ''""",
}
