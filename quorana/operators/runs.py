"""From raw run records to assessed samples, admitted divisions, pools and the agreement matrix.

A run record is one response of one model: (model_id, vendor, sample_idx, status, response_raw,
response_sha256, ...). Every step is one pass over the records or an aggregate by division key;
what a response holds stays in its row until divisions are exploded.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorana.functions.text import canon_name
from quorana.operators import consensus as C
from quorana.operators import validate as V

# --- fixed values: the fields of a response, and the values that a tied vote gives
ANCHOR_FIELDS = {"A1": "a1_regulatory", "A2": "a2_segment", "A3": "a3_market_size"}
RESPONSE = """divisions array<struct<a1_regulatory: array<struct<regime: string, jurisdiction: string, citation: string>>, a2_segment: array<struct<bank: string, filing: string, fiscal_year: string, line_item: string>>,
a3_market_size: array<struct<publisher: string, series: string, value: string, unit: string, as_of: string>>, a4_seat: struct<function: string, cost_per_seat: array<double>, determinable_fraction: double,
addressable_seat_cost: double, terminality: array<struct<task: string>>>, name: string, axis: struct<business_line: string, side: string, region: array<string>, product: array<string>, office: string>, confidence: double>>,
rejected array<struct<name: string, reason_codes: array<string>, note: string>>"""
SCALAR_AXES = {"business_line": "multi", "side": "both", "office": "multi"}
LIST_AXES = {"region": "GLOBAL", "product": "multi"}


def response_checks(obj: Column) -> Mapping[str, Column]:
    """What a parsed response must have, by name."""
    ds = obj["divisions"]
    every = lambda ok: F.coalesce(F.forall(ds, lambda d: F.coalesce(ok(d), F.lit(False))), F.lit(False))
    return {
        "divisions": F.size(ds) > 0, "rejected": obj["rejected"].isNotNull(), "name": every(lambda d: d["name"] != ""), "axis": every(lambda d: d["axis"].isNotNull()),
        "cost_per_seat": every(lambda d: F.size(d["a4_seat"]["cost_per_seat"]) == 2), "determinable_fraction": every(lambda d: d["a4_seat"]["determinable_fraction"].between(0, 1)),
    }


def assessed(runs: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Adds obj, parses, schema_ok, ordered, n_rejected, hits and ``reasons``; a sample without reasons is VALID."""
    raw = F.col("response_raw")
    rows = runs.withColumn("parses", F.coalesce(V.is_json(raw), F.lit(False))).withColumn("obj", V.parsed(raw, RESPONSE))
    rows = rows.withColumn("schema_ok", F.col("parses") & (F.size(V.errors(response_checks(F.col("obj")))) == 0))
    rows = rows.withColumn("ordered", V.key_before(raw, "divisions", "a1_regulatory", "name")).withColumn("n_rejected", F.coalesce(F.size("obj.rejected"), F.lit(0))).withColumn("hits", V.first_hits(raw, patterns))
    found = V.errors({
        "PARSE_ERROR": F.col("parses"), "SCHEMA_INVALID": ~F.col("parses") | F.col("schema_ok"), "ORDER_VIOLATION": ~F.col("schema_ok") | F.col("ordered"),
        "REJECTED_EMPTY": ~F.col("parses") | (F.col("n_rejected") >= 1), "SELF_ASSESSMENT_LANGUAGE": F.coalesce(F.size("hits"), F.lit(0)) == 0,
    })
    reasons = F.when(F.col("status") == "ERROR", F.array(F.lit("RUN_ERROR"))).when(~V.intact(raw, F.col("response_sha256")), F.array(F.lit("SHA_MISMATCH"))).otherwise(found)
    return rows.withColumn("reasons", reasons).withColumn("sample_status", F.when(F.size("reasons") == 0, "VALID").otherwise("INVALID"))


def divisions(samples: DataFrame, threshold: float, accents: bool = True) -> DataFrame:
    """The divisions of VALID samples with their recomputed admission and canonical name."""
    rows = samples.where("sample_status = 'VALID'").select("model_id", "vendor", "sample_idx", F.posexplode("obj.divisions").alias("index", "d")).select("model_id", "vendor", "sample_idx", "index", "d.*")
    seat = F.col("a4_seat")
    value = V.recomputed(F.get(seat["cost_per_seat"], F.lit(0)), F.get(seat["cost_per_seat"], F.lit(1)), seat["determinable_fraction"])
    rows = rows.withColumn("recomputed", value).withColumn("arith_mismatch", V.mismatch(F.coalesce(seat["addressable_seat_cost"], F.lit(0.0)), F.col("recomputed")))
    anchors = V.non_empty(*[F.col(c) for c in ANCHOR_FIELDS.values()])
    admitted = V.admission(rows, anchors, F.col("recomputed"), F.coalesce(F.size(seat["terminality"]), F.lit(0)), threshold)
    return admitted.withColumn("canon", canon_name(F.col("name"), accents))


def keyed(divs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Divisions with the key that the alias table (canon, key) gives their name; null without one."""
    return divs.join(aliases.select("canon", F.col("key").alias("division_key")), "canon", "left")


def unaliased(divs: DataFrame) -> DataFrame:
    """The canonical names of admitted divisions that no alias has."""
    return divs.where("admitted AND division_key IS NULL").select("canon").distinct()


def matrix(divs: DataFrame, runs: DataFrame, excluded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, matrix) over the keys that eligible models name; excluded models keep their cells and have no vote."""
    named = divs.where("admitted AND division_key IS NOT NULL").select(F.col("division_key").alias("key"), F.col("model_id").alias("rater"), F.col("sample_idx").alias("sample"))
    totals = runs.groupBy(F.col("model_id").alias("rater")).agg(F.countDistinct("sample_idx").alias("k"))
    barred = None if excluded is None else excluded.select(F.col("model_id").alias("rater"))
    voting = named if barred is None else named.join(barred, "rater", "left_anti")
    found = C.cells(named.join(voting.select("key").distinct(), "key", "left_semi"), totals)
    eligible = found if barred is None else found.join(barred, "rater", "left_anti")
    samples = voting.groupBy("key").agg(F.countDistinct("rater", "sample").alias("n_samples"))
    return found, C.matrix(eligible, None).join(samples, "key")


def axis_votes(divs: DataFrame) -> DataFrame:
    """(key, the five axes): scalars by the most frequent value, lists by what most of them hold, comma-joined."""
    rows = divs.where("admitted AND division_key IS NOT NULL").select(F.col("division_key").alias("key"), "axis.*")
    votes = [C.scalar_vote(rows, ["key"], a, tie, a) for a, tie in SCALAR_AXES.items()]
    votes += [C.list_vote(rows, ["key"], a, fallback, a).withColumn(a, F.array_join(a, ",")) for a, fallback in LIST_AXES.items()]
    out = votes[0]
    for v in votes[1:]:
        out = out.join(v, "key")
    return out


def _said(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def anchor_text(kind: str, a: Column) -> Column:
    """What an anchor is called in the ledger."""
    put = lambda fmt, *names: F.format_string(fmt, *[_said(a[n]) for n in names])
    if kind == "A1":
        return put("%s | %s | %s", "regime", "jurisdiction", "citation")
    if kind == "A2":
        return put("%s | %s | FY%s | %s", "bank", "filing", "fiscal_year", "line_item")
    return put("%s | %s | %s %s | as_of %s", "publisher", "series", "value", "unit", "as_of")


def dedupe_key(kind: str, a: Column, accents: bool = True) -> Column:
    """The canonical citation by which equal anchors of one type are told."""
    names = {"A1": ("citation",), "A2": ("bank", "filing", "fiscal_year", "line_item"), "A3": ("publisher", "series", "as_of")}[kind]
    return canon_name(F.concat_ws(" ", *[_said(a[n]) for n in names]), accents)


def anchor_pool(divs: DataFrame, accents: bool = True) -> DataFrame:
    """(division_key, anchor_type, dedupe, anchor_text): per key and type the first anchor of each citation, by model, sample and place."""
    kinds = []
    for kind, field in ANCHOR_FIELDS.items():
        a = divs.where("admitted AND division_key IS NOT NULL").select("division_key", "model_id", "sample_idx", "index", F.posexplode(field).alias("place", "a"))
        kinds.append(a.select("division_key", "model_id", "sample_idx", "index", "place", F.lit(kind).alias("anchor_type"), dedupe_key(kind, F.col("a"), accents).alias("dedupe"), anchor_text(kind, F.col("a")).alias("anchor_text")))
    rows = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return C.first_wins(rows, ["division_key", "anchor_type", "dedupe"], ["model_id", "sample_idx", "index", "place"]).select("division_key", "anchor_type", "dedupe", "anchor_text")


def told_number(x: Column) -> Column:
    """A double as the ledger writes it: always with a decimal point, never with an exponent below 1e16."""
    plain = F.regexp_replace(x.cast("decimal(38,9)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(x == F.floor(x), F.concat(x.cast("long").cast("string"), F.lit(".0"))).when(F.abs(x).between(1e-3, 1e7), x.cast("string")).otherwise(plain)


def seat_pool(divs: DataFrame, accents: bool = True) -> DataFrame:
    """(division_key, medians, functions, terminality_count): the seat of each key; a task counts once by its canonical name."""
    rows = divs.where("admitted AND division_key IS NOT NULL")
    seat = F.col("a4_seat")
    middle = (F.get(seat["cost_per_seat"], F.lit(0)) + F.get(seat["cost_per_seat"], F.lit(1))) / 2
    pool = rows.groupBy("division_key").agg(
        F.median(middle).alias("cost_median"), F.median(seat["determinable_fraction"]).alias("fraction_median"), F.median("recomputed").alias("addressable_median"),
        F.array_sort(F.collect_set(F.nullif(seat["function"], F.lit("")))).alias("functions"),
    )
    tasks = rows.select("division_key", F.explode(seat["terminality"]).alias("t")).select("division_key", canon_name(F.coalesce("t.task", F.lit("")), accents).alias("c")).where("c <> ''")
    return pool.join(tasks.groupBy("division_key").agg(F.countDistinct("c").alias("terminality_count")), "division_key", "left").withColumn("terminality_count", F.coalesce("terminality_count", F.lit(0)))


def seat_text(pool: DataFrame) -> DataFrame:
    """(division_key, anchor_type, anchor_text): what the seat of each key is called in the ledger."""
    text = F.concat(
        F.lit("SEAT: "), F.array_join("functions", "; "), F.lit(" | cost_per_seat midpoint median "), told_number(F.col("cost_median")), F.lit(" | determinable_fraction median "), told_number(F.col("fraction_median")),
        F.lit(" | "), F.col("terminality_count").cast("string"), F.lit(" terminality tasks"),
    )
    return pool.select("division_key", F.lit("A4").alias("anchor_type"), text.alias("anchor_text"))


def expected_rows(pool: DataFrame, seats: DataFrame) -> DataFrame:
    """The ledger rows that a matrix asks for: one per pooled anchor, one per seat."""
    return pool.select("division_key", "anchor_type", "anchor_text").unionByName(seat_text(seats))
