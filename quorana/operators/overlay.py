"""Roll-ups over a hierarchy, depth of evidence, and verdicts of two judges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: statuses that paint, depths from the shallowest, families that a judge's failure decides
PAINTING = ("RATIFIED_MAPPING", "QUALIFIED_MAPPING")
DEPTHS = ("none", "division", "function_concept", "task_concept", "terminal_task", "control_point")


def depth_rank(depth: Column) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DEPTHS]), depth) - 1


def paint_weight(status: Column, channel: Column, kind_ok: Column, depth: Column, band: Column, weights: Mapping[str, int]) -> Column:
    """The weight of a row's band if the row may paint, else 0."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    may = status.isin(*PAINTING) & (channel == "public") & kind_ok & (depth != "control_point")
    return F.when(F.coalesce(may, F.lit(False)), F.coalesce(F.element_at(table, band), F.lit(0))).otherwise(0)


def rollup(divisions: DataFrame, rows: DataFrame, key: str, weight: str, row_id: str) -> DataFrame:
    """One row per division, painted or not: saturation, painted_rows, void and the painting rows' ids."""
    painted = rows.where(F.col(weight) > 0).groupBy(key).agg(F.sum(weight).alias("saturation"), F.count("*").alias("painted_rows"), F.array_sort(F.collect_list(row_id)).alias("row_ids"))
    joined = divisions.join(painted, key, "left")
    zero = joined.withColumn("saturation", F.coalesce("saturation", F.lit(0))).withColumn("painted_rows", F.coalesce("painted_rows", F.lit(0)))
    return zero.withColumn("void", F.col("painted_rows") == 0).withColumn("row_ids", F.coalesce("row_ids", F.array().cast(dict(painted.dtypes)["row_ids"])))


def rollup_summary(rolled: DataFrame) -> DataFrame:
    return rolled.agg(F.count("*").alias("admitted"), F.count_if(~F.col("void")).alias("painted"), F.count_if("void").alias("voids"), F.sum("painted_rows").alias("painted_rows"), F.max("saturation").alias("max_saturation"))


def deepest(points: DataFrame, key: str, depth: str, status: str, statuses: Sequence[str], out: str) -> DataFrame:
    """(key, out): the greatest depth among a key's points with one of the statuses, 'none' without any."""
    ranked = F.max(F.when(F.col(status).isin(*statuses), depth_rank(F.col(depth))))
    return points.groupBy(key).agg(F.get(F.array(*[F.lit(d) for d in DEPTHS]), F.coalesce(ranked, F.lit(0)).cast("int")).alias(out))


def judged(sheets: DataFrame, case: str, families: Sequence[str], assessors: tuple[str, str]) -> DataFrame:
    """(case, verdict) from rows (case, assessor, family, verdict, promotion).

    PASS if both judges pass every family that applies and both promote, FAIL if both refuse or a
    sheet is missing or incomplete, UNCERTAIN otherwise.
    """
    passes = F.col("verdict").isin("PASS", "NOT_APPLICABLE")
    per = sheets.where(F.col("assessor").isin(*assessors)).groupBy(case, "assessor").agg(F.countDistinct(F.when(F.col("family").isin(*families), F.col("family"))).alias("n"), F.count("*").alias("rows"), F.bool_and(passes).alias("ok"), F.max("promotion").alias("promotion"))
    of = lambda what, agg: agg(what)
    both = per.groupBy(case).agg(
        F.count("*").alias("sheets"), of((F.col("n") == len(families)) & (F.col("rows") == len(families)), F.bool_and).alias("complete"), of(F.col("ok"), F.bool_and).alias("ok"),
        of(F.col("promotion") == "PASS", F.bool_and).alias("up"), of(F.col("promotion") == "FAIL", F.bool_and).alias("down"),
    )
    verdict = F.when((F.col("sheets") < 2) | ~F.col("complete"), "FAIL").when(F.col("ok") & F.col("up"), "PASS").when(F.col("down"), "FAIL").otherwise("UNCERTAIN")
    cases = sheets.select(case).distinct()
    return cases.join(both.select(case, verdict.alias("verdict")), case, "left").select(case, F.coalesce("verdict", F.lit("FAIL")).alias("verdict"))


def agreed(primary: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mappings that both judges propose."""
    return primary.select(*keys).intersect(second.select(*keys))


def promoted(rows: DataFrame, verdicts: DataFrame, case: str) -> DataFrame:
    """Overlay rows with the status that their case's verdict gives."""
    joined = rows.join(verdicts, case, "left")
    status = F.when(F.col("verdict") == "PASS", "RATIFIED_MAPPING").when(F.col("verdict") == "FAIL", "REJECTED").otherwise("PENDING")
    return joined.withColumn("mapping_status", status).drop("verdict")


def unresolved(rows: DataFrame, references: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(all columns, problems) of the rows with a reference that its table lacks; null references are none."""
    out, flags = rows, []
    for k, (column, (table, key)) in enumerate(references.items()):
        out = out.join(table.select(F.col(key).alias(f"_k{k}")).distinct(), F.col(column) == F.col(f"_k{k}"), "left")
        flags.append(F.when(F.col(column).isNotNull() & F.col(f"_k{k}").isNull(), F.lit(f"unknown {column}")))
    out = out.withColumn("problems", F.array_compact(F.array(*flags))).drop(*[f"_k{k}" for k in range(len(references))])
    return out.where(F.size("problems") > 0)


def partition_problems(members: DataFrame, released: DataFrame, key: str) -> DataFrame:
    """(key, n): what is not covered exactly once: released and in no concept, in several, or not released."""
    counted = members.groupBy(key).agg(F.count("*").alias("n"))
    known = released.select(key).distinct().withColumn("_known", F.lit(True))
    return counted.join(known, key, "full_outer").where(F.col("n").isNull() | (F.col("n") != 1) | F.col("_known").isNull()).select(key, F.coalesce("n", F.lit(0)).alias("n"))


def generations(older: DataFrame, newer: DataFrame, key: str, labels: tuple[str, str] = ("older", "newer")) -> DataFrame:
    """(key, bindings, historical): the union of two generations of keys; absence from the newer one retires nothing."""
    both = older.select(key).withColumn("_g", F.lit(labels[0])).unionByName(newer.select(key).withColumn("_g", F.lit(labels[1])))
    return both.groupBy(key).agg(F.array_sort(F.collect_set("_g")).alias("bindings")).withColumn("historical", ~F.array_contains("bindings", labels[1]))
