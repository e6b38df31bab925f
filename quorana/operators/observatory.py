"""The public view of an overlay: one row per division with what paints it, and whether a stored view is still current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorana.operators.overlay import rollup

COUNTS = ("RATIFIED_MAPPING", "PENDING", "REJECTED")


def built(divisions: DataFrame, rows: DataFrame, key: str, weight: str = "weight", row_id: str = "row_id", status: str = "mapping_status", case: str = "case_id") -> DataFrame:
    """(key, n_cases, ratified_mapping, pending, rejected, saturation, painted_rows, void): every division, with overlay rows or not."""
    counted = rows.groupBy(key).agg(F.countDistinct(case).alias("n_cases"), *[F.count_if(F.col(status) == s).alias(s.lower()) for s in COUNTS])
    rolled = rollup(divisions, rows, key, weight, row_id).drop("row_ids")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rolled.join(counted, key, "left").select(key, zero("n_cases"), *[zero(s.lower()) for s in COUNTS], zero("saturation"), zero("painted_rows"), "void")


def fallback(divisions: DataFrame, key: str, inventory: DataFrame | None = None) -> DataFrame:
    """What is shown where no observatory was built: every division void, with the cases that an inventory (key, case_id) lists."""
    cases = None if inventory is None else inventory.groupBy(key).agg(F.countDistinct("case_id").alias("_n"))
    rows = divisions if cases is None else divisions.join(cases, key, "left")
    n = F.lit(0) if cases is None else F.coalesce("_n", F.lit(0))
    return rows.select(key, n.cast("long").alias("n_cases"), *[F.lit(0).cast("long").alias(s.lower()) for s in COUNTS], F.lit(0).cast("long").alias("saturation"), F.lit(0).cast("long").alias("painted_rows"), F.lit(True).alias("void"))


def digest(view: DataFrame, key: str) -> Column:
    """The digest of one row of a view, for the staleness check."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in view.columns if c != key)), {"ignoreNullFields": "false"}), 256)


def stale(view: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """The keys whose row in a recorded view is not the current one, or that stand in one of the two only."""
    now, then = view.select(key, digest(view, key).alias("_now")), recorded.select(key, digest(recorded, key).alias("_then"))
    return now.join(then, key, "full_outer").where(~F.col("_now").eqNullSafe(F.col("_then"))).select(key)


def card(view: DataFrame, key: str) -> DataFrame:
    """(key, card): each row as a short text."""
    shown = F.format_string("## %s\n\n%d cases: %d ratified, %d pending, %d rejected\n\n%s", F.col(key), "n_cases", "ratified_mapping", "pending", "rejected", F.when(F.col("void"), "Nothing paints this division.").otherwise(F.format_string("Saturation %d from %d rows.", "saturation", "painted_rows")))
    return view.select(key, shown.alias("card"))
