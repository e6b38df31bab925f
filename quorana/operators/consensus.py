"""Agreement between raters: cells, support tiers, votes, medians and first-wins pools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A cell counts as support from here on; the shares of raters that make a tier.
SUPPORT_AT, STRONG_SHARE, MODERATE_SHARE = 0.5, 0.8, 0.5


def tier(support: Column, n_raters: Column) -> Column:
    """STRONG from ceil(0.8 n) supporters, MODERATE from ceil(0.5 n), else WEAK; WEAK without raters."""
    return (
        F.when((n_raters > 0) & (support >= F.ceil(F.lit(STRONG_SHARE) * n_raters)), "STRONG")
        .when((n_raters > 0) & (support >= F.ceil(F.lit(MODERATE_SHARE) * n_raters)), "MODERATE")
        .otherwise("WEAK")
    )


def sample_counts(samples: DataFrame, rater: str = "rater", sample: str = "sample") -> DataFrame:
    """(rater, k): how many samples a rater gave, whatever their status."""
    return samples.groupBy(rater).agg(F.countDistinct(sample).alias("k"))


def cells(assertions: DataFrame, totals: DataFrame, key: str = "key", rater: str = "rater", sample: str = "sample") -> DataFrame:
    """(key, rater, n, k, cell) for every key and rater; a rater that never named a key has 0.

    ``totals`` is (rater, k) and holds one row per rater. A cell is the share of all of the
    rater's samples that name the key; a key named twice in a sample counts once.
    """
    hits = assertions.groupBy(key, rater).agg(F.countDistinct(sample).alias("n"))
    panel = totals.agg(F.collect_list(F.struct(F.col(rater), F.col("k"))).alias("panel"))
    # one row per key and rater is the result's own size; the panel is one row
    grid = hits.select(key).distinct().join(F.broadcast(panel)).select(key, F.inline("panel").alias(rater, "k"))
    return grid.join(hits, [key, rater], "left").select(
        key, rater, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "k",
        F.coalesce(F.bround(F.col("n") / F.col("k"), 6), F.lit(0.0)).alias("cell"),
    )


def matrix(cell_rows: DataFrame, n_raters: Column, key: str = "key", support_at: float = SUPPORT_AT) -> DataFrame:
    """(key, model_support, tier): how many raters reach ``support_at``, and the tier of that."""
    out = cell_rows.groupBy(key).agg(F.count_if(F.col("cell") >= F.lit(support_at)).alias("model_support"), F.count("*").alias("_n"))
    return out.withColumn("tier", tier(F.col("model_support"), n_raters if n_raters is not None else F.col("_n"))).drop("_n")


def pivoted(cell_rows: DataFrame, raters: Sequence[str], key: str = "key", rater: str = "rater") -> DataFrame:
    """One row per key, one column per rater of the given (bounded) list, formatted to four places."""
    return cell_rows.groupBy(key).pivot(rater, list(raters)).agg(F.format_string("%.4f", F.bround(F.first("cell"), 4)))


def scalar_vote(rows: DataFrame, keys: Sequence[str], value: str, tie: str, out: str) -> DataFrame:
    """The most frequent non-null ``value`` of each key; ``tie`` where the first two draw, or where all values are null."""
    counts = rows.groupBy(*keys, value).agg(F.count(value).alias("_n"))
    # the greatest and the least of the most frequent values; a null has no count, so it comes last
    ends = counts.groupBy(*keys).agg(F.max(F.struct("_n", F.col(value).alias("v"))).alias("_hi"), F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_lo"))
    return ends.select(*keys, F.when(F.col("_hi.v") == F.col("_lo.v"), F.col("_hi.v")).otherwise(F.lit(tie)).alias(out))


def list_vote(rows: DataFrame, keys: Sequence[str], lists: str, fallback: str, out: str) -> DataFrame:
    """Elements that more than half of a key's lists hold, sorted; [fallback] if there are none.

    A list counts an element once. Empty and null lists count as lists.
    """
    n = rows.groupBy(*keys).agg(F.count("*").alias("_lists"))
    held = (
        rows.select(*keys, F.explode(F.array_distinct(lists)).alias("_e")).groupBy(*keys, "_e").agg(F.count("*").alias("_n"))
        .join(n, list(keys)).where(F.col("_n") * 2 > F.col("_lists"))
        .groupBy(*keys).agg(F.array_sort(F.collect_set("_e")).alias("_kept"))
    )
    return n.join(held, list(keys), "left").select(*keys, F.coalesce("_kept", F.array(F.lit(fallback))).alias(out))


def median_of(rows: DataFrame, keys: Sequence[str], measure: str, out: str) -> DataFrame:
    """The exact median (mean of the middle two) of each key."""
    return rows.groupBy(*keys).agg(F.median(measure).alias(out))


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``. An aggregate, so a hot key combines before it is shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    ranked = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    picked = rows.groupBy(*keys).agg(F.min(ranked).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_wins_window(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The same by row_number, for rows with columns that cannot be ordered (maps)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
