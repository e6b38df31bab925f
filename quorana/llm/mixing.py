"""Mixing sources to target weights by capped water-filling.

Sources ask for a share of the budget by weight. A source whose share exceeds its cap
(maximum epochs times its size) is clamped there, and what it leaves is shared among the
others by weight, until no share exceeds its cap. A source's target over its size gives its
repetitions: every document is taken the whole number of times, and a seeded part of the
documents once more, so that the words of that part come as near the rest as whole
documents allow.

The seeded part is the head of the source in the order of a hash of the document. It is
found without sorting a source in one task: documents fall into buckets by the head of the
hash, bucket sums give the bucket in which the rest ends, and only that bucket is ordered
exactly. All joins are on (source, bucket), so a source with a third of all rows is spread
over all of its buckets.

Null texts have size 0 and are taken as often as the others of their source, to no words.
A null source is a source of its own, last in order. Rows that repeat both id and text
are drawn in an arbitrary order among themselves, which does not change the result's rows.
A budget larger than all caps together is cut to them. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorana.llm.columns import n_words
from quorana.workdir import Scratch

#: Weights of the sources in their order, repeating; most repetitions of a document.
WEIGHTS, MAX_EPOCHS = (5, 2, 1), 3
#: Hash buckets per source. A bucket of a source with ten billion documents has 2.4 million of them.
BUCKETS = 4096


def source_weights(stats: DataFrame, weights: Sequence[int] = WEIGHTS, partitions: int = 8) -> DataFrame:
    """Adds ``weight``: the given weights, repeating, over the sources in code point order, null last.

    ``stats`` has one row per source. The rank is the row's place in its range partition plus
    the rows of the partitions before, so the sources are never gathered in one task.
    """
    spark = stats.sparkSession
    scratch = Scratch(spark, "mix-order")
    ranged = stats.repartitionByRange(partitions, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = scratch.write(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # as many rows as range partitions
    before = counts.withColumn("_before", F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    rank = (place + F.col("_before")).cast("long")
    choice = F.get(F.array(*[F.lit(w) for w in weights]), (rank % len(weights)).cast("int"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("weight", choice).drop("_part", "_before", "_at")


def water_fill(stats: DataFrame, budget: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight, ...).

    Each round clamps the sources above the level and spreads the rest again; a round is one
    aggregate whose few numbers come to the driver. The level only rises, so it ends after
    at most as many rounds as there are sources, and in practice after a few.
    """
    cap = F.col("source_size") * max_epochs
    clamped_caps, free_weight, level = 0, None, None
    while True:
        rest = budget - clamped_caps
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level[0]).cast("decimal(38,0)") > cap * F.lit(level[1]).cast("decimal(38,0)")
        found = stats.agg(F.sum(F.when(above, cap)).alias("c"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        caps, free = found.c or 0, found.w or 0
        if free_weight is not None and (caps, free) == (clamped_caps, free_weight):
            break
        clamped_caps, free_weight = caps, free
        rest = max(0, budget - clamped_caps)
        if not free:
            break
        level = (rest, free)
    share = F.col("weight").cast("double") * float(max(0, budget - clamped_caps)) / float(free_weight or 1)
    return stats.withColumn("target", F.when(above, cap.cast("double")).otherwise(F.least(share, cap.cast("double"))))


def _hash(seed: int, id_column: str, text: str) -> Column:
    """Of id and text, as many rows may share an id or have none."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))


def _drawn(df: DataFrame, carried: Sequence[str], weights: Sequence[int], max_epochs: int, seed: int, id_column: str, text: str, source: str, budget: int | None) -> DataFrame:
    """One row per document: columns ``_c0``... for ``carried``, and ``_size``, ``_source_size``, ``_target``, ``_repeats``."""
    scratch = Scratch(df.sparkSession, "mix")
    named = F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source)))
    bucket = F.conv(F.substring(_hash(seed, id_column, text), 1, 3), 16, 10).cast("int")
    rows = df.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(carried)], named.alias("_named"), bucket.alias("_bucket"), n_words(F.col(text)).alias("_size"), _hash(seed, id_column, text).alias("_h"))
    sums = scratch.write(
        df.select(F.col(source).alias("source"), named.alias("_named"), bucket.alias("_bucket"), n_words(F.col(text)).alias("_size"))
        .groupBy("source", "_named", "_bucket").agg(F.sum("_size").alias("_words")), "sums",
    )
    total = sums.agg(F.sum("_words")).first()[0] or 0
    stats = sums.groupBy("source", "_named").agg(F.sum("_words").alias("source_size"))
    stats = scratch.write(source_weights(stats, weights), "stats")
    plan = water_fill(stats, total if budget is None else budget, max_epochs).select(
        "_named", "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("_whole"),
    ).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    # a window over at most BUCKETS rows per source
    before = F.sum("_words").over(Window.partitionBy("_named").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    cells = sums.select("_named", "_bucket", F.coalesce(before, F.lit(0)).alias("_before")).join(plan, "_named")
    joined = rows.join(scratch.write(cells, "cells"), ["_named", "_bucket"])
    # the same distribution as the join's: one bucket of one source at a time
    upto = F.col("_before") + F.sum("_size").over(Window.partitionBy("_named", "_bucket").orderBy("_h", "_size").rowsBetween(Window.unboundedPreceding, 0))
    once_more = F.when(2 * upto - F.col("_size") <= 2 * F.col("_rest"), 1).otherwise(0)
    return joined.select(
        *[f"_c{k}" for k in range(len(carried))], "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
        F.least(F.col("_whole") + F.when(F.col("_rest") > 0, once_more).otherwise(0), F.lit(max_epochs)).cast("long").alias("_repeats"),
    )


def mixing_plan(df: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7, id_column: str = "doc_id", text: str = "text", source: str = "source", budget: int | None = None) -> DataFrame:
    """One row per document: id, size in words, source_size, target of its source, repeats, and taken words."""
    got = _drawn(df, [id_column], weights, max_epochs, seed, id_column, text, source, budget)
    return got.select(
        F.col("_c0").alias(id_column), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.col("_repeats").alias("repeats"), (F.col("_size") * F.col("_repeats")).alias("taken"),
    )


def mix(df: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7, id_column: str = "doc_id", text: str = "text", source: str = "source", budget: int | None = None) -> DataFrame:
    """The mixture itself: every document as often as it is taken, with the columns of ``df``."""
    got = _drawn(df, df.columns, weights, max_epochs, seed, id_column, text, source, budget).where("_repeats > 0")
    copies = got.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_repeats").cast("int"))))
    return copies.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(df.columns)])


#: DuckDB SQL for ``mixing_plan`` with the default parameters.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::HUGEINT AS weight, 3 * source_size AS cap FROM s),
b AS (SELECT sum(source_size) AS budget FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS c, sum(weight) OVER after AS f, row_number() OVER (ORDER BY cap::DOUBLE / weight, k) AS i FROM w
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY cap::DOUBLE / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT budget - c AS rest, f FROM o, b WHERE cap * f >= weight * (budget - c) ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN l.f IS NULL OR weight * rest > cap * l.f THEN cap::DOUBLE
    ELSE least(weight::DOUBLE * rest::DOUBLE / l.f::DOUBLE, cap::DOUBLE) END AS target FROM w LEFT JOIN l ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - whole * source_size::DOUBLE AS rest FROM p),
q AS (SELECT d.doc_id, d.size, r.source_size::BIGINT AS source_size, r.target, r.whole, r.rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  least(whole + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END, 3)::BIGINT AS repeats,
  (size * least(whole + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM q
"""
