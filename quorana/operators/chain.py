"""Append-only tables: hash chains, supersession, versions, and parent pointers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorana.workdir import Scratch

GENESIS = "0" * 64


def chained(rows: DataFrame, keys: Sequence[str], position: str, payload: str) -> DataFrame:
    """Adds ``line_hash`` and ``prev_hash``, the digest of the line before within a key, zeros for the first."""
    w = Window.partitionBy(*keys).orderBy(position)
    hashed = rows.withColumn("line_hash", F.sha2(F.col(payload), 256))
    return hashed.withColumn("prev_hash", F.coalesce(F.lag("line_hash").over(w), F.lit(GENESIS)))


def broken_links(rows: DataFrame, keys: Sequence[str], position: str, payload: str, told: str) -> DataFrame:
    """The lines whose stored link is not the digest of the line before."""
    return chained(rows, keys, position, payload).where(~F.col(told).eqNullSafe(F.col("prev_hash")))


def current(ledger: DataFrame, digest: str, replaces: str) -> DataFrame:
    """The rows that no later row replaces."""
    return ledger.join(ledger.where(F.col(replaces).isNotNull()).select(F.col(replaces).alias(digest)).distinct(), digest, "left_anti")


def dangling(ledger: DataFrame, digest: str, replaces: str, position: str) -> DataFrame:
    """The rows that claim to replace a row which is not an earlier one."""
    earlier = ledger.groupBy(F.col(digest).alias("_d")).agg(F.min(position).alias("_p"))
    claims = ledger.where(F.col(replaces).isNotNull())
    return claims.join(earlier, F.col(replaces) == F.col("_d"), "left").where(F.col("_p").isNull() | (F.col("_p") >= F.col(position))).drop("_d", "_p")


def appended(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with the new rows whose keys it lacks; of new rows with one key, one."""
    return table.unionByName(new.dropDuplicates(list(keys)).join(table, list(keys), "left_anti"))


def version_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): what was added and what was removed between two versions."""
    added = new.select(key).distinct().join(old, key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.select(key).distinct().join(new, key, "left_anti").withColumn("change", F.lit("removed")))


def ancestors(nodes: DataFrame, child: str, parent: str, depth: int | None = None) -> DataFrame:
    """(child, ancestor, depth, cycle) along parent pointers, up to ``depth`` steps if it is given.

    Doubling: each round lengthens the paths that are as long as any can be so far, and only those, by
    all paths from where they end, so chains of n steps take log2(n) rounds and a path is not put
    together from each of its pairs of parts; it ends when none is that long. Many paths end in few
    places: what goes on from there is its own table, which Spark may find small enough to broadcast.
    A path that returns to its start is a cycle.
    """
    scratch = Scratch(nodes.sparkSession, "ancestors")
    paths = nodes.where(F.col(parent).isNotNull()).select(F.col(child).alias("child"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).distinct()
    paths, told = scratch.counted(paths, "paths1", longest=F.count(F.lit(1)))
    reach = 1
    while told["longest"] and (depth is None or reach < depth):
        on = paths.where("child != ancestor")
        ends = on.where(F.col("depth") == reach)
        met = scratch.write(ends.select(F.col("ancestor").alias("child")).distinct(), f"met{reach}")
        tails = scratch.write(on.join(met, "child", "left_semi").select(F.col("child").alias("ancestor"), F.col("ancestor").alias("_next"), F.col("depth").alias("_more")), f"tails{reach}")
        longer = ends.join(tails, "ancestor").select("child", F.col("_next").alias("ancestor"), (F.col("depth") + F.col("_more")).alias("depth"))
        both = paths.unionByName(longer if depth is None else longer.where(F.col("depth") <= depth))
        shortest = both.groupBy("child", "ancestor").agg(F.min("depth").alias("depth"))
        paths, told = scratch.counted(shortest, f"paths{2 * reach}", longest=F.count(F.when(F.col("depth") == 2 * reach, 1)))
        for name in ("paths", "met", "tails"):
            scratch.drop(f"{name}{reach}")
        reach *= 2
    return paths.withColumn("cycle", F.col("child") == F.col("ancestor"))


def earliest_by(rows: DataFrame, when: str, passing: str) -> DataFrame:
    """The earliest time among the rows that pass."""
    return rows.where(passing).agg(F.min(when).alias("earliest"))
