"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to the same number of bits and mapped to their
index on a Hilbert curve. Documents are sorted by that index and the order is cut into runs
of near equal bytes, so that a shard covers a compact box of all dimensions and readers can
prune shards on any of them. Ties on the curve (a popular cell may hold a third of all rows)
are ordered by the text's checksum and length, which keeps equal texts of a cell together,
then by id.

The sort is a range partition; a row's place is its place in its partition plus the rows
before it, so no task sees more than one partition and nothing but one row per partition and
the shard cuts reaches the driver. The sorted rows are written once, so that a partition that
is computed again cannot move a row.

Law ``bytes``: a document is as large as its UTF-8 text plus 1; a shard takes those documents
whose middle byte falls into its part of the total. Null texts have size 1 and checksum 0 of
the empty text. Null ids sort first. Rows that are equal in all sort columns are placed in any
order among themselves, in one task. Empty tables give empty results.

Equal texts of one language and source lie next to each other. They are not held in one shard
beyond that: a group of them may be a third of all rows, more than a shard of near equal bytes
has room for, and sources are what readers prune by.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorana.workdir import Scratch

BITS = 8
PLACE_BITS = 33  # of monotonically_increasing_id: partition above, place in the partition below


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of ``axes`` (n x dimensions, values below 2**bits)."""
    x = axes.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        low = bit - one
        for k in range(n):
            high = (x[k] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[k]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[k] ^= swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        turn = np.where((x[n - 1] & bit) != 0, turn ^ (bit - one), turn)
    x ^= turn
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            out = (out << one) | ((x[k] >> np.uint64(level)) & one)
    return out.astype(np.int64)


def curve(dimensions: Sequence[Column], bits: int = BITS) -> Column:
    """The Hilbert index of quantised integer dimensions (nulls are 0); at most 62 bits in all."""
    if bits * len(dimensions) > 62:
        raise ValueError("the index would not fit a long")

    @F.pandas_udf("long")
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for at in batches:
            yield pd.Series(hilbert_index(at.to_numpy(dtype=np.int64), bits))

    top = (1 << bits) - 1
    return index(F.struct(*[F.least(F.greatest(F.coalesce(d.cast("long"), F.lit(0)), F.lit(0)), F.lit(top)).alias(f"d{k}") for k, d in enumerate(dimensions)]))


def quantised_size(n: Column, bits: int = BITS) -> Column:
    """Eight steps for each doubling."""
    return F.floor(F.log2(F.coalesce(n, F.lit(0)) + 1) * 8)


def quantised_label(label: Column, bits: int = BITS) -> Column:
    """A label's hash cell: equal labels share one, whatever other labels there are."""
    return F.pmod(F.xxhash64(label), F.lit(1 << bits))


def default_dimensions(df: DataFrame, text: str) -> list[Column]:
    """Language, length and source, of those that the table has."""
    out = [quantised_size(F.octet_length(text))]
    return [quantised_label(F.col(c)) for c in ("lang", "source") if c in df.columns] + out


def hilbert_shards(df: DataFrame, n_shards: int, dimensions: Sequence[Column] | None = None, id_column: str = "doc_id", text: str = "text", carry: Sequence[str] | None = None, partitions: int | None = None) -> DataFrame:
    """The rows with ``shard`` and ``slot`` (gapless from 0 in the order along the curve), ``size`` and ``text_crc32``.

    ``carry`` names the columns to return beside those; all of ``df`` by default. Columns of
    ``df`` named like the new ones are replaced.
    """
    spark = df.sparkSession
    added = ["size", "text_crc32", "shard", "slot"]
    carried = [c for c in (df.columns if carry is None else carry) if c not in added]
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = df.select(
        *[F.col(c).alias(f"_c{k}") for k, c in enumerate(carried)], F.col(id_column).alias("_id"), F.coalesce(F.octet_length(text) + 1, F.lit(1)).cast("long").alias("_size"),
        F.crc32(body.cast("binary")).alias("_crc"), curve(dimensions or default_dimensions(df, text)).alias("_curve"),
    )
    order = [F.col("_curve"), F.col("_crc"), F.col("_size"), F.col("_id")]
    partitions = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    scratch = Scratch(spark, "shards")
    ranged = keyed.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    placed = scratch.write(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")

    part = F.shiftright("_at", PLACE_BITS)
    sums = placed.select(part.alias("_part"), "_size").groupBy("_part").agg(F.count("*").alias("_rows"), F.sum("_size").alias("_bytes"))
    # one row per range partition from here on
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.write(sums.select("_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_rows_before"), F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_bytes_before"), "_bytes"), "offsets")
    total = offsets.agg(F.sum("_bytes")).first()[0] or 1

    # the shard of a row needs its bytes before; only ids and sizes move for that
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    upto = placed.select("_at", part.alias("_part"), "_size").withColumn("_upto", F.sum("_size").over(within)).join(F.broadcast(offsets), "_part")
    middle = F.col("_bytes_before") * 2 + F.col("_upto") * 2 - F.col("_size")
    cut = upto.withColumn("_shard", F.least(F.floor(middle * n_shards / (2 * total)), F.lit(n_shards - 1)).cast("int"))
    # the first row of each shard: n_shards numbers
    starts = sorted((r["_shard"], r["_first"]) for r in cut.groupBy("_shard").agg(F.min("_at").alias("_first")).collect())
    firsts = F.array(*[F.lit(first).cast("long") for _, first in starts]) if starts else F.array().cast("array<bigint>")
    names = F.array(*[F.lit(k) for k, _ in starts]) if starts else F.array().cast("array<int>")

    base = {r["_part"]: r["_rows_before"] for r in offsets.where(F.col("_part").isin([first >> PLACE_BITS for _, first in starts])).collect()}
    ranks = F.array(*[F.lit(base[first >> PLACE_BITS] + (first & ((1 << PLACE_BITS) - 1))).cast("long") for _, first in starts]) if starts else firsts
    which = F.size(F.filter(firsts, lambda x: x <= F.col("_at"))) - 1
    rank = F.col("_rows_before") + F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    out = placed.withColumn("_part", part).join(F.broadcast(offsets.select("_part", "_rows_before")), "_part").withColumn("_which", which)
    return out.select(
        *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carried)], F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.get(names, F.col("_which")).alias("shard"), (rank - F.get(ranks, F.col("_which"))).cast("long").alias("slot"),
    )


def shard_table(df: DataFrame, n_shards: int = 8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: where it goes and under which law."""
    got = hilbert_shards(df, n_shards, id_column=id_column, text=text, carry=[id_column])
    return got.select(id_column, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
