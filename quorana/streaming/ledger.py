"""Structured Streaming over append-only tables: an extension of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(stream: DataFrame, time: str, key: str, late: str = "1 day") -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts, sums and extremes per tumbling window and keys; late rows count within the watermark."""
    got = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return got.select(F.col("window.start").alias("start"), *keys, "n", "total", "least", "most")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key: runs of rows no further apart than the gap."""
    got = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return got.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def chain_state(stream: DataFrame, key: str, position: str, digest: str, told: str) -> DataFrame:
    """(key, position, ok) as lines arrive in order: whether each line's link is the digest of the one before, kept as state."""

    def check(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else "0" * 64
        rows = pd.concat(list(batches)).sort_values(position)
        out = []
        for p, d, t in zip(rows[position], rows[digest], rows[told], strict=True):
            out.append((k[0], p, t == last))
            last = d
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, position, "ok"])

    kind = dict(stream.dtypes)
    schema = f"`{key}` {kind[key]}, `{position}` {kind[position]}, ok boolean"
    return stream.groupBy(key).applyInPandasWithState(check, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, mode: str, folder: str) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote below a shared folder.

    Each batch is a folder of its own, which a repeated batch overwrites; in complete mode the last one is the result.
    """

    def put(rows: DataFrame, batch: int) -> None:
        at = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={batch}"
        rows.write.mode("overwrite").parquet(at)

    query = df.writeStream.foreachBatch(put).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")
