"""Intermediate tables in the folder that the cluster shares.

Every table is Parquet below ``spark.checkpoint.dir``, so executors that are
lost cost a task, never a lineage. Only where that setting is missing and the
master is local (tests) a temporary folder is used.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table with more rows or bytes than that is never broadcast in a join. Spark judges by the files, which
#: are a small part of what compressed ids take in the driver's memory.
MOST_ROWS, MOST_BYTES = 100_000, 16 << 20

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash.

    On a cluster without the setting this raises: executors would not see a folder of the driver's.
    """
    told = spark.conf.get("spark.checkpoint.dir", "")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="quorana-")
    return _local[app]


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _width(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory; of arrays, all elements as long as their type's fixed part."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column).cast("long"), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        each = 8 * len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 8
        return F.coalesce(F.size(column).cast("long"), F.lit(0)) * each + 16
    return F.lit(8 * len(kind.fields) if isinstance(kind, T.StructType) else 8).cast("long")


def merged_if(large: bool, df: DataFrame) -> DataFrame:
    """``df`` as it is, or so that the next join shuffles both sides."""
    return df.hint("merge") if large else df


class Scratch:
    """The intermediate tables of one run; they go when the application ends, or earlier by ``drop``."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        fs, p = _filesystem(spark, self.root)
        fs.deleteOnExit(p)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns it as read back, so that its lineage ends here."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
        """As ``write``, with aggregates that the same job takes. A task that ran twice counts twice: zero is exact."""
        seen = Observation()
        table = self.write(df.observe(seen, *[m.alias(k) for k, m in measures.items()]), name)
        return table, seen.get

    def joinable(self, df: DataFrame, name: str) -> DataFrame:
        """As ``write``, for one side of joins: beyond MOST_ROWS or MOST_BYTES the next join of it shuffles both sides."""
        width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))
        table, counted = self.counted(df, name, n=F.count(F.lit(1)), width=F.sum(width))
        return merged_if(counted["n"] > MOST_ROWS or (counted["width"] or 0) > MOST_BYTES, table)

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        fs, p = _filesystem(self.spark, f"{self.root}/{name}")
        fs.delete(p, True)

    def settle(self) -> None:
        """Lets Spark delete the shuffle files of steps that were written: it does so once their plans are collected."""
        gc.collect()
        self.spark._jvm.System.gc()
