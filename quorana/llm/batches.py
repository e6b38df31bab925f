"""The size of Arrow batches while an operator runs its own Python steps."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Documents per batch: a few MB of text on average, whatever the session's setting for narrow rows is.
DOCUMENTS = 1000


@contextmanager
def document_batches(spark: SparkSession, rows: int = DOCUMENTS) -> Iterator[None]:
    """Steps that are executed inside take documents in batches of ``rows``, so that workers hold little text at a time."""
    before = spark.conf.get(ROWS_PER_BATCH)
    spark.conf.set(ROWS_PER_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS_PER_BATCH, before)
