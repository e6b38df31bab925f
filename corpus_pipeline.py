"""The corpus pipeline: five stages, each over all documents that the one before kept.

Quality rules drop what they reject; of each group of near-duplicates the document with the
smallest id stays; documents that hold a benchmark item go; the rest is mixed to the target
weights of its sources, which repeats or leaves out documents; and the mixture is cut into
shards along a Hilbert curve. Each stage is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorana.llm import decontaminate, mixing, near_dedup, quality, sharding
from quorana.tables import read
from quorana.workdir import Scratch

N_SHARDS, SIMILAR_PERCENT = 8, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs, percent=SIMILAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(docs, N_SHARDS)


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: Shingle sets, latent retrieval and curve order are not expressed in SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k > 1:
            scratch.drop(f"stage{k - 2}")
    return docs
