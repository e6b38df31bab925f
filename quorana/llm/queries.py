"""The queries of the training-data operators, with the parameters they run with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quorana.llm import decontaminate, line_dedup, mixing, near_dedup, oracles, pii, quality, secret_scan, sharding, suffix_dedup, token_counts
from quorana.tables import read


def op1_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.digest(read(spark, sf, "documents"))


def op2_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(read(spark, sf, "documents"))


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixing_plan(read(spark, sf, "documents"))


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination_report(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_report(read(spark, sf, "documents"))


def op6_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, budget=1024).drop("text")


def op7_near_dups(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf, "documents"), percent=85)


def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_table(read(spark, sf, "documents"), n_shards=8)


def op9_lines(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.line_report(read(spark, sf, "documents"))


def op10_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.substring_report(read(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_secrets": op1_secrets, "op2_pii": op2_pii, "op3_mixing": op3_mixing, "op4_decontamination": op4_decontamination, "op5_quality": op5_quality, "op6_tokens": op6_tokens, "op7_near_dups": op7_near_dups, "op8_sharding": op8_sharding, "op9_lines": op9_lines, "op10_substrings": op10_substrings}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
