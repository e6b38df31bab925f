"""Sealed originals: reusing nonces, opening commitments, and holding items out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorana.functions.codes import canonical_json, commitment, prefixed, sha256
from quorana.operators.similarity import near_duplicates

KEYS = ("doc_id", "idx", "start", "end", "class")
DS_HOLDOUT = "HOLDOUT"


def with_nonces(spans: DataFrame, vault: DataFrame, fresh: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Spans with the nonce that the vault already holds for them, a fresh one for the others."""
    held = vault.select(*keys, F.col("nonce").alias("_held"))
    return spans.join(held, list(keys), "left").withColumn("reused", F.col("_held").isNotNull()).withColumn("nonce", F.coalesce("_held", fresh)).drop("_held")


def openings(commitments: DataFrame, vault: DataFrame) -> DataFrame:
    """(doc_id, idx, status) of each commitment: OPEN_OK, OPEN_FAIL if the vault's value hashes to another one, MISSING."""
    held = vault.select("doc_id", "idx", F.col("original").alias("_o"), F.col("nonce").alias("_n"))
    joined = commitments.join(held, ["doc_id", "idx"], "left")
    again = F.lower(F.hex(commitment(F.col("doc_id").cast("string"), F.col("idx"), F.col("start"), F.col("end"), F.col("class"), F.col("_o"), F.col("_n"))))
    return joined.select("doc_id", "idx", F.when(F.col("_o").isNull(), "MISSING").when(again == F.col("commit"), "OPEN_OK").otherwise("OPEN_FAIL").alias("status"))


def holdout_commit(items: Column, nonce: Column) -> Column:
    """What a list of held-out items, as JSON, is committed to."""
    return F.lower(F.hex(sha256(prefixed(F.lit(DS_HOLDOUT), canonical_json(items), nonce))))


def leaked(package: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """What a package and a holdout share."""
    return package.select(key).intersect(held_out.select(key))


def episodes_like_items(episodes: DataFrame, items: DataFrame, episode: str, task: str, item: str, text: str, at_least: float = 0.8) -> DataFrame:
    """Episodes whose task is nearly one of the held-out ones; exact shingle sets, no sketch."""
    return near_duplicates(episodes, items, episode, item, task, text, at_least=at_least)
