"""Placements in a reference context: scopes, counts, resolution, and whether two sets agree."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def origin_scope(docs: DataFrame, keys: Sequence[str], institution: str, start: str, end: str) -> DataFrame:
    """(keys, institutions, period_start, period_end): the distinct institutions, and the span of the non-empty periods."""
    return docs.groupBy(*keys).agg(
        F.array_sort(F.collect_set(institution)).alias("institutions"), F.min(F.nullif(F.col(start), F.lit(""))).alias("period_start"), F.max(F.nullif(F.col(end), F.lit(""))).alias("period_end")
    )


def counts_by_level(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n): counts per combination, per prefix of the keys, and in all; null where a key is summed over."""
    return rows.rollup(*keys).agg(F.count("*").alias("n"))


def unplaced(placements: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """The placements whose area is not known."""
    return placements.join(areas.select(key).distinct(), key, "left_anti")


def resolved(items: DataFrame, context: DataFrame, key: str, fields: Sequence[str], unknown: str = "UNRESOLVED") -> DataFrame:
    """Items with their context's fields and a status; items that the context lacks survive as unresolved."""
    told = context.select(key, *fields, F.lit("RESOLVED").alias("_s"))
    return items.join(told, key, "left").withColumn("resolution", F.coalesce("_s", F.lit(unknown))).drop("_s")


def context_counts(areas: DataFrame, placements: DataFrame, key: str, historical: str) -> DataFrame:
    """One row: areas that are present, only historical, and without a placement."""
    placed = placements.select(key).distinct().withColumn("_p", F.lit(True))
    return areas.join(placed, key, "left").agg(F.count_if(~F.col(historical)).alias("present"), F.count_if(F.col(historical)).alias("historical"), F.count_if(F.col("_p").isNull()).alias("unplaced"))


def disagreement(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side): what only one of two sets holds; empty if they are equal."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def stale(current: DataFrame, recorded: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """The keys whose recorded digest is not the current one, or that are on one side only."""
    told = recorded.select(*keys, F.col(digest).alias("_told"))
    return current.select(*keys, F.col(digest).alias("_is")).join(told, list(keys), "full_outer").where(~F.col("_told").eqNullSafe(F.col("_is"))).select(*keys)


def has_pointer(document: Column, pointer: str) -> Column:
    """Whether a JSON pointer (/a/0/b) leads somewhere in a JSON text, be it to null."""
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.strip("/").split("/")] if pointer.strip("/") else []
    if not parts:
        return F.try_parse_json(document).isNotNull()
    path = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts[:-1])
    holder, last = F.try_variant_get(F.try_parse_json(document), path, "string"), parts[-1]
    if last.isdigit():
        return F.coalesce(F.json_array_length(holder) > int(last), F.lit(False))
    return F.coalesce(F.array_contains(F.json_object_keys(holder), last), F.lit(False))


@F.pandas_udf(T.ArrayType(T.StringType()))
def keys_within(documents: pd.Series) -> pd.Series:
    """The distinct object keys of a JSON text at any depth, sorted; null for what is no JSON. The JVM cannot walk to an unknown depth."""

    def one(raw: str | None) -> list[str] | None:
        try:
            todo, keys = [json.loads(raw)] if raw is not None else [], set()
        except (ValueError, RecursionError):
            return None
        while todo:
            value = todo.pop()
            if isinstance(value, dict):
                keys |= value.keys()
                todo += value.values()
            elif isinstance(value, list):
                todo += value
        return None if raw is None else sorted(keys)

    return documents.map(one)
