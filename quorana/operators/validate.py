"""Parsing, validating and admitting raw rater responses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: reason codes, thresholds, and how far a claimed product may be off
FEW_ANCHORS, SEAT_BELOW, FEW_TASKS = "R_ANCHORS_LT2", "R_SEAT_BELOW_THRESHOLD", "R_TERMINALITY_LT3"
LEAST_ANCHORS, LEAST_TASKS, TOLERANCE = 2, 3, 0.05


def unfenced(raw: Column) -> Column:
    """A response without the one ```json fence it may stand in."""
    inner = F.regexp_extract(F.trim(raw), r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(F.trim(raw).rlike(r"(?s)^```(?:json)?\s*.*```$"), inner).otherwise(F.trim(raw))


def is_json(raw: Column) -> Column:
    return F.try_parse_json(unfenced(raw)).isNotNull()


def parsed(raw: Column, schema: str) -> Column:
    """The response under an explicit schema; missing members are null."""
    return F.from_json(unfenced(raw), schema, {"mode": "PERMISSIVE"})


def errors(checks: Mapping[str, Column]) -> Column:
    """The names of the checks that a row fails, in order. A check that cannot be decided is failed."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def key_before(raw: Column, list_key: str, first: str, second: str) -> Column:
    """Whether every object of a list names ``first`` before ``second``; false for an empty or missing list."""
    items = F.from_json(unfenced(raw), f"{list_key} array<string>")[list_key]
    at = lambda item, key: F.array_position(F.json_object_keys(item), key)
    return F.coalesce((F.size(items) > 0) & F.forall(items, lambda x: (at(x, first) > 0) & (at(x, second) > 0) & (at(x, first) < at(x, second))), F.lit(False))


def intact(raw: Column, digest: Column) -> Column:
    """Whether the raw text still has its stored digest."""
    return F.coalesce(F.sha2(raw, 256) == digest, F.lit(False))


def recomputed(low: Column, high: Column, fraction: Column) -> Column:
    """The middle of a range times a fraction."""
    return (low + high) / 2 * fraction


def mismatch(claimed: Column, value: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether a claim is off by more than the tolerance; off at all where the value is 0."""
    return F.when(value == 0, claimed != 0).otherwise(F.abs(claimed - value) / F.abs(value) > tolerance)


def admission(rows: DataFrame, anchors: Column, value: Column, tasks: Column, threshold: float) -> DataFrame:
    """Adds ``reasons`` (codes of what is missing) and ``admitted``."""
    reasons = F.array_compact(F.array(F.when(anchors < LEAST_ANCHORS, FEW_ANCHORS), F.when(value < threshold, SEAT_BELOW), F.when(tasks < LEAST_TASKS, FEW_TASKS)))
    return rows.withColumn("reasons", reasons).withColumn("admitted", F.size("reasons") == 0)


def non_empty(*lists: Column) -> Column:
    """How many of the lists are neither null nor empty."""
    return sum((F.when(F.coalesce(F.size(x), F.lit(0)) > 0, 1).otherwise(0) for x in lists), F.lit(0))


def first_hits(text: Column, patterns: Sequence[str]) -> Column:
    """The first match of each pattern that matches, in the patterns' order."""
    return F.filter(F.array(*[F.regexp_extract(text, p, 0) for p in patterns]), lambda x: x != "")


def assessment(parses: Column, schema_ok: Column, ordered: Column, n_rejected: Column, hits: Column) -> Column:
    """Reasons why a response is not valid; none for a valid one."""
    return errors({"PARSE": parses, "SCHEMA": schema_ok, "ORDER": ordered, "NO_REJECTED": n_rejected >= 1, "SELF_ASSESSMENT": F.size(hits) == 0})
