"""Reconciling what is claimed with a ledger of what was checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: statuses from the worst to the best
STATUSES = ("REFUTED", "UNVERIFIED", "PARTIAL", "VERIFIED")


def rank(status: Column) -> Column:
    """0 for the worst status; an unknown one counts as UNVERIFIED."""
    out = F
    for k, s in enumerate(STATUSES):
        out = out.when(status == s, k)
    return out.otherwise(STATUSES.index("UNVERIFIED"))


def status_of(ranked: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STATUSES]), ranked)


def worst_status(claims: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The claims with the worst of their ledger rows' statuses, MISSING without any."""
    worst = ledger.groupBy(*keys).agg(F.min(rank(F.col("status"))).alias("_w"))
    return claims.join(worst, list(keys), "left").withColumn("status", F.coalesce(status_of(F.col("_w")), F.lit("MISSING"))).drop("_w")


def missing(claims: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The claims that the ledger lacks."""
    return claims.join(ledger, list(keys), "left_anti")


def extended(ledger: DataFrame, claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ledger with a row UNVERIFIED for each claim that it lacked."""
    new = missing(claims.select(*keys).distinct(), ledger, keys).withColumn("status", F.lit("UNVERIFIED"))
    return ledger.unionByName(new, allowMissingColumns=True)


def summary(checked: DataFrame, key: str, kind: str, kinds: Sequence[str] = ("A1", "A2", "A3"), last: str = "A4") -> DataFrame:
    """Per key: counts of each kind and status, and whether the key may be published or is rejected.

    ``checked`` has (key, kind, status). A kind counts as not refuted if any of its claims is not.
    """
    count = lambda *tests: F.count_if(F.lit(True) if not tests else tests[0]).cast("long")
    of = lambda k, s: (F.col(kind) == k) & (F.col("status") == s)
    counts = [count(of(k, s)).alias(f"{k}_{s}".lower()) for k in kinds for s in (*STATUSES, "MISSING")]
    got = checked.groupBy(key).agg(*counts, F.min(F.when(F.col(kind) == last, rank(F.col("status")))).alias("_last"), F.max(F.when((F.col(kind) == last) & (F.col("status") == "MISSING"), 1)).alias("_gone"))
    last_status = F.when(F.col("_gone").isNotNull() | F.col("_last").isNull(), "MISSING").otherwise(status_of(F.col("_last")))
    total = lambda names: sum((F.col(n) for n in names), F.lit(0))
    verified = sum((F.when(F.col(f"{k}_verified".lower()) > 0, 1).otherwise(0) for k in kinds), F.lit(0))
    standing = sum((F.when(total([f"{k}_{s}".lower() for s in ("VERIFIED", "UNVERIFIED", "PARTIAL", "MISSING")]) > 0, 1).otherwise(0) for k in kinds), F.lit(0))
    unverified = total([f"{k}_{s}".lower() for k in kinds for s in ("UNVERIFIED", "MISSING")]) + F.when(F.col("last_status").isin("UNVERIFIED", "MISSING"), 1).otherwise(0)
    return (
        got.withColumn("last_status", last_status).withColumn("verified_types", verified).withColumn("non_refuted_types", standing).withColumn("unverified_count", unverified)
        .withColumn("publishable", (F.col("verified_types") >= 2) & (F.col("last_status") == "VERIFIED") & (F.col("unverified_count") == 0))
        .withColumn("rejected_post", (F.col("non_refuted_types") < 2) | (F.col("last_status") == "REFUTED")).drop("_last", "_gone")
    )


def problems(ledger: DataFrame, kinds: Sequence[str] = ("A1", "A2", "A3", "A4")) -> DataFrame:
    """The ledger rows that break its rules, with what they break."""
    bad = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status"), F.when(~F.coalesce(F.col("anchor_type").isin(*kinds), F.lit(False)), "anchor_type"),
        F.when((F.col("status") == "VERIFIED") & (F.trim(F.coalesce("checked_by", F.lit(""))) == ""), "checked_by"),
    ))
    return ledger.withColumn("problems", bad).where(F.size("problems") > 0)


def grid(matrix: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """Matrix rows with their ledger summary; a key without one is uncorroborated, one that was rejected is REJECTED."""
    joined = matrix.join(summaries.select(key, "publishable", "rejected_post", "verified_types"), key, "left")
    return joined.withColumn("consensus_tier", F.col("tier")).withColumn("tier", F.when(F.coalesce("rejected_post", F.lit(False)), "REJECTED_POST_CORROBORATION").otherwise(F.col("tier"))).withColumn("corroborated", F.coalesce("publishable", F.lit(False))).withColumn("verified_types", F.coalesce("verified_types", F.lit(0))).drop("publishable", "rejected_post")


def axes(cells: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per axis field: its distinct values, sorted."""
    return cells.select(F.explode(F.array(*[F.struct(F.lit(f).alias("axis"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("axis").agg(F.array_sort(F.collect_set("value")).alias("values"))
