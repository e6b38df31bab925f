"""Tokens in place of originals, listed terms and their classes, and what a redaction run keeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorana.functions.text import canonical_original
from quorana.functions.values import GAZETTEER_ORDER, band, date_token, parse_amount
from quorana.workdir import Scratch


def make_token(kind: Column, original: Column, pseudonym: Column, shift_days: Column | None = None) -> Column:
    """What stands for an original: its pseudonym; for a date the moved day or the month, for an amount its band."""
    value = F.when(kind == "DATE", F.coalesce(date_token(original, shift_days), pseudonym)).when(kind == "AMOUNT_EXACT", band(parse_amount(original))).otherwise(pseudonym)
    name = F.when(kind == "AMOUNT_EXACT", "AMOUNT").otherwise(kind)
    return F.concat(F.lit("⟦"), name, F.lit(":"), value, F.lit("⟧"))


def listed_class(terms: DataFrame, lists: DataFrame, term: str, normalise: bool = True) -> DataFrame:
    """The terms with the class whose list holds them, the first in order, and whether an allowlist does.

    ``lists`` is (list, term). Terms meet on their canonical form.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in GAZETTEER_ORDER]), F.col("list"))
    held = lists.select(canonical_original(F.col("term"), normalise).alias("_c"), "list").groupBy("_c").agg(F.min_by("list", F.when(rank > 0, rank)).alias("_first"), F.min(F.when(rank > 0, rank)).alias("_rank"), F.max(F.col("list") == "ALLOW").alias("_allowed"))
    joined = terms.withColumn("_c", canonical_original(F.col(term), normalise)).join(held, "_c", "left")
    return joined.withColumn("class", F.when(F.col("_rank").isNotNull(), F.get(F.array(*[F.lit(c) for c in GAZETTEER_ORDER]), (F.col("_rank") - 1).cast("int")))).withColumn("allowed", F.coalesce("_allowed", F.lit(False))).drop("_c", "_first", "_rank", "_allowed")


def refused_spans(spans: DataFrame, doc: str, classes: Sequence[str]) -> DataFrame:
    """(all columns, reason): detections of an unknown class, and those that overlap the one before."""
    before = F.max("end").over(Window.partitionBy(doc).orderBy("start", "end", "class").rowsBetween(Window.unboundedPreceding, -1))
    reason = F.when(~F.col("class").isin(*classes), "unknown class").when(F.coalesce(before, F.lit(0)) > F.col("start"), "overlap")
    return spans.withColumn("reason", reason).where("reason IS NOT NULL")


def merged_roots(old: DataFrame, new: DataFrame, key: str, same_policy: Column) -> DataFrame:
    """The roots of a new run over those of the old one, which stay only where the policy is the same."""
    return old.where(same_policy).join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def numbered(rows: DataFrame, order: Sequence[str], out: str = "number", partitions: int = 8) -> DataFrame:
    """Rows numbered from 1 in an order, by the place in a range partition and the rows before it; ties in any order."""
    scratch = Scratch(rows.sparkSession, "numbered")
    placed = scratch.write(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_before", "_at")


def numbered_within(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Rows numbered from 0 within each key, by their number in all less the first number of their key; no key is gathered in one task."""
    placed = Scratch(rows.sparkSession, "numbered-within").write(numbered(rows, [*keys, *order], "_all", int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "all")
    first = placed.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_all").alias("_first"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return placed.join(first, on).withColumn(out, F.col("_all") - F.col("_first")).drop("_all", "_first", *[f"_k{i}" for i in range(len(keys))])


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement: the first by a seeded digest of their key, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.withColumn("_d", digest).orderBy("_d", key).limit(n).drop("_d")


def safe_path(path: Column) -> Column:
    """Whether a path stays below its root: relative, no parent steps, no backslash, no drive."""
    return (path != "") & ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & ~F.contains(path, F.lit("\\")) & ~path.rlike("^[A-Za-z]:")


def near_name(text: Column, at: Column, chars: int = 60) -> Column:
    """Whether two capitalised words in a row stand within ``chars`` of an offset and not only at a sentence's start."""
    around = F.substr(text, F.greatest(at - chars, F.lit(0)) + 1, F.lit(2 * chars))
    return around.rlike(r"[a-z,;:] [A-Z][a-z]+ [A-Z][a-z]+")
