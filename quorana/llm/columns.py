"""Column helpers that the native operators share; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Matches per block when offsets are added up, so that no array is copied once per match.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_SPANS = "array<struct<start: bigint, end: bigint, value: string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct(start, end, value)>: all matches of a Java pattern, offsets in code points.

    What stands between the matches and the matches themselves are measured, and the lengths
    summed in two levels, so the work is linear in the text for any number of matches.
    """

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), m.alias("value")))
        return let(pairs, _summed)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(_SPANS)))


def _summed(pairs: Column) -> Column:
    def block(k: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("out"))
        return F.aggregate(
            F.slice(pairs, k * BLOCK + 1, F.lit(BLOCK)), zero,
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["len"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["len"]).alias("end"), x["value"].alias("value")))).alias("out"),
            ),
        )

    last = F.floor((F.size(pairs) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), block)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))

    def shifted(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    return F.flatten(F.aggregate(blocks, zero, shifted)["out"])


def same(a: Column, b: Column) -> Column:
    """Equality under which nulls are equal."""
    return a.eqNullSafe(b)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
