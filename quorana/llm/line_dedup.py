"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is removed if an earlier line of the corpus equals it or is one edit away (one code
point inserted, deleted or replaced). Earlier means: smaller id, then (for ids that repeat)
smaller text hash, then smaller line number; lines are compared as they came in, whether or
not they are kept themselves. Lines below MIN_CHARS code points have no edits: they are removed
if they have a word (a letter or digit) and equal an earlier line, or kept without ``short_lines``.
Lines below that are empty or hold signs alone, such as a closing bracket, are always kept.

Two lines within one edit agree on the first or on the second half of the shorter one, so
only lines that share such a half with another line can have a neighbour; four hashed keys
per line find them. Each of those emits its deletion neighbourhood as hashed keys: for each
block of BLOCK code points, what stands before and after it, and the block without one of
its code points. Lines that differ in one place share the key of that place; a line with one
code point more shares the key of its block with the whole block of the shorter one. All
lines of one key of the first kind are neighbours of each other, so each is compared with
the earliest only, and the second kind joins one shorter line with each longer one: the join
is linear in the keys, however many lines share one. Candidates are verified by edit distance.

Null texts have no lines. Ids may be null (they come last) or repeat; rows that repeat an id
and its text are one document. Splitting is on \\n only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorana.workdir import MOST_ROWS, Scratch, merged_if

#: One edit makes another line of a shorter one; code points per block of the neighbourhood.
MIN_CHARS, BLOCK = 6, 64


def _document(df: DataFrame, id_column: str, text: str) -> list[Column]:
    return [F.col(id_column).isNull().alias("nameless"), F.col(id_column).alias("id"), F.xxhash64(text).alias("version")]


def _lines(df: DataFrame, id_column: str, text: str, min_chars: int, short_lines: bool) -> DataFrame:
    """(nameless, id, version, no, line, lo, hi): the lines that count, with a 128-bit hash."""
    split = F.split(F.col(text), "\n", -1)
    counts = F.length("line") >= min_chars
    if short_lines:
        counts = counts | F.col("line").rlike(r"[\p{L}\p{N}]")
    found = df.select(*_document(df, id_column, text), F.posexplode(split).alias("no", "line")).where(counts)
    return found.withColumn("lo", F.xxhash64("line")).withColumn("hi", F.xxhash64(F.lit(1), "line"))


def _half_keys(line: Column) -> Column:
    """Keys that lines within one edit share: a half of the shorter one, whichever of the two this is."""
    n = F.length(line)

    def halves(m: Column) -> list[Column]:
        h = F.floor(m / 2).cast("int")
        return [F.xxhash64(m, F.lit(0), F.substr(line, F.lit(1), h)), F.xxhash64(m, F.lit(1), F.substr(line, n - m + h + 1, m - h))]

    return F.array(*halves(n), *halves(n - 1))


def _context(line: Column, m: Column, block: Column) -> Column:
    """The hash of what two lines share whose shorter one has m code points and that differ in one block only."""
    before, behind = block * BLOCK, F.greatest(m - (block + 1) * BLOCK, F.lit(0))
    return F.xxhash64(m, block, F.substr(line, F.lit(1), before), F.substr(line, F.length(line) - behind + 1, behind))


def _middle(line: Column, m: Column, block: Column) -> Column:
    """The block itself; one code point longer in the longer line."""
    behind = F.greatest(m - (block + 1) * BLOCK, F.lit(0))
    return F.substr(line, block * BLOCK + 1, F.length(line) - behind - block * BLOCK)


def _blocks(m: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((m - 1) / BLOCK).cast("int"))


def _without(piece: Column, k: Column) -> Column:
    return F.concat(F.substr(piece, F.lit(1), k), F.substr(piece, k + 2))


def neighbourhood(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables of (key, ...) from lines with a column ``line``: replacements, whole blocks, and blocks one shorter."""
    keep = [c for c in lines.columns if c != "line"]
    line, n = F.col("line"), F.length("line")

    def at(m: Column) -> DataFrame:
        per_block = lines.select(*keep, "line", m.alias("m"), F.explode(_blocks(m)).alias("block"))
        return per_block.select(*keep, _context(line, F.col("m"), F.col("block")).alias("context"), _middle(line, F.col("m"), F.col("block")).alias("middle"))

    same, longer = at(n), at(n - 1)
    places = lambda d: d.select(*keep, "context", "middle", F.explode(F.sequence(F.lit(0), F.length("middle") - 1)).alias("k"))
    replaced = places(same).select(*keep, F.xxhash64("context", "k", _without(F.col("middle"), F.col("k"))).alias("key"))
    whole = same.select(*keep, F.xxhash64("context", F.lit(-1), "middle").alias("key"))
    shorter = places(longer).select(*keep, F.xxhash64("context", F.lit(-1), _without(F.col("middle"), F.col("k"))).alias("key"))
    return replaced, whole, shorter


def removed_lines(df: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, short_lines: bool = True) -> DataFrame:
    """(nameless, id, version, no) of every line to remove."""
    scratch = Scratch(df.sparkSession, "lines")
    place = F.struct("nameless", "id", "version", "no")
    lines = _lines(df, id_column, text, min_chars, short_lines)
    edited = lines.where(F.length("line") >= min_chars)
    distinct = lines.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    distinct, counted = scratch.counted(distinct, "distinct", n=F.count(F.lit(1)))

    # candidates: lines that share a half with another line; the 64-bit hash is enough to look for them
    halves = edited.select("lo", F.explode(_half_keys(F.col("line"))).alias("key"))
    shared = scratch.joinable(halves.groupBy("key").agg(F.min("lo").alias("a"), F.max("lo").alias("b")).where("a != b").select("key"), "shared")
    likely = scratch.joinable(halves.join(shared, "key", "left_semi").select("lo").distinct(), "likely")
    chosen = edited.select("lo", "hi", "line").join(likely, "lo", "left_semi").distinct()
    chosen = scratch.joinable(chosen.join(merged_if(counted["n"] > MOST_ROWS, distinct.select("lo", "hi", "first")), ["lo", "hi"]), "chosen")

    replaced, whole, shorter = neighbourhood(chosen.select("lo", "hi", "first", "line"))
    name = F.struct("first", "lo", "hi")
    earliest, counted = scratch.counted(replaced.groupBy("key").agg(F.min(name).alias("e"), F.count("*").alias("n")).where("n > 1").select("key", "e"), "earliest", n=F.count(F.lit(1)))
    # a neighbourhood has very many more rows than the files that it comes from show, so it is never the side to broadcast
    earliest = earliest.hint("merge") if counted["n"] > MOST_ROWS else F.broadcast(earliest)
    stars = replaced.join(earliest, "key").where(F.col("first") > F.col("e.first")).select(F.col("e.lo").alias("a_lo"), F.col("e.hi").alias("a_hi"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    pairs = whole.select("key", name.alias("s")).hint("merge").join(shorter.select("key", name.alias("t")), "key")
    early, late = F.when(F.col("s.first") < F.col("t.first"), F.col("s")).otherwise(F.col("t")), F.when(F.col("s.first") < F.col("t.first"), F.col("t")).otherwise(F.col("s"))
    inserted = pairs.where("s.first != t.first").select(early.alias("e"), late.alias("l")).select(F.col("e.lo").alias("a_lo"), F.col("e.hi").alias("a_hi"), F.col("l.lo").alias("b_lo"), F.col("l.hi").alias("b_hi"))
    candidates = scratch.joinable(stars.unionByName(inserted).distinct(), "candidates")

    texts = chosen.select("lo", "hi", "line")
    side = lambda p: texts.select(F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"), F.col("line").alias(p))
    verified = candidates.join(side("a"), ["a_lo", "a_hi"]).join(side("b"), ["b_lo", "b_hi"]).where(F.levenshtein("a", "b", 1).between(0, 1))
    near = verified.select(F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"), F.lit(True).alias("near")).distinct()
    told = scratch.joinable(distinct.join(near, ["lo", "hi"], "left").where("n > 1 OR near").select("lo", "hi", "first", F.coalesce("near", F.lit(False)).alias("near")), "told")
    return lines.select("nameless", "id", "version", "no", "lo", "hi").join(told, ["lo", "hi"]).where(F.col("near") | (place > F.col("first"))).select("nameless", "id", "version", "no")


def _per_document(df: DataFrame, id_column: str, text: str, min_chars: int, short_lines: bool) -> DataFrame:
    gone = removed_lines(df, id_column, text, min_chars, short_lines).distinct()
    return gone.groupBy("nameless", "id", "version").agg(F.array_sort(F.collect_list("no")).alias("removed"))


def _matched(rows: DataFrame, gone: DataFrame) -> DataFrame:
    scratch = Scratch(rows.sparkSession, "line-decisions")
    gone = scratch.joinable(gone.select(F.coalesce("id", F.lit(0)).alias("_id"), F.col("nameless").alias("_nameless"), F.col("version").alias("_version"), "removed"), "removed").withColumnRenamed("removed", "_removed")
    on = (F.coalesce("_row_id", F.lit(0)) == F.col("_id")) & (F.col("_row_id").isNull() == F.col("_nameless")) & (F.col("_row_version") == F.col("_version"))
    return rows.join(gone, on, "left").withColumn("_removed", F.coalesce("_removed", F.array().cast("array<int>")))


def line_report(df: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, short_lines: bool = True) -> DataFrame:
    """One row per row of ``df``: id, n_lines, n_removed, and the numbers of the removed lines from 0, comma-joined."""
    rows = df.select(F.col(id_column).alias("_row_id"), F.xxhash64(text).alias("_row_version"), F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(F.col(text), "\n", -1))).cast("long").alias("n_lines"))
    got = _matched(rows, _per_document(df, id_column, text, min_chars, short_lines))
    return got.select(F.col("_row_id").alias(id_column), "n_lines", F.size("_removed").cast("long").alias("n_removed"), F.array_join(F.transform("_removed", lambda x: x.cast("string")), ",").alias("removed_lines"))


def dedup_lines(df: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, short_lines: bool = True) -> DataFrame:
    """``df`` with the removed lines gone from its texts; other columns unchanged."""
    rows = df.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(df.columns)], F.col(id_column).alias("_row_id"), F.xxhash64(text).alias("_row_version"))
    got = _matched(rows, _per_document(df, id_column, text, min_chars, short_lines))
    at = F.col(f"_c{df.columns.index(text)}")
    kept = F.array_join(F.filter(F.split(at, "\n", -1), lambda line, no: ~F.array_contains("_removed", no)), "\n")
    cut = F.when(F.size("_removed") > 0, kept).otherwise(at)
    return got.select(*[(cut if c == text else F.col(f"_c{k}")).alias(c) for k, c in enumerate(df.columns)])
