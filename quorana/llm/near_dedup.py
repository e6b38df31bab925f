"""Near-duplicate detection by SuperMinHash signatures, banding, verification and union-find.

A document is the set of its distinct five-word shingles. In a SuperMinHash signature every
element visits the components in an order of its own, a seeded permutation, and offers rank
plus fraction; a component keeps the least. The ranks of one element are correlated through
the permutation, which lowers the variance of the estimate against independent hashes, and
once all components have values below rank r, no element has to go beyond rank r: dense sets
stop after a round or two.

Documents with equal sets form one class. The signatures of classes are cut into bands. The
classes that share a band are compared with two hubs of that bucket, not with each other, and
the links that hold on the full sets are grouped. The classes of a bucket that this leaves
apart are compared by the rarest of their shingles: sets that are similar enough share one of
their rarest few, so all of their links are found, while documents that only have a frequent
template in common never meet. No bucket is capped.

Null and empty texts have no shingles, are linked with nothing and are kept. Rows that
repeat an id are one document, linked by any of its texts. Documents without an id are grouped
under stand-ins (the last 2**56 longs, which ids must not use); they represent a group only if
none of it has an id, and show no id then. Very long texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorana.llm.batches import document_batches
from quorana.llm.columns import WORD, free_name
from quorana.llm.components import Stars
from quorana.workdir import MOST_ROWS, Scratch, merged_if

SHINGLE, COMPONENTS = 5, 128
#: The chance that a pair at the threshold shares no band stays below this.
MISS = 1e-6
#: Stand-ins for missing ids.
STAND_INS = 1 << 56
#: Places over which the rows of one class are dealt in the last join.
SPREAD = 64
#: Elements per vectorised round, and bytes hashed at a time.
CHUNK, PIECE = 60_000, 1 << 16

_LOWER = bytes(range(256)).replace(bytes(range(65, 91)), bytes(range(97, 123)))
_U = np.uint64
_GOLDEN, _M1, _M2, _STEP = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTES = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # letters A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_UP, _DOWN = _powers(0x9E3779B97F4A7C15, PIECE + 1), _powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), PIECE + 1)


def _word_hashes(data: np.ndarray) -> np.ndarray:
    """One hash per word of a UTF-8 text: a polynomial over its bytes, from sums over the text in pieces."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_BLANK[data], out=inside[1:-1].view(bool))
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    out, done, at = np.empty(len(starts), np.uint64), 0, 0
    while done < len(starts):
        at = int(starts[done])
        last = int(np.searchsorted(ends, at + PIECE, side="right"))
        if last == done:  # a word longer than a piece
            out[done] = xxhash.xxh3_64_intdigest(bytes(data[starts[done] : ends[done]]).translate(_LOWER))
            done += 1
            continue
        stop = int(ends[last - 1])
        sums = np.zeros(stop - at + 1, np.uint64)
        np.cumsum(_BYTES[data[at:stop]] * _UP[: stop - at], out=sums[1:])
        a, b = starts[done:last] - at, ends[done:last] - at
        out[done:last] = _mixed((sums[b] - sums[a]) * _DOWN[a] + (b - a).astype(np.uint64))
        done = last
    return out


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; a shorter text is one shingle, an empty one none."""
    own = _word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)) if text else np.zeros(0, np.uint64)
    if not len(own):
        return np.zeros(0, np.uint64)
    n = max(1, len(own) - k + 1)
    out = np.full(n, _U(min(len(own), k)), np.uint64)
    for at in range(min(k, len(own))):
        out = _mixed(out * _STEP + own[at : at + n])
    return np.unique(out)


def superminhash(sets: list[np.ndarray], m: int = COMPONENTS) -> np.ndarray:
    """Signatures (len(sets) x m) of non-empty sets: rank in the upper, fraction in the lower 32 bits."""
    sizes = np.array([len(s) for s in sets])
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    best = np.full(len(sets) * m, np.iinfo(np.uint64).max, np.uint64)
    order = None
    for rank in range(m):
        drawn = _mixed(element + _U(int(_GOLDEN) * (rank + 1) & 0xFFFFFFFFFFFFFFFF))
        chosen = (((drawn & _U(0xFFFFFFFF)) * _U(m - rank)) >> _U(32)).astype(np.int64) + rank
        if order is None:
            place = chosen
        else:
            rows = np.arange(len(element))
            place = order[rows, chosen].astype(np.int64)
            order[rows, chosen] = order[:, rank]
            order[:, rank] = place
        np.minimum.at(best, owner * m + place, (_U(rank) << _U(32)) | (drawn >> _U(32)))
        open_sets = (best.reshape(-1, m) >> _U(32)).max(axis=1) > rank  # the others cannot improve any more
        if not open_sets.any():
            break
        alive = open_sets[owner]
        if order is None:
            order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (int(alive.sum()), 1))
            first = chosen[alive]
            rows = np.arange(len(order))
            order[rows, first], order[:, 0] = 0, first
        elif not alive.all():
            order = order[alive]
        element, owner = element[alive], owner[alive]
    return best.reshape(-1, m)


def band_rows(threshold: float, m: int = COMPONENTS, miss: float = MISS) -> int:
    """The most rows per band at which a pair at the threshold is missed with probability ``miss`` or less."""
    return max(r for r in range(1, 17) if r == 1 or (1 - threshold**r) ** (m // r) <= miss)


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    n, m = signatures.shape
    bands = signatures[:, : m // rows * rows].reshape(n, m // rows, rows)
    out = np.broadcast_to(np.arange(1, m // rows + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(rows):
        out = _mixed(out * _STEP + bands[:, :, k])
    return out.view(np.int64)


def sketches(text: Column, rows: int, k: int = SHINGLE, m: int = COMPONENTS) -> Column:
    """struct(n, set_key, bands) of a text; the last two are null without shingles."""

    @F.pandas_udf("n long, set_key binary, bands array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out: list = [(0, None, None)] * len(texts)
            at, held, total = [], [], 0

            def flush() -> None:
                if at:
                    for i, s, b in zip(at, held, band_hashes(superminhash(held, m), rows), strict=True):
                        out[i] = (len(s), hashlib.md5(s.tobytes()).digest(), b)
                    at.clear()
                    held.clear()

            for i, t in enumerate(texts):
                s = shingles(t, k)
                if len(s):
                    at.append(i)
                    held.append(s)
                    total += len(s)
                    if total > CHUNK:
                        flush()
                        total = 0
            flush()
            yield pd.DataFrame(out, columns=["n", "set_key", "bands"])

    return sketch(text)


def shingle_sets(text: Column, k: int = SHINGLE) -> Column:
    """The sorted distinct shingle hashes as bytes."""

    @F.pandas_udf("binary")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, k).tobytes() for t in texts], dtype=object)

    return sets(text)


def _similar(a: Column, b: Column, percent: int) -> Column:
    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(100 * both >= percent * (len(s) + len(t) - both))
        return pd.Series(out)

    return similar(a, b)


def _tokens(percent: int):
    """Rows (own, id, root, n, prefix, token) from (own, id, root, set): the shingles, the set's size and its prefix.

    Two sets that are similar enough share a shingle of the first ``prefix`` of each, in any order that both follow.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, node, root, held in zip(batch["own"], batch["id"], batch["root"], batch["set"], strict=True):
                tokens = np.frombuffer(held, np.int64)
                n = len(tokens)
                yield pd.DataFrame({"own": own, "id": node, "root": root, "n": n, "prefix": n - -(-percent * n // 100) + 1, "token": tokens})

    return run


class _Search:
    """The state of one run: classes, buckets, and the sets of those in question."""

    def __init__(self, df: DataFrame, percent: int, id_column: str, text: str):
        self.percent = percent
        self.scratch = Scratch(df.sparkSession, "near")
        self.docs = df.select(node(df[id_column], df[text]).alias("id"), df[text].alias("text"))
        got = self.docs.withColumn("s", sketches(F.col("text"), band_rows(percent / 100)))
        self.sketched = self.scratch.write(got.select("id", F.col("s.n").alias("n"), F.col("s.set_key").alias("set_key"), F.col("s.bands").alias("bands")), "sketched")
        one = self.sketched.where(F.col("set_key").isNotNull()).groupBy("set_key")
        self.classes = self.scratch.write(one.agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("bands").alias("bands")), "classes")
        members = self.classes.select("id", F.explode("bands").alias("bucket")).hint("merge")  # many more rows than the files show
        buckets = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("least")).where("size > 1")
        joined = members.join(self.scratch.joinable(buckets, "buckets"), "bucket")
        #: one row per class that shares a bucket: its buckets, and how many classes it meets there
        self.members = self.scratch.write(joined.groupBy("id").agg(F.sum("size").alias("meets"), F.collect_list(F.struct("bucket", "size", "least")).alias("at")), "members")
        asked = self.scratch.joinable(self.members.select("id"), "asked")  # its own narrow table, which Spark may find small enough to broadcast
        found = self.docs.where(F.col("text").isNotNull()).join(asked, "id", "left_semi")
        self.sets = self.scratch.write(found.select("id", shingle_sets(F.col("text")).alias("set")), "sets")

    def verified(self, pairs: DataFrame, label: str) -> DataFrame:
        """Those of the pairs (written before) that hold on the full sets."""
        size = lambda c: F.octet_length(c).cast("long")
        both = (
            pairs.join(self.sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(self.sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
            .where(100 * F.least(size("x"), size("y")) >= self.percent * F.greatest(size("x"), size("y")))
        )
        return self.scratch.write(both.where(_similar(F.col("x"), F.col("y"), self.percent)).select("a", "b"), f"links-{label}")

    def hub_links(self) -> DataFrame:
        """Links of each class with two hubs of each of its buckets: the least, and of the others the one that meets most classes.

        In a group of copies of one text, that text meets more of the others than they meet each other.
        """
        at = self.members.select("id", "meets", F.explode("at").alias("m")).select("id", "meets", "m.*")
        central = at.where("id != least").groupBy("bucket").agg(F.max(F.struct("meets", F.bitwise_not("id").alias("mirrored"))).alias("top"))
        central = self.scratch.joinable(central.select("bucket", F.bitwise_not("top.mirrored").alias("central")), "central")
        rows = at.join(central, "bucket").select("id", F.explode(F.array("least", "central")).alias("hub")).where("id != hub")
        pairs = self.scratch.joinable(rows.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "pairs-hubs")
        return self.verified(pairs, "hubs")

    def open_classes(self, merged: DataFrame) -> tuple[DataFrame, int]:
        """(id, root) of the classes in buckets that (node, root) does not join yet, and how many.

        A bucket of up to three classes is through: the hubs have met all of its pairs.
        """
        at = self.members.select("id", "at").join(merged.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), F.explode("at").alias("m"))
        at = at.where("m.size > 3").select("id", "root", F.col("m.bucket").alias("bucket"))
        apart = at.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("bucket")
        found, counted = self.scratch.counted(at.join(self.scratch.joinable(apart, "apart"), "bucket").select("id", "root").distinct(), "open", n=F.count(F.lit(1)))
        return merged_if(counted["n"] > MOST_ROWS, found), counted["n"]

    def prefix_links(self, rest: DataFrame) -> DataFrame:
        """All links between the roots of the open classes.

        Shingles are ordered from the rarest on; sets that are similar enough share one of their
        first few, so that what only has frequent shingles in common never meets. Of those that
        meet, the sizes and the places of the shared shingle bound what the sets can have in common.
        """
        rows = self.sets.join(rest, "id").withColumn("own", F.xxhash64("id", "set")).select("own", "id", "root", "set")
        tokens = self.scratch.write(rows.mapInPandas(_tokens(self.percent), "own long, id long, root long, n long, prefix long, token long"), "tokens")
        often = tokens.groupBy("token").agg(F.count("*").alias("often"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        often = self.scratch.joinable(often.select("token", "often", (F.col("lo") != F.col("hi")).alias("meets")), "often")
        ordered = tokens.join(often, "token").groupBy("own").agg(*[F.first(c).alias(c) for c in ("id", "root", "n", "prefix")], F.sort_array(F.collect_list(F.struct("often", "token", "meets"))).alias("all"))
        first = ordered.select("id", "root", "n", F.posexplode(F.slice("all", F.lit(1), F.col("prefix").cast("int"))).alias("place", "t")).where("t.meets")
        first = self.scratch.joinable(first.select("id", "root", "n", (F.col("n") - F.col("place")).alias("left"), F.col("t.token").alias("token")), "prefixes")
        side = lambda s: first.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "root", "n", "left")])
        pairs = side("a").join(side("b"), "token").where("id_a < id_b AND root_a != root_b")
        pairs = pairs.where(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        pairs = pairs.where((100 + self.percent) * F.least("left_a", "left_b") >= self.percent * (F.col("n_a") + F.col("n_b")))
        pairs = self.scratch.joinable(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "pairs-rest")
        return self.verified(pairs, "rest")

    def same_document(self) -> DataFrame | None:
        """Links between the classes of an id that stands for several texts; None if no id does."""
        named = self.sketched.where(F.col("set_key").isNotNull()).select(F.col("id").alias("b"), "set_key")
        twice = named.groupBy("b").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo != hi").select("b")
        twice, counted = self.scratch.counted(twice, "twice", n=F.count(F.lit(1)))
        if not counted["n"]:
            return None
        return named.join(merged_if(counted["n"] > MOST_ROWS, twice), "b").join(self.classes.select("set_key", F.col("id").alias("a")), "set_key").select("a", "b")

    def roots(self) -> DataFrame:
        """(node, root) over enough links to connect whatever is connected."""
        stars = Stars(self.hub_links())
        edges = merged = None
        if stars.pending:
            stars.contract()
            edges, merged = stars.edges.select(F.col("u").alias("a"), F.col("v").alias("b")), stars.merged
        else:
            merged = stars.edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        rest, n = self.open_classes(merged)
        more = [x for x in (edges, self.prefix_links(rest) if n else None, self.same_document()) if x is not None]
        if more[1:] or (more and edges is None):
            stars = Stars(reduce(DataFrame.unionByName, more))
        return stars.finish()


def node(id_column: Column, text: Column) -> Column:
    """The id of a row as a long; a row without one gets a stand-in from its text, above all ids that are in use."""
    return F.coalesce(id_column.cast("long"), F.lit((1 << 63) - 1) - F.xxhash64(text).bitwiseAND(F.lit(STAND_INS - 1)))


def _named(x: Column) -> Column:
    return F.when(x < (1 << 63) - STAND_INS, x)


def _grouped(df: DataFrame, percent: int, id_column: str, text: str) -> DataFrame:
    """(id, n, root) of every row, stand-ins included."""
    with document_batches(df.sparkSession):  # all of the Python steps run here
        search = _Search(df, percent, id_column, text)
        roots = search.roots().select(F.col("node").alias("class_id"), "root")
    # a row that is the only one of its class, in no link, is its own component
    of_class = search.classes.select("set_key", "copies", F.col("id").alias("class_id")).join(roots, "class_id", "left").where("copies > 1 OR root IS NOT NULL")
    of_class = search.scratch.write(of_class.select("set_key", F.coalesce("root", "class_id").alias("root")), "roots")
    # a class may hold a third of all rows: its row is copied to as many places as its rows are dealt to; rows without a class are spread
    place = F.when(F.col("set_key").isNull(), F.xxhash64("id")).otherwise(F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
    rows = search.sketched.select("id", "n", "set_key", place.alias("place"))
    placed = of_class.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    held = rows.join(placed.hint("merge"), ["set_key", "place"], "left")  # SPREAD times what the files show
    return held.select("id", "n", F.coalesce("root", "id").alias("root"))


def near_duplicates(df: DataFrame, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id (the smallest id reachable over links) and kept.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets.
    """
    of = _grouped(df, percent, id_column, text)
    return of.select(_named(F.col("id")).alias(id_column), F.col("n").alias("n_shingles"), _named(F.col("root")).alias("component_id"), (F.col("id") == F.col("root")).alias("kept"))


def near_dedup(df: DataFrame, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the smallest id of their group, columns unchanged; of a group without any id, one row."""
    dropped = _grouped(df, percent, id_column, text).where("id != root").select("id").distinct()
    dropped = Scratch(df.sparkSession, "near-dropped").joinable(dropped, "ids")
    own, gone = free_name(df, "node"), free_name(df, "gone")
    held = df.withColumn(own, node(df[id_column], df[text])).join(dropped.withColumnRenamed("id", gone), F.col(own) == F.col(gone), "left_anti")
    alike = F.col(id_column).isNull() & F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    return held.where(~alike).unionByName(held.where(alike).dropDuplicates([own])).drop(own)
