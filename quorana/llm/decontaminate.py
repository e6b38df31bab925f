"""Benchmark decontamination by latent semantic retrieval.

1. Words. One pass over all documents writes, next to their columns, their words as numbers of
   the benchmark's vocabulary; everything after it reads those. A second, over the numbers,
   counts document frequencies. Words that more than COMMON of the documents hold have no weight.
2. Randomised SVD. A third pass over the numbers sketches the passages' term matrix: with A the
   TF-IDF rows of all passages and R a random sign matrix, it gathers the integer sums behind
   A'A R. From that, a small dense problem on the driver gives the leading right singular
   vectors of A (the Nystroem form of the randomised range finder, which has a power step
   built in). Its size is the benchmark's vocabulary, whatever the corpus.
3. Retrieval. Overlapping passages are projected and compared with the projected benchmark
   segments; cosines from COSINE on are candidates. Beside that, exactly: what holds SHARED of
   an item holds enough of the item's rarest words close together (``Seeds``), so every stretch
   that does is a candidate too, whatever its cosine and however common the item's words are.
   The latent search bounds nothing.
4. Verification. A candidate counts if the longest common subsequence of item and passage
   covers SHARED of the item's words within a passage not much longer than the item, and, for
   what is not nearly verbatim, covers its answer too: the words after an answer marker, or
   the last sentence.

Words are taken in lower case and without ASCII punctuation. The benchmark is taken in blocks of
bounded size, and each block is searched in all documents. Null and empty texts, and items
without words, match nothing. Items without an id are searched like all others and listed as
"null"; items that repeat an id are searched each. A document's items are listed once. Document
ids may be null or repeat: every row is judged by its own text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorana.llm.batches import document_batches
from quorana.workdir import Scratch

#: Words per passage, and sketch columns, which bound the rank. Items of SHORT words or fewer are
#: sought in passages of half the size, which other words dilute less. Passages start every half of their size.
PASSAGE, SKETCH, SHORT = 32, 64, 24
COMMON = 0.05
COSINE, SHARED, VERBATIM, ANSWERED = 0.55, 0.7, 0.9, 0.6
#: Bytes of benchmark text that are searched at a time. A worker holds some 600 bytes for each different word of them.
BLOCK_BYTES = 64 << 20
#: An item is sought by words that stand for so many more of its places than a match may lack, so each match holds as many of them.
SEEDS = 8

#: ASCII punctuation, which words are compared without.
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_ANSWER = re.compile(r"(?is)\b(?:answer|solution|ans)\s*[:=]\s*(.+)\Z")


def plain_words(text: str | None) -> list[bytes]:
    """The words of a text: lower case, without punctuation; what is nothing else is no word."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split() if text else []


def answer_words(text: str) -> list[bytes]:
    """The answer of an item: what follows an answer marker, else its last sentence."""
    marked = _ANSWER.search(text)
    if marked:
        return plain_words(marked[1])
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if plain_words(s)]
    return plain_words(sentences[-1]) if sentences else []


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item (its words' places as bit masks) and ``words``."""
    full = (1 << n) - 1
    row = full
    for w in words:
        m = masks.get(w)
        if m:
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | (1 << k)
    return out


class Items:
    """A block of benchmark items over their own vocabulary."""

    def __init__(self, rows: list[tuple[object, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items = []
        for item_id, text in rows:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in plain_words(text)]
            if words:
                answer = [self.vocabulary[w] for w in answer_words(text)]
                self.items.append((item_id, words, answer))
        # an alignment misses at most (1 - SHARED) of the item's words, so at least this many different ones must be there
        self.verify = [(_masks(w), len(w), _masks(a), len(a), frozenset(w), len(set(w)) - int((1 - SHARED) * len(w) + 1e-9)) for _, w, a in self.items]

    def segments(self, size: int) -> list[tuple[int, list[int]]]:
        """(item, words) of the stretches of the items that are sought in passages of ``size`` words."""
        mine = [(k, w) for k, (_, w, _) in enumerate(self.items) if (len(w) <= SHORT) == (size < PASSAGE)]
        return [(k, w[at : at + size]) for k, w in mine for at in _starts(len(w), size)]

    def signs(self) -> np.ndarray:
        """The random sign row of each word, from a hash of the word."""
        bits = np.array([xxhash.xxh3_64_intdigest(w, seed=11) for w in self.vocabulary], np.uint64)
        return (((bits[:, None] >> np.arange(SKETCH, dtype=np.uint64)) & np.uint64(1)).astype(np.int8) * 2 - 1).reshape(-1, SKETCH)


def _ids(vocabulary: dict[bytes, int], text: str | None) -> np.ndarray:
    """The vocabulary ids of a text's words, -1 for other words."""
    words = plain_words(text)
    return np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words))


def numbered(items: Items, text: Column) -> Column:
    """The ids of a text's words as bytes."""

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([_ids(items.vocabulary, t).tobytes() for t in texts], dtype=object)

    return ids(text)


def _held(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32)


def _frequencies(n: int):
    """Rows (word, df): per task, how many documents hold a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(n + 1, np.int64)
        for batch in batches:
            for raw in batch["_ids"]:
                df[np.unique(_held(raw))] += 1  # other words are -1, the last place
        held = np.flatnonzero(df[:n])
        yield pd.DataFrame({"word": held, "df": df[held]})

    return run


def _starts(n: int, size: int) -> range:
    """Where passages of ``size`` words start in a text of n words: every half passage, the last one may be cut."""
    return range(0, max(1, n - size // 2), size // 2)


def _statistics(signs: np.ndarray, weighty: np.ndarray):
    """Rows (word, sums): per task, the rows of the sketch of the words that have weight."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((len(signs), SKETCH), np.int64), np.append(weighty, False)
        for batch in batches:
            held, passage, base = [], [], 0
            for raw in batch["_ids"]:
                ids = _held(raw)
                at = np.flatnonzero(counts[ids])
                held.append(ids[at])
                passage.append(at // PASSAGE + base)
                base += len(ids) // PASSAGE + 1
            words, owner = np.concatenate(held), np.concatenate(passage)
            for lo in range(0, len(words), 1 << 18):
                _sketch(words[lo : lo + (1 << 18)], owner[lo : lo + (1 << 18)], signs, sums)
        some = np.flatnonzero(sums.any(axis=1))
        yield pd.DataFrame({"word": some, "sums": pd.Series(list(sums[some]), dtype=object)})

    return run


def _sketch(words: np.ndarray, owner: np.ndarray, signs: np.ndarray, sums: np.ndarray) -> None:
    """Adds tf_i (tf_i' R) of each passage i; passages cut by a chunk's end count as two."""
    if not len(words):
        return
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    z = np.add.reduceat(signs[words], first, axis=0, dtype=np.int16)
    by = np.argsort(words, kind="stable")
    ordered = words[by]
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    place = np.cumsum(np.r_[False, owner[1:] != owner[:-1]])
    sums[ordered[heads]] += np.add.reduceat(z[place[by]], heads, axis=0, dtype=np.int64)


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """Squared inverse document frequency; nothing for common words."""
    return np.where(df <= COMMON * documents, np.log((1.0 + documents) / (1.0 + df)) ** 2, 0.0)


def latent_words(weight: np.ndarray, sums: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Each word's weighted row in the space of right singular vectors of the weighted passages.

    ``sums`` = T'T R with T the term counts and R the signs. With D the weights, A = T D, so
    Y = D T'T R = (A'A)(D^-1 R), and A'A is about Y (W'Y)^-1 Y' with W = D^-1 R.
    """
    on = weight > 0
    out = np.zeros((len(weight), SKETCH), np.float32)
    if not on.any():
        return out
    y = weight[on, None] * sums[on].astype(np.float64)
    core = (signs[on] / weight[on, None]).T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-10 * values.max(initial=1e-300)
    left, strength, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    kept = left[:, strength > 1e-9 * strength.max(initial=1e-300)]
    out[on, : kept.shape[1]] = weight[on, None] * kept
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _slack(n: int) -> int:
    """How much longer than an item of n words a stretch that holds it may be."""
    return max(4, n // 3)


def verified(ids: list[int], at: int, verify: tuple, width: int = PASSAGE) -> tuple[float, float]:
    """(share of the item, share of its answer) found around the ``width`` words that start at ``at``; the best stretch as long as the item and a bit."""
    masks, n, answer, m, different, least = verify
    lo, hi = max(0, at - n), min(len(ids), at + width + n)
    if len(different.intersection(ids[lo:hi])) < least or common_subsequence(masks, n, ids[lo:hi]) < SHARED * n:
        return 0.0, 0.0
    span, best = n + _slack(n), (0.0, 0.0)
    for s in range(lo, max(lo + 1, hi - span + max(1, n // 8) + 1), max(1, n // 8)):
        part = ids[s : s + span]
        found = common_subsequence(masks, n, part) / n
        if found > best[0]:
            best = (found, common_subsequence(answer, m, part) / m if m else 1.0)
    return best


class Seeds:
    """The rarest words of each item, and which items a word is a seed of.

    A match lacks at most (1 - SHARED) of the item's places. So of words that stand for that many
    places and SEEDS more, it holds some that stand for at least SEEDS, within a stretch as
    long as the item and a bit. An item with too few places for that is sought by all of its
    words, of which a match holds SHARED.
    """

    def __init__(self, items: Items, df: np.ndarray):
        self.words: list[dict[int, int]] = []  # seed -> places of the item that it stands for
        self.need, self.span = [], []
        for _, w, _ in items.items:
            lost, places = int((1 - SHARED) * len(w) + 1e-9), dict.fromkeys(w, 0)
            for x in w:
                places[x] += 1
            own, total = {}, 0
            for x in sorted(places, key=lambda x: (df[x], x)):
                if total >= lost + SEEDS:
                    break
                own[x] = places[x]
                total += places[x]
            self.words.append(own)
            self.need.append(total - lost)
            self.span.append(len(w) + _slack(len(w)))
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        words = np.fromiter((x for w in self.words for x in w), np.int64, sizes.sum())
        by = np.argsort(words, kind="stable")
        self.items = np.repeat(np.arange(len(sizes)), sizes)[by]
        self.stands = np.fromiter((n for w in self.words for n in w.values()), np.int64, sizes.sum())[by]
        self.count = np.append(np.bincount(words, minlength=len(items.vocabulary)), 0)  # other words are -1
        self.first = np.cumsum(self.count) - self.count
        self.seeds = [np.fromiter(w, np.int64, len(w)) for w in self.words]
        self.least = np.array(self.need)

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first, last): where a text holds enough of an item's seeds within its span; overlapping stretches are one."""
        at = np.flatnonzero(self.count[ids])
        if not len(at):
            return
        here = ids[at]
        held = np.unique(here)
        n = self.count[held]
        ends = np.cumsum(n)
        entries = np.arange(ends[-1]) + np.repeat(self.first[held] - ends + n, n)
        owners, inverse = np.unique(self.items[entries], return_inverse=True)
        enough = np.bincount(inverse, self.stands[entries]) >= self.least[owners]
        for k in owners[enough].tolist():
            mine = np.flatnonzero(np.isin(here, self.seeds[k]))
            yield from self._close(k, at[mine].tolist(), here[mine].tolist())

    def _close(self, k: int, places: list[int], words: list[int]) -> Iterator[tuple[int, int, int]]:
        need, span, stands = self.need[k], self.span[k], self.words[k]
        inside: dict[int, int] = {}
        lo, held, region = 0, 0, None
        for p, w in zip(places, words, strict=True):
            if not inside.get(w):
                held += stands[w]
            inside[w] = inside.get(w, 0) + 1
            while p - places[lo] >= span:
                gone = words[lo]
                inside[gone] -= 1
                if not inside[gone]:
                    held -= stands[gone]
                lo += 1
            if held >= need:
                if region is None or places[lo] > region[1]:
                    if region is not None:
                        yield k, *region
                    region = (places[lo], p)
                else:
                    region = (region[0], p)
        if region is not None:
            yield k, *region


def _search(items: Items, weight: np.ndarray, latent: np.ndarray, df: np.ndarray):
    """struct(items, scores) of a text's words: what is verified in it."""
    seeds = Seeds(items, df)
    scales = []
    for size in (PASSAGE // 2, PASSAGE):
        asked = [(k, w) for k, w in items.segments(size) if (weight[w] > 0).any()]
        if asked:
            scales.append((size, _unit(np.stack([latent[w].sum(axis=0) for _, w in asked])), np.array([k for k, _ in asked])))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        heavy = np.append(weight > 0, False)  # other words are -1
        for held in batches:
            hits, scores = [], []
            for raw in held:
                ids = _held(raw)
                named: dict = {}
                for k, share in (_verified_items(ids, heavy) if len(ids) else {}).items():
                    i = items.items[k][0]
                    named[i] = max(share, named.get(i, 0.0))
                order = sorted(named, key=lambda i: (i is None, i or 0))
                hits.append(order)
                scores.append([named[i] for i in order])
            yield pd.DataFrame({"items": pd.Series(hits, dtype=object), "scores": scores})

    def _verified_items(ids: np.ndarray, heavy: np.ndarray) -> dict[int, float]:
        at = np.flatnonzero(heavy[ids])
        pairs: set[tuple[int, int, int]] = set()
        for k, a, b in seeds.stretches(ids):
            more = _slack(items.verify[k][1])
            pairs.add((a - more, k, b - a + 2 * more + 1))
        if len(at) and scales:
            sums = np.zeros((len(at) + 1, latent.shape[1]), np.float32)
            np.cumsum(latent[ids[at]], axis=0, out=sums[1:])
            for size, queries, item_of in scales:
                starts = np.array(_starts(len(ids), size))
                lo, hi = np.searchsorted(at, starts), np.searchsorted(at, starts + size)
                some = np.flatnonzero(hi > lo)
                for part in range(0, len(some), 4096):
                    rows = some[part : part + 4096]
                    place, query = np.nonzero(_unit(sums[hi[rows]] - sums[lo[rows]]) @ queries.T >= COSINE)
                    pairs.update((s, k, PASSAGE) for s, k in zip(starts[rows[place]].tolist(), item_of[query].tolist(), strict=True))
        found: dict[int, float] = {}
        words = ids.tolist() if pairs else []
        for p, k, width in sorted(pairs):
            if found.get(k, 0.0) < VERBATIM:
                share, answered = verified(words, p, items.verify[k], width)
                if share >= VERBATIM or (share >= SHARED and answered >= ANSWERED):
                    found[k] = max(found.get(k, 0.0), share)
        return found

    # evaluated once, wherever its fields are used
    return F.pandas_udf(run, "items array<long>, scores array<double>").asNondeterministic()


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about BLOCK_BYTES; one block is one search of all documents."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for k in range(n):
        yield [(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()]


def _contaminated(df: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str) -> DataFrame:
    """``_c0``... for the columns of ``df``, ``_items`` (ids of the items found) and ``_scores`` (the share of each).

    Per block of the benchmark the rows are written once, with their words as numbers.
    """
    scratch = Scratch(df.sparkSession, "decontaminate")
    body = F.col(f"_c{df.columns.index(text)}")
    found = df.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(df.columns)])
    found = found.withColumn("_items", F.array().cast("array<long>")).withColumn("_scores", F.array().cast("array<double>"))
    for k, rows in enumerate(_blocks(benchmark, item_id, item_text)):
        items = Items(rows)
        if not items.items:
            continue
        with document_batches(df.sparkSession):
            found = scratch.write(found.withColumn("_ids", numbered(items, body)), f"block{k}")
            n, ids = len(items.vocabulary), found.select("_ids")
            # to the driver come as many rows as the block has words
            frequencies = ids.mapInPandas(_frequencies(n), "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).toPandas()
            df_of = np.zeros(n, np.int64)
            df_of[frequencies["word"]] = frequencies["df"]
            weight = weights(df_of, ids.count())
            told = ids.mapInPandas(_statistics(items.signs(), weight > 0), "word long, sums array<long>")
            told = told.groupBy("word").agg(F.array(*[F.sum(F.col("sums")[c]) for c in range(SKETCH)]).alias("sums")).toPandas()
        sums = np.zeros((n, SKETCH), np.int64)
        if len(told):
            sums[told["word"]] = np.stack(told["sums"])
        search = _search(items, weight, latent_words(weight, sums, items.signs()), df_of)
        found = found.withColumn("_r", search(F.col("_ids"))).withColumn("_items", F.concat("_items", "_r.items")).withColumn("_scores", F.concat("_scores", "_r.scores")).drop("_r", "_ids")
    return found


def contamination_report(df: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per contaminated document: id, n_items, item_ids (ascending, comma-joined, "null" last) and the best share found."""
    got = _contaminated(df.select(id_column, text), benchmark, text, item_id, item_text).where(F.size("_items") > 0)
    ids = F.array_sort(F.array_distinct("_items"))
    return got.select(F.col("_c0").alias(id_column), F.size(ids).cast("long").alias("n_items"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",", "null").alias("item_ids"), F.array_max("_scores").alias("score"))


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item of the benchmark, columns unchanged."""
    clean = _contaminated(df, benchmark, text, item_id, item_text).where(F.size("_items") == 0)
    return clean.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(df.columns)])
