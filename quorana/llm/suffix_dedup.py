"""Exact substring dedup: every byte under a string of WINDOW bytes that also starts earlier goes.

1. Leaders. Each window of WINDOW bytes is led by its GRAM-byte gram of least hash, so equal
   windows have equal leaders at equal places. Consecutive windows of one leader form its
   context. Rows of (leader hash, context hash, document) are the only thing shuffled, a few
   bytes per hundred of text; what repeats within a batch is combined before.
2. Contexts. Sorted by leader and context, the earliest document of each context stays and
   all windows of the others are repeats. A leader with a single context is done. Where a
   leader has several, its contexts differ at an end, and only the earliest of each goes on.
3. Suffix arrays. Those contexts, some per cent of the text, are dealt by leader. Each task
   cuts its contexts into tokens, after some of the blanks by the byte before, never a blank (and at the
   leader, which every window holds), ranks the tokens, and sorts the suffixes at token starts
   by linear grouping (``suffix_order``). Suffixes that share a prefix of bytes are neighbours there, so
   a window is its class among neighbours that agree on its bytes from its first token start
   on, together with the few bytes before. Of each class, all but the earliest are repeats.
   A leader with more than HOT contexts is dealt to several tasks, each of which orders its
   part; the earliest windows of the parts, narrow rows by then, meet by 128 bits of their hash.
4. The documents take their repeats back and drop the bytes under them.

Earlier means a smaller id, or the same row and a smaller start. Documents without an id come
after all others. Rows that share an id, and rows without one, do not remove from each other;
64 bits of the text's hash tell them apart, and equal ones are worked off once.
Null texts are empty; matches never cross rows; overlaps count; strings are judged on the
input. A text may be as long as memory holds; no group of equal strings is ever gathered
beyond one row per distinct context and task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorana.llm.suffix_order import suffix_array
from quorana.workdir import Scratch

WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1  # grams per window
#: Bytes of text hashed at a time; windows compared at a time.
PIECE, PLACE, ROWS = 1 << 16, 17, 1 << 16
#: Bytes of text whose leader rows are combined at a time.
BATCH = 4 << 20
#: Contexts whose suffixes are ordered together, and those of one leader in one task.
RUN, HOT = 1 << 14, 1 << 11
#: The order of documents without an id.
NAMELESS = (1 << 63) - 1

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)
_BYTES, _OTHER = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
#: A token ends in a blank or line end after a byte that is a multiple of four, which is about every fourth word. That byte
#: is no blank itself: two such pairs would overlap in a run of blanks, and which of them ends a token would depend on what
#: stands before the window.
_TOKEN = re.compile(rb"(?s).*?[" + b"".join(b"\\x%02x" % c for c in range(0, 256, 4) if c != 0x20) + rb"][ \n]|.+")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_ODD, PIECE + 2 * WINDOW + 1), _powers(_BACK, PIECE + 2 * WINDOW + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _sums(data: np.ndarray, values: np.ndarray = _BYTES) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _UP[: len(data)], out=out[1:])
    return out


def _least_at(h: np.ndarray, width: int) -> np.ndarray:
    """For each i, the leftmost place of the least of h[i : i + width], by the upper bits of ``h``.

    Places stand in the lower bits, so that one minimum gives both; windows grow by doubling.
    """
    place = _U((1 << PLACE) - 1)
    best = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    return (best & place).astype(np.int64)


def leaders(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, context, first, count, place) for each leader of one text of WINDOW bytes or more.

    ``first`` is the first window start, ``count`` how many windows follow each other under the
    leader, ``place`` the leader's distance from ``first``; ``context`` hashes all their bytes.
    """
    windows = len(data) - WINDOW + 1
    lead, first, keys = [], [], []
    for at in range(0, windows, PIECE):  # pieces overlap by a window
        piece = data[at : at + PIECE + WINDOW - 1]
        sums = _sums(piece)
        grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(piece) - GRAM + 1])
        own = _least_at(grams, SPAN)
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        lead.append(own[starts] + at)
        first.append(starts + at)
        keys.append(grams[own[starts]])
    lead, first, keys = np.concatenate(lead), np.concatenate(first), np.concatenate(keys)
    fresh = np.r_[True, lead[1:] != lead[:-1]]
    lead, first, keys = lead[fresh], first[fresh], keys[fresh]
    count = np.diff(np.r_[first, windows])
    context = np.empty(len(first), np.uint64)
    for at in range(0, len(data), PIECE):
        sums = _sums(data[at : at + PIECE + 2 * WINDOW])
        inside = np.flatnonzero((first >= at) & (first < at + PIECE))
        a = first[inside] - at
        context[inside] = (sums[a + count[inside] + WINDOW - 1] - sums[a]) * _DOWN[a]
    place = lead - first
    context = _mixed(context + _U(_ODD) * (place * 256 + count).astype(np.uint64))
    return keys.view(np.int64), context.view(np.int64), first, count, place


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


#: ``at`` holds first, count and place, which take 7 bits each, and 1 for what is settled.
_LEADERS = "key long, context long, doc long, version long, at long"


def _packed(first: np.ndarray, count: np.ndarray, place: np.ndarray, settled: np.ndarray) -> np.ndarray:
    return first.astype(np.int64) << 17 | count.astype(np.int64) << 9 | place.astype(np.int64) << 1 | settled.astype(np.int64)


def _lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leader rows of (doc, version, text). What a stretch of text repeats of an earlier row of its own is settled here."""
    for batch in batches:
        parts, size = [], 0
        batch = batch[~batch.duplicated(["doc", "version"])]
        for row, (doc, version, text) in enumerate(zip(batch["doc"], batch["version"], batch["text"], strict=True)):
            data = np.frombuffer(_raw(text), np.uint8)
            if len(data) >= WINDOW:
                key, context, first, count, place = leaders(data)
                parts.append((key, context, first, count, place, np.full(len(key), doc), np.full(len(key), version), np.full(len(key), row)))
                size += len(data)
                if size >= BATCH:
                    yield _combined(parts)
                    parts, size = [], 0
        if parts:
            yield _combined(parts)


def _combined(parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    key, context, first, count, place, doc, version, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((first, row, doc, context, key))
    same = np.r_[False, (key[order][1:] == key[order][:-1]) & (context[order][1:] == context[order][:-1])]
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]  # the earliest of each group
    settled = np.zeros(len(key), bool)
    # a row that shares its id with the earliest may still repeat itself
    again = np.r_[False, row[order][1:] == row[order][:-1]] & same
    settled[order] = same & ((doc[order] > doc[head]) | (row[order] == row[head])) | again
    # what is settled only passes through; it is dealt evenly
    key[settled] = _mixed(doc[settled].view(np.uint64) * _U(_ODD) + first[settled].astype(np.uint64)).view(np.int64)
    context[settled] = 0
    return pd.DataFrame({"key": key, "context": context, "doc": doc, "version": version, "at": _packed(first, count, place, settled)})


_FOUND = "doc long, version long, first long, count int, place int, key long, ask boolean"


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From leader rows sorted by all of their columns: repeats, and contexts to ask for. Equal rows count once.

    The first row of a leader is held until the next shows whether the leader has a second context.
    """
    held = None  # the first row of the current key, until it is asked for
    last_key = last_context = head_doc = last_doc = last_version = last_first = last_row = None
    names = ["doc", "version", "first", "count", "place", "key"]
    for batch in batches:
        if not len(batch):
            continue
        own = batch.to_numpy()
        fresh = np.r_[last_row is None or bool((own[0] != last_row).any()), (own[1:] != own[:-1]).any(axis=1)]
        last_row = own[-1].copy()
        batch = batch[fresh]
        at = batch["at"].to_numpy()
        batch = batch.assign(first=at >> 17, count=(at >> 9 & 255).astype(np.int32), place=(at >> 1 & 255).astype(np.int32))
        settled = (at & 1).astype(bool)
        out = [batch[settled][names].assign(ask=False)]
        rest = batch[~settled]
        if len(rest):
            key, context, doc = (rest[c].to_numpy() for c in ("key", "context", "doc"))
            new_key = np.r_[last_key is None or key[0] != last_key, key[1:] != key[:-1]]
            new_context = new_key | np.r_[last_context is None or context[0] != last_context, context[1:] != context[:-1]]
            begin = np.maximum.accumulate(np.where(new_context, np.arange(len(rest)), -1))
            head = np.where(begin >= 0, doc[np.maximum(begin, 0)], head_doc or 0)
            version, first = rest["version"].to_numpy(), rest["first"].to_numpy()
            before = lambda x, last: np.r_[x[:1] if last is None else last, x[:-1]]
            later = ~new_context & (doc == before(doc, last_doc)) & (version == before(version, last_version)) & (first > before(first, last_first))
            repeats = (doc > head) | later
            out.append(rest[repeats][names].assign(ask=False))
            # the earliest of each context, and other rows of its id, which it does not settle
            heads = np.flatnonzero(~repeats)
            group = np.cumsum(new_key)[heads]
            several = np.bincount(group, minlength=1)[group] > 1 if len(heads) else np.zeros(0, bool)
            goes_on = group == 0  # of a key that the batch before began
            if goes_on.any() and held is not None:
                out.append(held.assign(ask=True))
                held = None
            out.append(rest.iloc[heads[several | goes_on]][names].assign(ask=True))
            if new_key.any():
                mine = heads[group == group[-1]] if len(heads) else heads
                held = rest.iloc[mine][names] if len(mine) == 1 else None
            last_key, last_context, head_doc = key[-1], context[-1], head[-1]
            last_doc, last_version, last_first = doc[-1], version[-1], first[-1]
        yield pd.concat(out, ignore_index=True)


def repeated_windows(contexts: list[bytes], docs: np.ndarray, rows: np.ndarray, firsts: np.ndarray, counts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For contexts of any leaders, a flag per window (contexts in order, windows in order): it starts earlier elsewhere."""
    buffer = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    base = np.cumsum(sizes) - sizes
    # tokens of the part before the leader and of the part from it on
    tokens: list[bytes] = []
    per_context = []
    for c, a in zip(contexts, places.tolist(), strict=True):
        own = _TOKEN.findall(c[:a]) + _TOKEN.findall(c[a:])
        tokens += own
        per_context.append(len(own))
    per_context = np.array(per_context)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.cumsum(lengths) - lengths
    rank = {t: k for k, t in enumerate(sorted(set(tokens)))}
    # symbols: tokens by rank above one separator per context; the last separator is the least
    n = len(contexts)
    ends = np.cumsum(per_context)
    symbols = np.empty(len(tokens) + n, np.int64)
    token_at = np.arange(len(tokens)) + np.repeat(np.arange(n), per_context)
    symbols[token_at] = np.fromiter((rank[t] for t in tokens), np.int64, len(tokens)) + n
    symbols[ends + np.arange(n)] = np.arange(n)[::-1]
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    which = np.full(len(symbols), -1, np.int64)
    which[token_at] = np.arange(len(tokens))
    sorted_tokens = which[order]
    sorted_tokens = sorted_tokens[sorted_tokens >= 0]
    place_in_order = np.empty(len(tokens), np.int64)
    place_in_order[sorted_tokens] = np.arange(len(tokens))

    # bytes that neighbours in the order share, up to WINDOW and the ends of their contexts
    at = starts[sorted_tokens]
    left_in = np.repeat(base + sizes, per_context)[sorted_tokens] - at
    padded = np.concatenate([buffer, np.zeros(WINDOW, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    shared = np.zeros(len(at), np.int64)
    for k in range(1, len(at), ROWS):
        hi = min(len(at), k + ROWS)
        differ = view[at[k:hi]] != view[at[k - 1 : hi - 1]]
        shared[k:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), WINDOW)
        shared[k:hi] = np.minimum(shared[k:hi], np.minimum(left_in[k:hi], left_in[k - 1 : hi - 1]))

    owner = np.repeat(np.arange(n), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = base[owner] + offset
    lead = base[owner] + places[owner]
    # the first token start whose two deciding bytes lie in the window, or the leader
    token = np.minimum(np.searchsorted(starts, start + 2, side="left"), np.searchsorted(starts, lead, side="left"))
    ahead = starts[token] - start
    head = np.zeros(len(start), np.uint64)
    for k in range(1, int(ahead.max(initial=0)) + 1):
        more = ahead >= k
        head[more] = _mixed(head[more] * _U(_ODD) + _BYTES[buffer[start[more] + k - 1]])

    doc, row, first = docs[owner], rows[owner], firsts[owner] + offset
    flags = np.zeros(len(start), bool)
    for o in np.unique(ahead):
        mine = np.flatnonzero(ahead == o)
        neighbours = np.cumsum(shared < WINDOW - o)[place_in_order[token[mine]]]
        by = np.lexsort((first[mine], row[mine], doc[mine], head[mine], neighbours))
        m = mine[by]
        same = np.r_[False, (neighbours[by][1:] == neighbours[by][:-1]) & (head[m][1:] == head[m][:-1])]
        top = np.maximum.accumulate(np.where(same, 0, np.arange(len(m))))
        own_row = np.r_[False, row[m][1:] == row[m][:-1]] & same
        flags[m] = same & (doc[m] > doc[m[top]]) | own_row
    return flags


#: Repeats, or for leaders in parts also the windows that are the earliest of theirs, with the hash they meet by.
_ORDERED = "doc long, version long, lo long, hi long, key long, context long, first boolean"


def _order_suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Intervals of repeated windows from rows (key, part, parts, doc, version, first, count, place, bytes) sorted by key and part.

    Equal windows of a part have equal keys, so the rows are worked off in runs of whole parts of bounded size.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= RUN:
            rows = pd.concat(held, ignore_index=True)
            tail = (rows["key"] == rows["key"].iloc[-1]) & (rows["part"] == rows["part"].iloc[-1])
            if not tail.all():
                yield _ordered(rows[~tail])
                held = [rows[tail]]
            else:
                held = [rows]
    if held and sum(map(len, held)):
        yield _ordered(pd.concat(held, ignore_index=True))


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    docs, versions = rows["doc"].to_numpy(), rows["version"].to_numpy()
    firsts, counts, places = (rows[c].to_numpy().astype(np.int64) for c in ("first", "count", "place"))
    row = docs.view(np.uint64) * _U(_ODD) + versions.view(np.uint64)
    flags = repeated_windows(rows["bytes"].tolist(), docs, row, firsts, counts, places)
    owner = np.repeat(np.arange(len(rows)), counts)
    start = firsts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    on = np.flatnonzero(flags)
    cut = np.r_[True, (np.diff(on) != 1) | (owner[on][1:] != owner[on][:-1])] if len(on) else np.zeros(0, bool)
    a = on[cut]
    b = on[np.r_[cut[1:], True]] if len(on) else a
    out = [pd.DataFrame({"doc": docs[owner[a]], "version": versions[owner[a]], "lo": start[a], "hi": start[b] + WINDOW, "key": 0, "context": 0, "first": False})]
    split = np.flatnonzero(rows["parts"].to_numpy() > 1)
    if len(split):
        hashes = [(_window_hashes(raw, n, _BYTES), _window_hashes(raw, n, _OTHER)) for raw, n in zip(rows["bytes"].iloc[split], counts[split].tolist(), strict=True)]
        mine = np.isin(owner, split)
        key, context = (np.concatenate(x) for x in zip(*hashes, strict=True))
        go = ~flags[mine]
        w = np.flatnonzero(mine)[go]
        out.append(pd.DataFrame({"doc": docs[owner[w]], "version": versions[owner[w]], "lo": start[w], "hi": start[w] + WINDOW, "key": key[go], "context": context[go], "first": True}))
    return pd.concat(out, ignore_index=True)


def _window_hashes(raw: bytes, n: int, values: np.ndarray) -> np.ndarray:
    sums = _sums(np.frombuffer(raw, np.uint8), values)
    return _mixed((sums[WINDOW:] - sums[:-WINDOW])[:n] * _DOWN[:n]).view(np.int64)


def _merged(lo: np.ndarray | None, hi: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint removed runs; touching runs are one."""
    if lo is None or not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], np.maximum.accumulate(hi[by])
    new = np.r_[True, lo[1:] > hi[:-1]]
    return lo[new], np.minimum(hi[np.r_[np.flatnonzero(new)[1:] - 1, len(hi) - 1]], n)


def _kept(text: str | None, lo: np.ndarray | None, hi: np.ndarray | None) -> tuple[bytes, int, int]:
    raw = _raw(text)
    lo, hi = _merged(lo, hi, len(raw))
    edges = np.r_[0, np.stack([lo, hi], 1).ravel(), len(raw)].tolist()
    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return kept, len(raw) - len(kept), len(lo)


def repeated_spans(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, version, lo, hi): the repeated byte ranges of each row that has any, as two lists; ranges may overlap.

    ``doc`` is the id, NAMELESS for null; ``version`` (64 bits of the text's hash) tells rows of one id apart.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "suffixes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = keyed(df, id_column, text)
    columns = ("key", "context", "doc", "version", "at")
    sorted_rows = docs.mapInPandas(_lead, _LEADERS).repartition(parts, "key").sortWithinPartitions(*columns)
    found = scratch.write(sorted_rows.mapInPandas(_settle, _FOUND), "found")
    scratch.settle()

    asked = found.where("ask").drop("ask")
    sizes = scratch.write(asked.groupBy("key").agg(F.ceil(F.count("*") / HOT).alias("parts")).where("parts > 1"), "sizes")
    asked = asked.join(sizes, "key", "left").withColumnRenamed("doc", "d").withColumnRenamed("version", "v").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    piece = F.substring(F.col("text").cast("binary"), F.col("first").cast("int") + 1, F.col("count") + WINDOW - 1)
    wanted = docs.join(asked, (F.col("doc") == F.col("d")) & (F.col("version") == F.col("v"))).select("key", "parts", "doc", "version", "first", "count", "place", piece.alias("bytes")).distinct()
    wanted = scratch.write(wanted, "contexts").withColumn("part", F.pmod(F.xxhash64("bytes"), F.col("parts")))
    scratch.settle()

    ordered = wanted.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "doc", "first").mapInPandas(_order_suffixes, _ORDERED)
    ordered = scratch.write(ordered, "ordered")
    scratch.drop("contexts")
    one = F.shiftleft(F.col("lo"), 17).bitwiseOR(F.lit(1 << 9))  # a window is a leader's only one, at place 0
    firsts = ordered.where("first").select("key", "context", "doc", "version", one.alias("at"))
    met = firsts.repartition(parts, "key", "context").sortWithinPartitions(*columns).mapInPandas(_settle, _FOUND).where(~F.col("ask"))
    scratch.settle()
    runs = _intervals(found.where(~F.col("ask"))).unionByName(ordered.where(~F.col("first")).select("doc", "version", "lo", "hi")).unionByName(_intervals(met))
    return runs.groupBy("doc", "version").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))


def _intervals(found: DataFrame) -> DataFrame:
    return found.select("doc", "version", F.col("first").alias("lo"), (F.col("first") + F.col("count") + WINDOW - 1).alias("hi"))


def keyed(df: DataFrame, id_column: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc, version, text, ...) of every row."""
    body = F.col(text)
    return df.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NAMELESS)).alias("doc"), F.xxhash64(body).alias("version"), body.alias("text"), *[F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)])


def substring_report(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_removed, n_spans (maximal removed runs) and the digest of what stays."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def told(texts: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
        out = []
        for t, a, b in zip(texts, lo, hi, strict=True):
            kept, gone, runs = _kept(t, a, b)
            out.append((len(kept) + gone, gone, runs, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    got = keyed(df, id_column, text).join(repeated_spans(df, id_column, text), ["doc", "version"], "left")
    return got.select(F.when(F.col("doc") != NAMELESS, F.col("doc")).alias(id_column), told(F.col("text"), F.col("lo"), F.col("hi")).alias("r")).select(id_column, "r.*")


def dedup_substrings(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the repeated bytes cut from its texts; a character that loses a byte goes whole."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _kept(t, a, b)[0].decode("utf-8", "ignore") for t, a, b in zip(texts, lo, hi, strict=True)], dtype=object)

    got = keyed(df, id_column, text, tuple(df.columns)).join(repeated_spans(df, id_column, text), ["doc", "version"], "left")
    return got.select(*[(cut(F.col("text"), F.col("lo"), F.col("hi")) if c == text else F.col(f"_c{k}")).alias(c) for k, c in enumerate(df.columns)])
