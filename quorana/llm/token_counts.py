"""Exact token counts at every prefix of a text, by dynamic programming.

For byte-level BPE, the encoding of a prefix ends in one token, and what stands before
that token is the encoding of a shorter prefix. So ``count[i] = count[i - len(t)] + 1``
with ``t`` the only vocabulary entry that ends at ``i`` and may follow the last token of
the shorter prefix: encoding both together must give back the same two tokens. One pass
over a piece of the pre-tokeniser fills the table; a text's table is put together from
those of its pieces. Truncation and budget questions are then look-ups.

Null and empty texts have the table [0]. A special string inside a text counts as the
library counts it: one token, which also cuts the text for the pre-tokeniser.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorana.llm.columns import free_name

#: Pieces that a worker remembers (each a few dozen bytes); beyond it the memory starts anew.
REMEMBERED_PIECES = 1_000_000
NEVER = 1 << 60
#: Longer pieces are rare and are not remembered.
LONGEST_REMEMBERED = 64


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Prefix tables under one byte-level BPE vocabulary file."""

    def __init__(self, vocabulary: str, pattern: str):
        with open(vocabulary, encoding="utf-8") as f:
            told = json.load(f)
        as_byte = _byte_symbols()
        raw = lambda s: bytes(as_byte[c] for c in s)
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for (a, b), k in self.rank.items():
            self.made.setdefault(a + b, (k, a, b))
        self.vocab = {raw(s): k for k, s in enumerate(x for x in told["model"]["vocab"] if all(c in as_byte for c in x))}
        self.tokens = list(self.vocab)
        self.longest = max(map(len, self.vocab))
        self.special = [t["content"] for t in told["added_tokens"]]
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._pieces = regex.compile(pattern).findall
        self._runs = regex.compile(r"\s{2,}(?=\S)").finditer
        self._pair: dict[int, bool] = {}
        self._table: dict[str, bytes] = {}

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The symbols that stand at one edge of a token while it is built, each with the rank of the merge that ends it."""
        out, ends = [], NEVER
        while True:
            out.append((token, ends))
            made = self.made.get(token)
            if made is None:
                return out[::-1]
            ends, token = made[0], made[1 + side]

    def _seam_holds(self, a: bytes, b: bytes) -> bool:
        """Whether the encoding of a + b is a, b: no merge across the seam comes before those that build a and b."""
        left, right, rank = self._spine(a, 1), self._spine(b, 0), self.rank.get
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            across = rank((x, y), NEVER)
            if across < x_ends and across <= y_ends and across < NEVER:  # of equal ranks the leftmost pair merges first
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _merge(self, word: bytes) -> list[bytes]:
        """The plain merge loop, for single vocabulary entries."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min((self.rank.get(p, NEVER), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == NEVER:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _may_follow(self, pair: int) -> bool:
        """Whether the encoding of two entries side by side is those two (or of one alone, with none before, that one)."""
        if len(self._pair) > REMEMBERED_PIECES:
            self._pair.clear()
        a, b = divmod(pair, len(self.tokens))
        before = self.tokens[a - 1] if a else b""
        token = self.tokens[b]
        got = self._pair[pair] = self._seam_holds(before, token) if a else self._merge(token) == [token]
        return got

    def _bytes_table(self, piece: bytes) -> list[int]:
        """Token counts of all byte prefixes of one piece."""
        entry, known, longest, width = self.vocab.get, self._pair.get, self.longest, len(self.tokens)
        count, last = [0], [0]  # last: 1 + the entry that ends there, times the number of entries
        for i in range(1, len(piece) + 1):
            for j in range(i - 1, i - longest - 1 if i > longest else -1, -1):  # exactly one fits, most likely a short one
                t = entry(piece[j:i])
                if t is not None:
                    pair = last[j] + t
                    ok = known(pair)
                    if ok is None:
                        ok = self._may_follow(pair)
                    if ok:
                        count.append(count[j] + 1)
                        last.append((t + 1) * width)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return count

    def _piece_table(self, piece: str) -> array:
        """Counts (int32) of the code point prefixes 1..n of one piece, each cut as the pre-tokeniser cuts the prefix."""
        raw = piece.encode()
        table = self._bytes_table(raw)
        if len(raw) == len(piece):
            out = table[1:]
        else:
            out, at = [], 0
            for c in piece:
                at += len(c.encode())
                out.append(table[at])
        if piece[0] == "'" and len(piece) > 2:  # a contraction cut short falls into two pieces
            out = [sum(self._bytes_table(x.encode())[-1] for x in self._pieces(piece[:q])) for q in range(1, len(piece))] + [out[-1]]
        return array("i", out)

    def _of_piece(self, piece: str) -> bytes:
        got = self._table.get(piece)
        if got is None:
            got = self._piece_table(piece).tobytes()
            if len(piece) <= LONGEST_REMEMBERED:
                if len(self._table) >= REMEMBERED_PIECES:
                    self._table.clear()
                self._table[piece] = got
        return got

    def _segment(self, text: str) -> np.ndarray:
        """Counts of the prefixes 1..n of a text without special strings."""
        if not text:
            return np.zeros(0, np.int32)
        pieces = self._pieces(text)
        known = self._table.get
        tables = [known(p) or self._of_piece(p) for p in pieces]
        inner = np.frombuffer(b"".join(tables), dtype=np.int32)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(lengths)
        totals = inner[ends - 1].astype(np.int64)
        base = np.cumsum(totals) - totals
        counts = (np.repeat(base, lengths) + inner).astype(np.int32)
        for run in self._runs(text):  # a prefix that ends in white space takes the whole run as one piece
            a, b = run.span()
            counts[a:b] = (counts[a - 1] if a else 0) + np.frombuffer(self._of_piece(text[a:b]), dtype=np.int32)
        return counts

    def table(self, text: str | None) -> np.ndarray:
        """``table[p]`` is the number of tokens of the first p code points; int32, one entry more than there are code points."""
        text = text or ""
        found = list(self._special.finditer(text)) if self._special and any(s in text for s in self.special) else []
        parts, at, base = [np.zeros(1, np.int32)], 0, 0
        for m in found:
            own = self._segment(text[at : m.start()])
            parts.append(own + base)
            # inside the special string it is still ordinary text, which joins the last pieces before it
            cut = [self._segment(text[at : m.start() + q])[-1] for q in range(1, len(m[0]))]
            parts.append(np.array(cut, np.int32) + base)
            base += (int(own[-1]) if len(own) else 0) + 1
            parts.append(np.array([base], np.int32))
            at = m.end()
        parts.append(self._segment(text[at:]) + np.int32(base))
        return np.concatenate(parts)


def longest_within(table: np.ndarray, budget: int) -> int:
    """The most code points whose prefix has at most ``budget`` tokens."""
    return int(np.flatnonzero(table <= budget)[-1])


@lru_cache(maxsize=2)
def counter(vocabulary: str, pattern: str) -> PrefixCounter:
    """One counter for each worker process and vocabulary."""
    return PrefixCounter(vocabulary, pattern)


def answers(text: Column, vocabulary: str, pattern: str, budget: int) -> Column:
    """struct(n_tokens, fit_chars): the count of the whole text, and the most code points within ``budget`` tokens."""

    @F.pandas_udf("n_tokens long, fit_chars long")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = counter(vocabulary, pattern)
        for texts in batches:
            rows = []
            for t in texts:
                table = tables.table(t)
                rows.append((int(table[-1]), len(table) - 1 if table[-1] <= budget and table.max() <= budget else longest_within(table, budget)))
            yield pd.DataFrame(rows, columns=["n_tokens", "fit_chars"])

    return ask(text)


def with_prefix_tables(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "prefix_counts") -> DataFrame:
    """Adds the whole table of each text as little-endian int32 values, for questions that come later."""

    @F.pandas_udf("binary")
    def tables(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(vocabulary, pattern)
        for texts in batches:
            yield pd.Series([own.table(t).astype("<i4").tobytes() for t in texts], dtype=object)

    return df.withColumn(out, tables(F.col(text)))


def count_at(table: Column, prefix: Column) -> Column:
    """The stored count of the first ``prefix`` code points of a table from ``with_prefix_tables``; null beyond its end."""
    four = F.substring(table, (prefix * 4 + 1).cast("int"), F.lit(4))
    h = F.hex(four)
    turned = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return F.when(prefix * 4 < F.octet_length(table), F.conv(turned, 16, 10).cast("long"))


ADDED = ("n_bytes", "n_tokens", "over_limit", "fit_chars")


def token_counts(df: DataFrame, vocabulary: str, pattern: str, budget: int = 1024, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens, over_limit (more than ``budget`` tokens) and fit_chars (code points within it).

    The columns of ``df`` stay as they are; a new one whose name is taken gets underscores behind it.
    """
    told, names = free_name(df, "_answers"), [free_name(df, n) for n in ADDED]
    got = df.withColumn(told, answers(F.col(text), vocabulary, pattern, budget))
    counted = F.col(f"{told}.n_tokens")
    return got.withColumns({names[0]: F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), names[1]: counted, names[2]: counted > budget, names[3]: F.col(f"{told}.fit_chars")}).drop(told)
