"""Substring dedup against a brute-force version, and suffix arrays against sorting."""

import hashlib
import random

import pytest
import xxhash

from quorana.llm import suffix_dedup
from quorana.llm.suffix_order import suffix_array

W = suffix_dedup.WINDOW


def brute(rows):
    """(id, text) rows -> (n_bytes, n_removed, n_spans, digest) of each; ids ascending, None last."""
    raws = [(t or "").encode() for _, t in rows]
    order = lambda r: (rows[r][0] is None, rows[r][0] or 0)
    earliest = {}
    for r, b in enumerate(raws):
        for p in range(len(b) - W + 1):
            s = b[p : p + W]
            earliest[s] = min(earliest.get(s, order(r)), order(r))
    out = []
    for r, b in enumerate(raws):
        gone, own = bytearray(len(b)), set()
        for p in range(len(b) - W + 1):
            s = b[p : p + W]
            if s in own or earliest[s] < order(r):
                gone[p : p + W] = b"\1" * W
            own.add(s)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé日 ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(40) for _ in range(4)] + ["x" * 260, "ab" * 150, prose(12).replace(" ", ""), "\n".join(prose(5) for _ in range(9))]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice(["", "!", "é"]) + p[k + rng.randint(0, 1) :]
            if rng.random() < 0.3:
                p = p[rng.randrange(len(p)) :]
            parts += [p, prose(rng.randint(0, 12))]
        texts.append("".join(parts))
    return texts + [texts[0], texts[1] * 2, "", None, "short"]


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, doc int, version string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.substring_report(df).collect()))
    want = sorted((i is None, i or 0, *b) for (i, _), b in zip(rows, brute(rows)))
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(1000), len(texts))
    check(spark, list(zip(ids, texts)))


def test_runs_of_blanks(spark):
    """Passages that begin in runs of blanks and line ends, after texts of either parity."""
    rng = random.Random(5)
    gap = lambda: rng.choice([" ", "  ", "   ", "    ", " \n", "\n   ", "      "])
    prose = lambda n: "".join(gap() + "".join(rng.choice("abcd:(") for _ in range(rng.randint(1, 6))) for _ in range(n))
    passages = [gap() * rng.randint(1, 4) + prose(25) for _ in range(8)]
    texts = ["".join(rng.choice(["if x:", "def f: ", "word", "end.", "d", "", " "]) + prose(rng.randint(0, 6)) + " " * rng.randint(0, 5) + rng.choice(passages) for _ in range(rng.randint(1, 3))) for _ in range(80)]
    check(spark, list(enumerate(texts)))


@pytest.mark.parametrize("hot", [2, 7])
def test_leaders_dealt_to_several_tasks(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = corpus(3)
    check(spark, list(enumerate(texts)))


def test_nameless_rows_whose_hashes_agree_in_31_bits(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    seen, pair = {}, None
    while pair is None:
        own = "".join(rng.choice("ijklmnop ") for _ in range(150))
        for t in (passage + own, own + own[::-1]):
            other = seen.setdefault(xxhash.xxh64_intdigest(t.encode(), 42) & 0x7FFFFFFF, t)
            if other != t and (passage in other) != (passage in t):
                pair = (other, t)
    check(spark, [(1, passage), *((None, t) for t in pair)])


def test_many_equal_nameless_rows(spark):
    p = "one passage that stands twice in a text without an id, and in ever so many copies of that text, each judged alone " * 2
    check(spark, [(None, p + "and " + p)] * 3000 + [(None, "z" + p), (7, "unrelated " + p[:50])])
    found = suffix_dedup.repeated_spans(spark.createDataFrame([(None, p + "and " + p)] * 3000, "doc_id long, text string")).collect()
    assert len(found) == 1 and len(found[0].lo) < 20


def test_repeated_and_missing_ids(spark):
    p = "the same passage of text, long enough to count as a repeat when it is found in two places of the corpus " * 2
    check(spark, [(5, p + "a"), (5, "b" + p), (None, "c" + p), (None, p), (9, p), (2, "unrelated")])


def test_texts_lose_whole_characters(spark):
    p = "é" * 120
    rows = [(1, p), (2, "ab" + p + "yz"), (3, None)]
    got = {r.doc_id: r.text for r in suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].startswith("ab") and got[2].endswith("yz") and len(got[2]) < 10 and got[3] is None
    assert suffix_dedup.substring_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_array_equals_sorting():
    rng = random.Random(4)
    for _ in range(2000):
        s = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 24))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
