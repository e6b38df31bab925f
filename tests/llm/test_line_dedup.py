"""Line dedup against a brute-force version."""

import random

from quorana.llm import line_dedup

MIN = 6


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def brute(docs):
    """docs in order -> removed line numbers of each."""
    seen, out = [], []
    for t in docs:
        gone = []
        for no, line in enumerate(t.split("\n") if t is not None else []):
            if len(line) >= MIN:
                if any(within_one(line, x) for x in seen):
                    gone.append(no)
                seen.append(line)
        out.append(gone)
    return out


def edits(rng, s):
    k, c = rng.randrange(len(s) + 1), rng.choice("abé日x ")
    return rng.choice([s[:k] + c + s[k:], s[:k] + s[k + 1 :], s[:k] + c + s[k + 1 :]])


def corpus():
    rng = random.Random(3)
    seeds = ["aaaaaaaaaa", "the quick brown fox", "é日" * 40, "abcdefgh" * 16, "xy" * 32, "z" * 64, "z" * 65, "short", "q" * 129]
    docs = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(seeds)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                s = edits(rng, s) if s else s
            lines.append(s)
        docs.append("\n".join(lines))
    return docs + ["", None, "\n\n"] + ["w" * 4000, "w" * 2000 + "v" + "w" * 2000]


def test_equals_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, line string")
    got = {r.doc_id: r for r in line_dedup.line_report(df, min_chars=MIN, short_lines=False).collect()}
    for i, want in enumerate(brute(docs)):
        assert got[i].removed_lines == ",".join(map(str, want)), (i, docs[i])
        assert got[i].n_lines == (len(docs[i].split("\n")) if docs[i] is not None else 0)


def test_texts_nulls_and_repeats(spark):
    rows = [(1, "a long enough line\nother content here"), (None, "a long enough line!"), (1, "a long enough line\nother content here"), (2, "other content here\nfresh content now"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.text) for r in line_dedup.dedup_lines(df, min_chars=20, short_lines=False).collect() if r.text is not None)
    assert got == [(1, rows[0][1]), (1, rows[0][1]), (2, "other content here\nfresh content now"), (99, "a long enough line!")]
    got = sorted((r.doc_id or 99, r.text) for r in line_dedup.dedup_lines(df, min_chars=MIN).collect() if r.text is not None)
    assert got == [(1, rows[0][1]), (1, rows[0][1]), (2, "fresh content now"), (99, "")]
    assert line_dedup.line_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines_of_the_query(spark, monkeypatch):
    """op9: short lines with a word go if they equal an earlier one; edits count from six code points on."""
    from quorana.llm import queries

    rows = [(1, "Les.\n}\n\n完了です。\nErheed. Tit\nLes."), (2, "Les.\n}\n\n完了です。\nErheed. Tot\nLet.\n--"), (3, "7\nLes\n--"), (4, "7\nLes"), (None, "Les.\nnew")]
    monkeypatch.setattr(queries, "read", lambda *_: spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.removed_lines for r in queries.op9_lines(spark, "").collect()}
    assert got == {1: "5", 2: "0,3,4", 3: "", 4: "0,1", None: "0"}
