"""Near-duplicates against brute force over all pairs, and the estimator against its variance."""

import collections
import random
import re

import numpy as np
import pytest

from quorana.llm import near_dedup
from quorana.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, percent):
    """rows of unique ids -> {id: (n, component)}"""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    p, q = top(a), top(b)
                    parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 40, 120, 300]))]
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = word()
            texts.append(rng.choice([" ", "\n", "\t"]).join(w) if rng.random() < 0.9 else " ".join(w).upper())
    return texts + ["", None, " \n ", "A b c", "a B c", "a b c d"]


@pytest.mark.parametrize("percent", [85, 80])
def test_components_equal_brute_force(spark, percent):
    rows = list(zip(random.Random(percent).sample(range(10_000), len(corpus())), corpus()))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, percent).collect()}
    assert got == brute(rows, percent)


@pytest.mark.parametrize("percent", [85, 80])
def test_what_the_hubs_leave_apart_is_found_by_rare_shingles(spark, monkeypatch, percent):
    monkeypatch.setattr(near_dedup._Search, "hub_links", lambda self: self.scratch.write(spark.createDataFrame([], "a long, b long"), "none"))
    rows = list(enumerate(corpus(percent)))
    monkeypatch.setattr(near_dedup._Search, "open_classes", lambda self, merged: (self.scratch.write(self.members.select("id", near_dedup.F.col("id").alias("root")), "all"), 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, percent).collect()}
    assert got == brute(rows, percent)


def test_documents_of_one_template_do_not_meet(spark):
    template = [f"t{i}" for i in range(80)]
    rng = random.Random(5)
    rows = [(i, " ".join(template + [f"own{rng.random()}" for _ in range(40)])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    with near_dedup.document_batches(spark):
        search = near_dedup._Search(df, 85, "doc_id", "text")
        rest, n = search.open_classes(spark.createDataFrame([], "node long, root long"))
        assert n > 100
        assert search.prefix_links(rest).count() == 0
        assert spark.read.parquet(f"{search.scratch.root}/pairs-rest").count() == 0
    assert near_dedup.near_duplicates(df, 85).where("kept").count() == 300


def test_filter_keeps_the_smallest_id_and_all_columns(spark):
    rows = [(i, t, "k") for i, t in enumerate(corpus(2))]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, root string, node int, gone int, _dropped int")
    kept = near_dedup.near_dedup(df, 80)
    want = brute([(i, t) for i, t, _ in rows], 80)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_repeated_and_missing_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(4, a), (2, a), (2, b), (9, b), (None, a), (None, "alone in the world of words")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 2, False), (2, 2, True), (2, 2, True), (9, 2, False), (None, 2, False), (None, None, True)], key=str)
    assert near_dedup.near_duplicates(spark.createDataFrame([], df.schema)).count() == 0
    c = " ".join(f"c{i}" for i in range(30))
    df = spark.createDataFrame([(None, c), (None, c), (None, c + " end"), (None, a), (4, a), (None, ""), (None, None), (None, " ")], "doc_id long, text string")
    kept = near_dedup.near_dedup(df).collect()
    assert len(kept) == 5 and sum(r.text in (c, c + " end") for r in kept) == 1 and (4, a) in kept and sum(not (r.text or "").strip() for r in kept) == 3
    assert {r.component_id for r in near_dedup.near_duplicates(df).collect()} == {None, 4}


def test_signatures_estimate_similarity_with_less_variance_than_independent_hashes():
    rng = np.random.default_rng(3)
    estimates = []
    for _ in range(200):
        x = rng.integers(0, 2**63, 40).astype(np.uint64)
        s = near_dedup.superminhash([np.sort(x[:30]), np.sort(x[10:])])
        estimates.append((s[0] == s[1]).mean())
    assert abs(np.mean(estimates) - 0.5) < 0.01
    assert np.std(estimates) < 0.9 * (0.25 / near_dedup.COMPONENTS) ** 0.5


def test_components_of_a_long_chain(spark):
    ids = random.Random(1).sample(range(1000), 200)
    links = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])] + [(2000, 2001), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert all(got.get(i, i) == min(ids) for i in ids) and got[2001] == 2000 and len(got) == 200
    assert collections.Counter(got.values())[min(ids)] == 199
