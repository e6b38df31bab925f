"""Water-filling and shards against brute force, with hot and null sources."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest

from quorana.llm import mixing, sharding


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        source = rng.choice([None, "a", "é", "z", "B", "b2", "tiny"] + ["hot"] * 4) if d else "tiny"
        text = None if d % 41 == 5 else " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 3 if source == "tiny" else 80)))
        rows.append((d if d % 50 != 7 else None, text, source, "k"))
    return rows + rows[10:13]


def targets(sizes, weights):
    """The clamped shares by bisection on the level."""
    total, lo, hi = sum(sizes.values()), 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * sizes[s], weights[s] * mid) for s in sizes) < total else (lo, mid)
    return {s: min(3 * sizes[s], weights[s] * hi) for s in sizes}


def test_mixing_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mixing_plan(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").split())
    by = collections.defaultdict(int)
    for _, t, s, _ in rows:
        by[s] += size(t)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = targets(by, dict(zip(order, itertools.cycle([5, 2, 1]))))
    for s in by:
        mine = [r for r in got if r.target == pytest.approx(want[s]) and r.source_size == by[s]]
        assert mine and abs(sum(r.taken for r in mine) - want[s]) <= max(r.size for r in mine)
    assert all(r.taken <= 3 * r.size and r.taken == r.size * r.repeats for r in got)
    again = mixing.mixing_plan(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_repeats_rows_with_their_columns(spark):
    df = spark.createDataFrame(corpus(200, 2), "doc_id long, text string, source string, size string")
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    want = collections.Counter()
    for r in mixing.mixing_plan(df).collect():
        want[r.doc_id] += r.repeats
    assert collections.Counter(r.doc_id for r in mixed.collect()) == +want
    empty = spark.createDataFrame([], df.schema)
    assert mixing.mixing_plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_rows_with_one_id_or_none_do_not_share_a_bucket(spark):
    df = spark.createDataFrame([(None if i % 2 else 7, f"text {i}", "a") for i in range(2000)], "doc_id long, text string, source string")
    per = df.groupBy(mixing._hash(7, "doc_id", "text")).count()
    assert per.count() == 2000


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        index = sharding.hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards(spark):
    rows = [(d, t, s, "en" if d and d % 2 else None) for d, t, s, _ in corpus(300, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = sharding.shard_table(df, 8).collect()
    assert len(got) == len(rows)
    slots, sums = collections.defaultdict(list), collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    largest = max(r.size for r in got)
    assert max(sums[k] for k in range(8)) - min(sums[k] for k in range(8)) <= 2 * largest
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    whole = sharding.hilbert_shards(df, 8)
    assert whole.columns == [*df.columns, "size", "text_crc32", "shard", "slot"]
    assert {(r.shard, r.slot) for r in whole.collect()} == {(r.shard, r.slot) for r in got}


def test_shards_prune_on_metadata(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(d, "x" * rng.randint(1, 4000), f"s{rng.randrange(6)}", rng.choice(["en", "fr"])) for d in range(600)], "doc_id long, text string, source string, lang string")
    got = sharding.hilbert_shards(df, 16).collect()
    met = {(r.shard, r.lang, r.source, len(r.text).bit_length()) for r in got}
    dealt = {(k % 16, r.lang, r.source, len(r.text).bit_length()) for k, r in enumerate(sorted(got, key=lambda r: r.doc_id))}
    assert len(met) < 0.6 * len(dealt)


def test_few_or_no_documents(spark):
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    got = sharding.shard_table(one)
    assert [(r.shard, r.slot, r.size) for r in got.collect()] == [(4, 0, 2)]
    assert dict(got.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    assert sharding.shard_table(one.limit(0)).count() == 0
