"""The pipeline against a brute-force version of its stages, on documents with planted cases."""

import collections
import random

import corpus_pipeline
from test_quality import brute as measured


def words(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "tu", "re", "sa", "vo", "ne"]) for _ in range(rng.randint(2, 4))) for _ in range(n))


def corpus(seed=4):
    rng = random.Random(seed)
    items = [(i, words(rng, 30)) for i in range(4)]
    docs, bad, copies, leaks = [], set(), {}, set()
    for d in range(90):
        text = words(rng, rng.randint(30, 150))
        if d % 11 == 3:
            text = rng.choice(["too short", "again and again so it goes " * 20, "### $$ && %% " * 20])
            bad.add(d)
        elif d % 9 == 4 and d:
            of = rng.choice([x for x, _ in docs if x not in bad and x not in leaks and x not in copies])
            text = dict(docs)[of] + rng.choice(["", " and"])
            copies[d] = of
        elif d % 13 == 6:
            text = text + " " + rng.choice(items)[1]
            leaks.add(d)
        docs.append((d, text))
    rows = [(d, t, "en", f"s{d % 4}", len(t)) for d, t in docs]
    return rows, items, bad, copies, leaks


def test_stages(spark, tmp_path):
    rows, items, bad, copies, leaks = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(collections.Counter(r.doc_id for r in docs.collect()))
        if k < 4:
            assert docs.columns == columns
    all_ids = {r[0] for r in rows}
    assert set(kept[0]) == all_ids - bad
    assert set(kept[1]) == all_ids - bad - set(copies)
    assert set(kept[2]) == all_ids - bad - set(copies) - leaks

    left = [r for r in rows if r[0] in kept[2]]
    size = {r[0]: measured(r[1])[0] for r in left}
    by_source = collections.defaultdict(int)
    for r in left:
        by_source[r[3]] += size[r[0]]
    weight = dict(zip(sorted(by_source), [5, 2, 1, 5]))
    total, fixed = sum(by_source.values()), {}
    while True:
        free = {s: w for s, w in weight.items() if s not in fixed}
        level = (total - sum(fixed.values())) / sum(free.values())
        over = {s: 3 * by_source[s] for s, w in free.items() if w * level > 3 * by_source[s]}
        if not over:
            break
        fixed |= over
    for s in weight:
        target = fixed.get(s, weight[s] * level)
        taken = sum(n * size[d] for d, n in kept[3].items() if d % 4 == int(s[1]))
        assert abs(taken - target) <= max(size.values())
    assert max(kept[3].values()) <= 3 and set(kept[3]) <= set(kept[2])

    assert kept[4] == kept[3]
    shards = collections.defaultdict(list)
    for r in docs.collect():
        shards[r.shard].append((r.slot, r.size))
        assert r.size == len(r.text.encode()) + 1
    assert set(shards) <= set(range(8))
    assert all(sorted(x for x, _ in v) == list(range(len(v))) for v in shards.values())
    sums = [sum(x for _, x in shards[k]) for k in range(8)]
    assert max(sums) - min(sums) <= 2 * max(len(r[1].encode()) + 1 for r in left)


def test_run_gives_the_last_stage(spark, tmp_path):
    rows, items, *_ = corpus(5)
    spark.createDataFrame(rows[:40], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a = sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "shard", "slot").collect()))
    b = sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "shard", "slot").collect()))
    assert a == b and a


def test_stages_take_nulls_repeats_empty_tables_and_clashing_columns(spark, tmp_path):
    rng = random.Random(8)
    base = [(d if d % 7 else None, words(rng, rng.choice([0, 12, 60, 4000])) if d % 5 else None, rng.choice([None, "en"]), rng.choice([None, "a", "b"]), None, "x") for d in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `shard` string"
    spark.createDataFrame([(None, None), (1, ""), (2, words(rng, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, rows in (("some", base + base[:5]), ("none", [])):
        docs = spark.createDataFrame(rows, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"]
        assert (docs.count() > 0) == bool(rows)
