"""Decontamination against brute force, on verbatim items, paraphrases and clean text."""

import random

import numpy as np

from quorana.llm import decontaminate


def corpus(spark, n=120):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "tu", "re", "sa"]) for _ in range(rng.randint(2, 4)))
    common = [word() for _ in range(12)]
    prose = lambda k: " ".join(rng.choice(common) if rng.random() < 0.5 else word() for _ in range(k))
    items = [(i, prose(rng.randint(14, 60)) + ".") for i in range(8)]
    docs, planted = [], set()
    for d in range(n):
        text = prose(rng.randint(0, 200))
        if d % 6 == 0:
            i, t = rng.choice(items)
            planted.add((d, i))
            cut = rng.randint(0, len(text))
            text = text[:cut] + " " + (t if d % 12 else t.upper().replace(" ", "\n")) + " " + text[cut:]
        docs.append((d, text, "clash"))
    docs += [(n, None, None), (None, "", "x"), (n + 1, items[0][1], None), (None, items[1][1], None)]
    planted.add((n + 1, 0))
    schema = "doc_id long, text string, _items string"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(items + [(None, "nowhere to be found"), (99, None), (98, "!!")], "item_id long, text string"), planted, items


def test_verbatim_items_are_found_and_nothing_else(spark):
    docs, bench, planted, _ = corpus(spark)
    rows = decontaminate.contamination_report(docs, bench).collect()
    got = {(r.doc_id, int(i)) for r in rows for i in r.item_ids.split(",")}
    assert got == planted | {(None, 1)}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in got})


def test_blocks_give_the_same_result(spark, monkeypatch):
    docs, bench, planted, _ = corpus(spark)
    whole = sorted(map(tuple, decontaminate.contamination_report(docs.where("doc_id is not null"), bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)
    assert sorted(map(tuple, decontaminate.contamination_report(docs.where("doc_id is not null"), bench).collect())) == whole


def test_paraphrase_needs_its_answer():
    item = "the capital of the old kingdom lay on three hills beside a slow green river. which river was it? answer: grand aldemar northern"
    items = decontaminate.Items([(1, item)])
    look = items.vocabulary
    said = lambda t: decontaminate.verified(decontaminate._ids(look, t).tolist(), 0, items.verify[0])
    same, answered = said(item.replace("old", "ancient").replace("three", "seven").replace("beside", "near"))
    assert decontaminate.SHARED <= same < decontaminate.VERBATIM and answered == 1.0
    same, answered = said(item.split(" grand")[0] + " nobody here knows what to say")
    assert decontaminate.SHARED <= same < decontaminate.VERBATIM and answered < decontaminate.ANSWERED


def brute(docs, items):
    """(doc, item) of all pairs in which any stretch as long as the item and a bit holds it, by every start."""
    block = decontaminate.Items([(i, t) for i, t in items])
    found = set()
    for d, text in docs:
        ids = decontaminate._ids(block.vocabulary, text).tolist()
        for (i, _, _), (masks, n, answer, m, *_) in zip(block.items, block.verify, strict=True):
            span = n + max(4, n // 3)
            for at in range(max(1, len(ids) - span + 1)):
                part = ids[at : at + span]
                share = decontaminate.common_subsequence(masks, n, part) / n
                if share >= decontaminate.VERBATIM or (share >= decontaminate.SHARED and decontaminate.common_subsequence(answer, m, part) >= decontaminate.ANSWERED * m):
                    found.add((d, i))
                    break
    return found


def altered_corpus(seed, usual=400):
    """Documents with items word for word, with words left out, replaced or swapped, and others; some items hold common or few different words."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(usual)]
    common = [f"c{k}" for k in range(8)]
    prose = lambda n, share=0.3: [rng.choice(common) if rng.random() < share else rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(prose(rng.randint(8, 50)))) for i in range(14)] + [(50 + i, " ".join(prose(30, 1.0))) for i in range(2)] + [(60, "c1 c2 " * 9), (61, " ".join(prose(90)))]
    docs = []
    for d in range(160):
        text = prose(rng.randint(0, 120))
        if d % 2 == 0:
            plant = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, len(plant) // 10, len(plant) // 5])):
                at = rng.randrange(len(plant))
                match rng.randrange(3):
                    case 0:
                        del plant[at]
                    case 1:
                        plant[at] = rng.choice(words)
                    case 2:
                        plant.insert(rng.randrange(len(plant)), plant.pop(at))
            at = rng.randint(0, len(text))
            text[at:at] = plant
        docs.append((d, " ".join(text)))
    return docs, items


def test_recall_against_brute_force_over_all_pairs(spark):
    found, want = set(), set()
    for seed in (1, 2):
        docs, items = altered_corpus(seed)
        rows = decontaminate.contamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        found |= {(seed, r.doc_id, int(i)) for r in rows for i in r.item_ids.split(",")}
        want |= {(seed, *x) for x in brute(docs, items)}
    assert len(want) > 100 and found <= want
    assert len(found) >= 0.98 * len(want), (len(found), len(want), want - found)


def test_items_without_an_id_are_found(spark):
    docs = spark.createDataFrame([(1, "before " + "a question that has no number but a good many words in it " + "after"), (2, "clean")], "doc_id long, text string")
    text = "a question that has no number but a good many words in it"
    for rows, ids in (([(None, text)], "null"), ([(None, text), (5, text)], "5,null"), ([(5, text)], "5")):
        bench = spark.createDataFrame(rows, "item_id long, text string")
        assert [(r.doc_id, r.item_ids, r.n_items) for r in decontaminate.contamination_report(docs, bench).collect()] == [(1, ids, len(rows))]
        assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()] == [2]


def test_result_does_not_depend_on_batches_or_order(spark, monkeypatch):
    docs, bench, _, _ = corpus(spark)
    whole = sorted(map(str, decontaminate.contamination_report(docs, bench).collect()))
    latent = []
    kept = decontaminate.latent_words
    monkeypatch.setattr(decontaminate, "latent_words", lambda *a: latent.append(kept(*a)) or latent[-1])
    for df in (docs.repartition(7, "text"), docs.coalesce(1).orderBy("text")):
        assert sorted(map(str, decontaminate.contamination_report(df, bench).collect())) == whole
    assert np.allclose(latent[0], latent[1])


def test_randomised_svd_captures_what_an_exact_one_does():
    rng = np.random.default_rng(6)
    n, passages, topics = 400, 3000, 30
    affinity = rng.gamma(0.1, size=(topics, n))
    affinity /= affinity.sum(axis=1, keepdims=True)
    counts = np.stack([rng.multinomial(20, affinity[rng.integers(topics)]) for _ in range(passages)])
    items = decontaminate.Items([(1, " ".join(f"word{k}" for k in range(n)))])
    signs = items.signs()
    sums = np.zeros((n, decontaminate.SKETCH), np.int64)
    words, owner = zip(*[(w, p) for p in range(passages) for w in np.repeat(np.arange(n), counts[p])])
    decontaminate._sketch(np.array(words), np.array(owner), signs, sums)
    assert (sums == counts.T @ (counts @ signs.astype(np.int64))).all()
    weight = decontaminate.weights((counts > 0).sum(axis=0), passages * 5)
    a = counts * weight
    latent = decontaminate.latent_words(weight, sums, signs)
    basis = latent / np.where(weight > 0, weight, 1)[:, None]
    basis = basis[:, np.linalg.norm(basis, axis=0) > 0.5]
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-3)
    _, strength, right = np.linalg.svd(a, full_matrices=False)
    assert np.linalg.norm(a @ basis) ** 2 >= 0.8 * (strength[: decontaminate.SKETCH] ** 2).sum()  # the noise behind the topics is flat
    assert (np.linalg.norm(basis.T @ right[: topics // 2].T, axis=0) ** 2 >= 0.75).all()


def test_subsequence_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(decontaminate._masks(a), len(a), b) == t[-1][-1]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "words")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "words of an item")], "item_id long, text string")
    none = spark.createDataFrame([], docs.schema)
    assert decontaminate.contamination_report(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 1


def test_items_beside_heavier_words_are_found(spark):
    """An item between repeats of a rarer word: its cosine is low, but its words are all there."""
    rng = random.Random(4)
    usual, rare = [f"usual{k}" for k in range(2000)], [f"rare{k}" for k in range(3000)]
    items = [" ".join(rng.choice(usual) for _ in range(rng.randint(14, 20))) for _ in range(20)]
    bench = [(i, t) for i, t in enumerate(items)] + [(100 + k, " ".join(rare[k * 30 : k * 30 + 30])) for k in range(100)]
    docs, want = [], set()
    for d in range(300):
        words = [rng.choice(usual) for _ in range(60)]
        if d < 40:
            at, plant = rng.randint(0, 60), items[d % 20].split()
            if d >= 20:
                plant = plant[: len(plant) // 2] + plant[len(plant) // 2 + len(plant) // 10 :]
            words = words[:at] + [rare[d]] * 12 + plant + [rare[d]] * 12 + words[at:]
            want.add((d, d % 20))
        docs.append((d, " ".join(words)))
    rows = decontaminate.contamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, int(i)) for r in rows for i in r.item_ids.split(",")} == want
