"""What every operator must stand: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random

import public_tokenizers
import pytest

from quorana.llm import decontaminate, line_dedup, mixing, near_dedup, pii, quality, secret_scan, sharding, suffix_dedup, token_counts

LONG = " ".join(random.Random(3).choice(["alpha", "beta", "gamma.", "delta\n", "7", "é"]) for _ in range(30_000))
ROWS = [(1, "some words that stand here, ann@x.example"), (1, "some words that stand here, ann@x.example"), (2, None), (None, "nameless words"), (None, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG), (7, "日本語 😀"), (-8, "negative id with some words")]

OPERATORS = {
    "secrets": lambda df, b: secret_scan.digest(df),
    "pii": lambda df, b: pii.digest(df),
    "mixing": lambda df, b: mixing.mixing_plan(df),
    "quality": lambda df, b: quality.quality_report(df),
    "tokens": lambda df, b: token_counts.token_counts(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN),
    "near": lambda df, b: near_dedup.near_duplicates(df),
    "sharding": lambda df, b: sharding.shard_table(df),
    "lines": lambda df, b: line_dedup.line_report(df),
    "substrings": lambda df, b: suffix_dedup.substring_report(df),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, name):
    schema = "doc_id long, text string, source string, lang string, `id` int, `_c0` int, `key` int, `n` int, `line` int, `spans` int, `_body` int, `size` int, `n_tokens` int"
    df = spark.createDataFrame([(i, t, s, None, *[None] * 9) for k, (i, t) in enumerate(ROWS) for s in ["hot" if k % 3 else None]], schema)
    bench = spark.createDataFrame([(1, "words of an item")], "item_id long, text string")
    got = OPERATORS[name](df, bench).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in ROWS)
    assert OPERATORS[name](df.limit(0), bench).count() == 0


def test_token_counts_keep_columns_of_their_names(spark):
    df = spark.createDataFrame([(1, "two words", "mine", 7)], "doc_id long, text string, n_tokens string, _answers int")
    got = token_counts.token_counts(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert got.columns == [*df.columns, "n_bytes", "n_tokens_", "over_limit", "fit_chars"]
    assert got.first()[2:6] == ("mine", 7, 9, 2)


def test_values_at_the_edges(spark):
    """What the rows of ROWS give, not only how many."""
    df = spark.createDataFrame([(i, t, "hot", None) for i, t in ROWS], "doc_id long, text string, source string, lang string")
    of = lambda rows: {(r.doc_id, r[1]) for r in rows}
    near = near_dedup.near_duplicates(df).collect()
    assert {r.doc_id: (r.component_id, r.kept) for r in near if r.doc_id is not None} == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True), 6: (5, False), 7: (7, True), -8: (-8, True)}
    assert all(r.component_id is None and r.kept for r in near if r.doc_id is None)
    cut = {(r.doc_id, r.n_removed == r.n_bytes) for r in suffix_dedup.substring_report(df).collect() if r.n_removed}
    assert {(6, True)} <= cut and {i for i, _ in cut} <= {5, 6}
    assert of(secret_scan.digest(df).select("doc_id", "spans").where("spans <> ''").collect()) == set()
    assert of(pii.digest(df).select("doc_id", "n_email").where("n_email > 0").collect()) == {(1, 1)}
    assert {r.doc_id for r in quality.quality_report(df).where("n_words = 0").collect()} == {2, None, 3, 4}
    mixed = mixing.mixing_plan(df).collect()
    assert all(r.taken == r.size for r in mixed) and sum(r.size == 0 for r in mixed) == 4
    lines = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.line_report(df).collect()}
    assert lines[2] == (0, 0) and lines[4] == (2, 0) and lines[6][1] > lines[5][1]


def test_decontamination_reports_rows_that_hold_an_item(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in ROWS], "doc_id long, text string, _items int")
    bench = spark.createDataFrame([(1, "negative id with some words"), (2, None), (None, "x")], "item_id long, text string")
    assert [(r.doc_id, r.item_ids) for r in decontaminate.contamination_report(df, bench).collect()] == [(-8, "1")]
