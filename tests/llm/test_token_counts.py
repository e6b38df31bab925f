"""Prefix tables against the tokenizer library, at every prefix."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quorana.llm import token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'re", "'ll", "'", "é", "ß", "日本", "😀", "1", "23", "!!", "...", "<|endoftext|>", "<|endof", "===", " ", "　", "\r\n", "don", "ing", "ion", "xxxxx", "'v", "e"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(VOCABULARY, public_tokenizers.PATTERN)


def test_every_prefix_equals_the_library(library, counter):
    rng = random.Random(1)
    for _ in range(400):
        s = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 14)))
        table = counter.table(s)
        assert [int(x) for x in table] == [library(s[:p]) for p in range(len(s) + 1)], repr(s)


def test_long_pieces(library, counter):
    for s in ("a" * 3000, "=" * 700 + "ab" * 900, " " * 400 + "x", "é" * 500):
        assert counter.table(s)[-1] == library(s)


def test_budgets(library, counter):
    s = "It's a long text, " * 40
    table = counter.table(s)
    for budget in (0, 1, 7, 50, 10_000):
        p = token_counts.longest_within(table, budget)
        assert library(s[:p]) <= budget and all(library(s[:q]) > budget for q in range(p + 1, min(len(s), p + 40) + 1))


def test_columns(spark, library):
    texts = ["", None, "one two", "tail " * 2000, "<|endoftext|>x", "é日😀"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts.token_counts(df.drop("n_tokens"), VOCABULARY, public_tokenizers.PATTERN, 1024).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), library(t), library(t) > 1024)
        assert library(t[: got[i].fit_chars]) <= 1024
    tables = token_counts.with_prefix_tables(df, VOCABULARY, public_tokenizers.PATTERN)
    asked = {r.doc_id: r.c for r in tables.select("doc_id", token_counts.count_at(F.col("prefix_counts"), F.lit(3)).alias("c")).collect()}
    assert asked == {0: None, 1: None, 2: library("one"), 3: library("tai"), 4: library("<|e"), 5: library("é日😀")}
    assert token_counts.token_counts(df.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0
