"""Quality rules against a brute-force version."""

import re

import pytest
from pyspark.sql import functions as F

from quorana.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CASES = [
    None, "", " \n\t", "one", "a b c d e a b c d e", "x " * 30, "line one here\nline one here\n\n\n  \nline one here", "### $$ a|b <b> & %",
    "é ü 日本 😀 " * 12, "w" * 5000 + " tail", "\x0bword\x0cother\x1cjoined", "a b c d e f g h i j k l m n o", "stop!! go!! now!! yes!! no!! on!! up!! at!! in!! by!! it", " ".join(f"w{i}" for i in range(3000)) + "\n" + " ".join(f"w{i}" for i in range(40)),
]


def brute(s):
    w = WORD.findall(s or "")
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (s or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in s or ""), dup, len(covered)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(CASES)] + [(None, "nameless document", None), (3, "one", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")


def test_measures_equal_brute_force(docs):
    for r in quality.quality_report(docs).collect():
        if r.doc_id is not None:
            b = brute(CASES[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
            assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
            lines = [x for x in (CASES[r.doc_id] or "").split("\n") if WORD.search(x)]
            shouted = sum(bool(re.search(r"[!?]{2,}$", w)) for w in WORD.findall(CASES[r.doc_id] or ""))
            n = b[0]
            assert r.kept == (not r.base_failed and 100 * b[2] <= 25 * n and 100 * shouted <= 25 * n and 3 * n <= 2 * b[1] <= 50 * n and 100 * b[3] <= 50 * len(lines))


def test_filter_keeps_columns_and_agrees_with_report(docs):
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    want = sorted(r.doc_id for r in quality.quality_report(docs).where("kept").collect())
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_order_is_rejection_per_cost_and_does_not_change_the_verdict(spark, docs):
    ticks = iter(range(10_000))
    got = quality.estimated(docs, quality.default_rules(), clock=lambda: next(ticks))
    rates = [e.rejection_per_cost for e in got]
    assert rates == sorted(rates, reverse=True)
    forward = quality.first_failure(quality.default_rules(), quality.from_text(F.col("text"))).isNull()
    backward = quality.first_failure(quality.default_rules()[::-1], quality.from_text(F.col("text"))).isNull()
    assert docs.where(forward != backward).count() == 0


def test_later_rules_are_not_evaluated(spark, docs, monkeypatch):
    """A rule that fails when it is evaluated must not meet what a rule before it rejects."""
    trap = lambda least: quality.Rule("trap", lambda m: F.when(quality.shouted_words(F.col("text")) >= least, F.raise_error(F.lit("evaluated")).cast("boolean")).otherwise(False))
    few = quality.Rule("few", lambda m: m("n_words") < 10_000)
    order = [few, trap(0)]
    assert docs.where(quality.first_failure(order, quality.from_text(F.col("text"))).isNull()).count() == 0
    with pytest.raises(Exception, match="evaluated"):
        docs.where(quality.first_failure(order[::-1], quality.from_text(F.col("text"))).isNull()).count()
    # the report takes its own measures for all rows, the others for what is left
    asked = []
    rules = [quality.Rule("few", lambda m: m("n_words") < 10_000), quality.Rule("trap", lambda m: asked.append(1) or F.raise_error(F.lit("evaluated")).cast("boolean"))]
    monkeypatch.setattr(quality, "estimated", lambda df, rules, *a, **k: [quality.Estimate(r, 1.0, 0.5) for r in rules])
    assert quality.quality_report(docs, rules=rules).where("kept").count() == 0 and asked


def test_the_sample_comes_from_the_whole_table(spark, monkeypatch):
    df = spark.createDataFrame([(i, "first half" if i < 2000 else "a b c d e f g h i j k l") for i in range(4000)], "doc_id long, text string").coalesce(1)
    (got,) = quality.estimated(df, [quality.default_rules()[0]], sample_rows=400)
    assert 0.4 < got.selectivity < 0.6


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality_report(empty).count() == 0 and quality.quality_filter(empty).count() == 0
