"""Quality rules as a short-circuit cascade.

Each rule is one expression over the text. On a seeded sample of all documents its cost (seconds)
and its selectivity (share rejected) are estimated, and the rules run in the order of rejection
per cost: a document leaves at the first rule that it fails, and the measures of later rules
are not taken. The order changes the time only; a document is kept if it passes all of them,
in any order. A report that shows some measures for every document takes those, and leaves
the others to the cascade.

Null and empty texts have no words and fail the first rule on words. Texts of any length
are measured whole. Repeated rows are judged alike; other columns pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorana.llm.columns import WORD, let, n_words, words
from quorana.workdir import Scratch

#: Window length of repeated words, and the characters that count as symbols.
WINDOW, SYMBOLS = 5, "[#*$%&|<>]"
#: Rows, on average, on which cost and selectivity are estimated. The estimate orders the rules and decides nothing else.
SAMPLE_ROWS = 1000
#: How often a rule is applied to each row of the sample, so that its seconds stand out from a job's, and how often that is timed.
APPLIED, TIMED = 4, 2


def _grams(w: Column) -> Column:
    return F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.array_join(F.slice(w, i, F.lit(WINDOW)), " "))).otherwise(F.array().cast("array<string>"))


def _covered(grams: Column) -> Column:
    """Positions under windows that occur twice or more: equal windows are neighbours once sorted."""

    def cover(ranked: Column) -> Column:
        again = F.transform(
            ranked,
            lambda x, k: F.when((F.get(ranked, k - 1)["g"] == x["g"]) | (F.get(ranked, k + 1)["g"] == x["g"]), x["i"]),
        )
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            F.sort_array(F.array_compact(again)), zero,
            lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n")),
            lambda acc: acc["n"],
        )

    ranked = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(ranked, cover))


def repeat_words(w: Column) -> Column:
    """Words of ``w`` inside five-word windows that occur twice or more."""
    return let(_grams(w), _covered)


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    with_word = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    return let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def n_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD)))


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0))


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(words(text), ""))


def shouted_words(text: Column) -> Column:
    """Words that end in repeated exclamation or question marks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[!?]{2,}(?=[\x20\x09-\x0D]|$)")), F.lit(0))


#: The measures that a report shows.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(text: Column) -> Column:
    """struct of the reported measures, with the words found once."""
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), n_symbols(text).cast("long").alias("n_symbols"),
            dup_lines(text).cast("long").alias("n_dup_lines"), repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """``fails`` maps a way to get measures by name to a boolean column."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


def default_rules() -> list[Rule]:
    """The production rules. All thresholds are in whole per cent of the words or lines, so they are exact."""
    return [
        Rule("few_words", lambda m: m("n_words") < 10),
        Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
        Rule("symbols", lambda m: 100 * m("n_symbols") > 25 * m("n_words")),
        Rule("shouting", lambda m: 100 * m("n_shouted") > 25 * m("n_words")),
        Rule("word_length", lambda m: (m("word_chars") > 25 * m("n_words")) | (2 * m("word_chars") < 3 * m("n_words"))),
        Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines")),
    ]


def from_text(text: Column, **at_hand: Column) -> Callable[[str], Column]:
    """Measures computed when, and only when, a rule asks for them; those at hand are not computed again."""
    own = {
        "n_words": lambda: n_words(text), "n_repeat_words": lambda: let(words(text), repeat_words), "n_symbols": lambda: n_symbols(text), "n_shouted": lambda: shouted_words(text),
        "word_chars": lambda: word_chars(text), "n_dup_lines": lambda: dup_lines(text), "n_lines": lambda: n_lines(text),
    }
    return lambda name: at_hand[name] if name in at_hand else own[name]()


@dataclass(frozen=True)
class Estimate:
    """Of one rule on the sample: seconds, and the share of rows that it rejects."""

    rule: Rule
    cost: float
    selectivity: float

    @property
    def rejection_per_cost(self) -> float:
        return self.selectivity / max(self.cost, 1e-6)


def estimated(df: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS, clock: Callable[[], float] = time.perf_counter, at_hand: Sequence[str] = (), seed: int = 5) -> list[Estimate]:
    """The rules' estimates, most rejection per cost first; of equals, the cheaper first, then as given.

    The sample is drawn from all rows of the table with a seed and written; the driver sees counts
    only. ``at_hand`` names measures that cost nothing, as they are taken anyhow.
    """
    rows = df.count()  # for files, from their footers
    drawn = df.select(F.col(text).alias("text")).sample(min(1.0, sample_rows / max(1, rows)), seed)
    taken = measures(F.col("text"))
    sample = Scratch(df.sparkSession, "quality").write(drawn.select("text", *[taken[m].alias(f"m_{m}") for m in at_hand]), "sample")
    applied = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(APPLIED))))
    measure = from_text(F.col("text"), **{m: F.col(f"m_{m}") for m in at_hand})

    def timed(fails: Column) -> tuple[float, float]:
        """The least seconds of some runs, and the share rejected."""
        seconds = []
        for _ in range(TIMED):
            began = clock()
            found = applied.agg(F.count_if(fails).alias("n"), F.count("*").alias("of")).first()
            seconds.append(clock() - began)
        return min(seconds), found.n / max(1, found.of)

    fixed, _ = timed(F.length("text") < 0)
    out = []
    for rule in rules:
        seconds, rejected = timed(rule.fails(measure))
        out.append(Estimate(rule, max(seconds - fixed, 1e-3), rejected))
    return sorted(out, key=lambda e: (-e.rejection_per_cost, e.cost))


def first_failure(rules: Sequence[Rule], measure: Callable[[str], Column]) -> Column:
    """The name of the first rule that rejects, null if all pass; later rules are not evaluated."""
    out = F
    for rule in rules:
        out = out.when(F.coalesce(rule.fails(measure), F.lit(False)), F.lit(rule.name))
    return out.otherwise(F.lit(None).cast("string"))


def quality_filter(df: DataFrame, text: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """The documents that pass every rule, with their columns unchanged."""
    order = [e.rule for e in estimated(df, rules or default_rules(), text)]
    # nearly every rule needs the number of words, so it is counted once
    return df.where(let(n_words(F.col(text)), lambda n: first_failure(order, from_text(F.col(text), n_words=n)).isNull()))


def quality_report(df: DataFrame, id_column: str = "doc_id", text: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per document: the reported measures, whether it fails the base rules, and the cascade's verdict.

    What fails the base rules does not enter the cascade, and only the rules on other measures
    than the reported ones cost anything there.
    """
    order = [e.rule for e in estimated(df, rules or default_rules(), text, at_hand=REPORTED)]
    got = df.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"), measures(F.col(text)).alias("_m"))
    shown = {c: F.col(f"_m.{c}") for c in REPORTED}
    base_failed = (shown["n_words"] < 10) | (100 * shown["n_repeat_words"] > 20 * shown["n_words"])
    rejected = F.when(base_failed, F.lit("base")).otherwise(first_failure(order, from_text(F.col("_text"), **shown)))
    return got.select(F.col("_id").alias(id_column), *[v.alias(c) for c, v in shown.items()], base_failed.alias("base_failed"), rejected.isNull().alias("kept"))
