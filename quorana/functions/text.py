"""Scalar text functions as columns; a vectorised UDF only where the JVM has no such function."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: words dropped from names, and words that only look like plurals
STOPWORDS = ("the", "of", "and", "&", "desk", "business", "group")
SINGULAR_EXCEPTIONS = (
    "analysis", "basis", "crisis", "chassis", "thesis", "synthesis", "hypothesis", "diagnosis", "prognosis",
    "axis", "series", "species", "news", "status", "apparatus", "consensus", "prospectus", "surplus", "bonus",
    "focus", "nexus", "census", "fx", "ops", "gas", "plus", "minus", "bus", "class", "process", "access",
    "loss", "mass", "cross", "gross", "less", "bis", "ois", "cds", "irs", "abs", "mbs", "clo", "cdo", "etf",
    "iss", "sfs", "ucits", "mifid", "emir", "dfa", "ccass", "excess", "us",
)
# --- fixed values: the invisible characters that carry marks; four symbols of two bits each, two openers, a closer, two more
MARK_SYMBOLS = "​‌‍⁠"
MARK_SEQUENCE, MARK_SUFFIX, MARK_END = "⁢", "⁤", "⁣"
INVISIBLE = MARK_SYMBOLS + MARK_SEQUENCE + MARK_SUFFIX + MARK_END + "﻿⁡"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC; the JVM side of Spark has no normaliser."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def nfc_casefold(s: pd.Series) -> pd.Series:
    """Unicode NFC and full case folding, which lower case is not (ß, final sigma)."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).casefold())


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """NFKD without combining marks."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def singularise(word: Column) -> Column:
    """One English word to its singular by ordered rules."""
    n = F.length(word)
    cut = lambda k: F.substr(word, F.lit(1), n - k)
    return (
        F.when((n <= 3) | word.isin(*SINGULAR_EXCEPTIONS) | word.rlike("(ss|us|is)$"), word)
        .when(word.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(word.endswith("ves") & (n > 4), F.concat(cut(3), F.lit("f")))
        .when(word.rlike("(ches|shes|sses|xes|zes)$"), cut(2))
        .when(word.endswith("oes") & (n > 4), cut(2))
        .when(word.endswith("s"), cut(1))
        .otherwise(word)
    )


def canon_words(name: Column, accents: bool = True) -> Column:
    """The words of a canonical name. ``accents=False`` skips the accent UDF, for ASCII input."""
    plain = F.lower(strip_accents(name) if accents else name)
    spaced = F.regexp_replace(plain, r"[^0-9a-z\s]+", " ")
    return F.filter(F.transform(F.filter(F.split(F.trim(spaced), r"\s+"), lambda w: w != ""), singularise), lambda w: ~w.isin(*STOPWORDS))


def canon_name(name: Column, accents: bool = True) -> Column:
    """Lower case, no punctuation, singular words, no filler words."""
    return F.array_join(canon_words(name, accents), " ")


def slug_key(canon: Column) -> Column:
    """A canonical name as a key of [a-z0-9_]; 'unnamed' if nothing is left."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(canon)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(key == "", "unnamed").otherwise(key)


def safe_dirname(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_")


def label_tokens(label: Column, variants: Mapping[str, str] | None = None, stoplist: Sequence[str] = (), accents: bool = True) -> Column:
    """The distinct words of a label for clustering: no numbers, variants folded, stop words dropped."""
    words = F.filter(canon_words(label, accents), lambda w: ~w.rlike("^[0-9]+$"))
    if variants:
        table = F.create_map(*[F.lit(x) for kv in variants.items() for x in kv])
        words = F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*stoplist)) if stoplist else words)


def word_shingles(text: Column, k: int = 3) -> Column:
    """The distinct k-word shingles of lower-cased word characters; a shorter text is one shingle, no words none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))

    def cut(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
        return F.when(F.size(w) >= k, F.array_distinct(many)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(words), cut), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of two arrays of distinct values; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def canonical_original(s: Column, normalise: bool = True) -> Column:
    """NFC, case folded, single blanks, no punctuation at the ends. ``normalise=False`` takes ASCII only, in lower case."""
    t = nfc_casefold(s) if normalise else F.lower(s)
    return F.btrim(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(" .,;:'\"()[]{}<>"))


def strip_marks(s: Column) -> Column:
    """The text without invisible mark characters."""
    return F.translate(s, INVISIBLE, "")


def has_marks(s: Column) -> Column:
    return F.length(strip_marks(s)) < F.length(s)


def encode_tag(n: Column) -> Column:
    """A 32-bit number as 16 invisible symbols, highest bits first."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.substr(F.lit(MARK_SYMBOLS), (F.call_function("shiftright", n.cast("long"), (F.lit(30) - 2 * i).cast("int")).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1))), "")


def decode_tag(symbols: Column) -> Column:
    """The number behind 16 symbols."""
    return F.aggregate(F.split(symbols, ""), F.lit(0).cast("long"), lambda acc, c: acc * 4 + F.array_position(F.array(*[F.lit(x) for x in MARK_SYMBOLS]), c).cast("long") - 1)


def carriers(text: Column) -> Column:
    """array<struct(tag, method)> of the marks in a text; \\uXXXX escapes are read first."""
    found = F.regexp_extract_all(unescape(text), F.lit(f"[{MARK_SEQUENCE}{MARK_SUFFIX}][{MARK_SYMBOLS}]{{16}}{MARK_END}"), F.lit(0))
    return F.transform(
        found,
        lambda m: F.struct(
            F.lower(F.lpad(F.hex(decode_tag(F.substr(m, F.lit(2), F.lit(16)))), 8, "0")).alias("tag"),
            F.when(m.startswith(MARK_SEQUENCE), "ZW_SEQ").otherwise("PSEUD_SUFFIX").alias("method"),
        ),
    )


def unescape(text: Column) -> Column:
    """\\uXXXX escapes of invisible characters as the characters themselves."""
    for c in INVISIBLE:
        text = F.regexp_replace(text, rf"\\u(?i:{ord(c):04x})", c)
    return text


def word_counts(text: Column, tokens: Sequence[str]) -> Column:
    """array<struct(token, n)> for each phrase of a bounded list: how often it occurs as whole words."""
    return F.array(*[F.struct(F.lit(t).alias("token"), contains_word(text, F.lit(t)).cast("long").alias("n")) for t in tokens])


def contains_word(text: Column, token: Column) -> Column:
    """How often a phrase occurs as whole words, in any case, blanks and hyphens alike."""
    body = F.regexp_replace(F.regexp_replace(token, r"([.+*?^$(){}|\[\]\\])", r"\\$1"), r"[\s-]+", r"[\\s-]+")
    return F.regexp_count(text, F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), body, F.lit("(?![A-Za-z0-9])")))


def phrases(text: Column, longest: int = 6) -> Column:
    """All distinct phrases of one to ``longest`` lower-case words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))

    def cut(w: Column) -> Column:
        of = lambda k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.flatten(F.array(*[of(k) for k in range(1, longest + 1)])))

    return F.get(F.transform(F.array(words), cut), F.lit(0))


def without_allowed(text: Column, allowed: Sequence[str]) -> Column:
    """The text with allowed phrases taken out before it is scanned."""
    for phrase in allowed:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    return text


def filled(template: Column, values: Mapping[str, Column]) -> Column:
    """A template with its {name} places filled; whole numbers without a decimal point."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.regexp_replace(value.cast("string"), r"\.0$", ""))
    return template


def short_title(title: Column) -> Column:
    return F.split_part(title, F.lit(" ("), F.lit(1))


def money(x: Column) -> Column:
    return F.coalesce(F.format_number(x, 0), F.lit("n/a"))


def utc_timestamp(s: Column) -> Column:
    """An ISO-8601 time; Z and missing zones are UTC; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(s, "Z$", "+00:00"))


# --- fixed values: the prime and the range of the common 32-bit MinHash, its permutations and their seed
MINHASH_PRIME, MINHASH_RANGE, PERMUTATIONS, MINHASH_SEED = (1 << 61) - 1, (1 << 32) - 1, 64, 1


def minhash(shingles: Column, permutations: int = PERMUTATIONS, seed: int = MINHASH_SEED) -> Column:
    """The MinHash sketch of a set of strings: for each permutation the least hash, all ones for an empty set."""

    @F.pandas_udf("array<long>")
    def sketch(sets: pd.Series) -> pd.Series:
        draw = np.random.RandomState(seed)
        pairs = [(int(draw.randint(1, MINHASH_PRIME, dtype=np.uint64)), int(draw.randint(0, MINHASH_PRIME, dtype=np.uint64))) for _ in range(permutations)]
        a, b = (np.array(x, dtype=np.uint64) for x in zip(*pairs, strict=True))
        out = []
        for words in sets:
            least = np.full(permutations, MINHASH_RANGE, np.uint64)
            for w in words if words is not None else ():
                h = np.uint64(int.from_bytes(hashlib.sha1(w.encode()).digest()[:4], "little"))
                with np.errstate(over="ignore"):  # products are taken in 64 bits
                    least = np.minimum(least, ((a * h + b) % np.uint64(MINHASH_PRIME)) & np.uint64(MINHASH_RANGE))
            out.append(least.astype(np.int64))
        return pd.Series(out, dtype=object)

    return sketch.asNondeterministic()(shingles)  # evaluated where it stands, not again in filters


def sketch_similarity(a: Column, b: Column) -> Column:
    """The share of places in which two sketches agree, an estimate of the sets' Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x) / F.size(a)
