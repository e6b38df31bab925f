"""Dates, amounts and the classes of personal and business identifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: date formats in the order in which they are tried
DATE_FORMATS = ("yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy", "d.M.yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMM. yyyy")
# --- fixed values: upper ends of the amount bands and their names
BANDS = ((1_000, "<1k"), (10_000, "1k-10k"), (100_000, "10k-100k"), (1_000_000, "100k-1m"), (10_000_000, "1m-10m"), (100_000_000, "10m-100m"))
# --- fixed values: patterns of the identifier classes; (?U) gives \w, \d and \b their Unicode meaning
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
CURRENCIES = "USD|EUR|GBP|CHF|JPY|SEK|NOK|DKK|PLN"
PATTERNS = {
    "EMAIL": r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "PHONE": r"(?U)(?<![\w/])(?:\+\d{1,3}[ -]?)?(?:\(?\d{2,4}\)?[ -]?)\d{3,4}[ -]?\d{3,4}(?![\w/])",
    "IBAN": r"(?U)\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,4})?\b",
    "LEI": r"(?U)\b(?:LEI[ :#-]*)?([A-Z0-9]{18}\d{2})\b",
    "ISIN": r"(?U)\b[A-Z]{2}[A-Z0-9]{9}\d\b",
    "ACCOUNT_ID": r"(?U)\b(?:ACC|ACCT|CUST|LOAN|SSI)-\d{4,12}\b|\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,4})?\b",
    "TRADE_ID": r"(?U)\b(?:TRD|TKT|CONF|SET|ORD|MSG)-\d{4}-\d{4,8}\b",
    "DATE": rf"(?U)\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)? (?:{MONTHS})\.? \d{{4}}|(?:{MONTHS})\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}})\b",
    "AMOUNT_EXACT": rf"(?U)(?:(?:{CURRENCIES}|[$€£])\s?\d{{1,3}}(?:[,\d]{{0,15}})(?:\.\d{{1,2}})?(?:\s?(?:mm|m|bn|k|MM|M|BN|K))?)|(?:\d{{1,3}}(?:[,\d]{{0,15}})(?:\.\d{{1,2}})?\s?(?:mm|m|bn|k|MM|M|BN|K)?\s?(?:{CURRENCIES}))",
    "LEGAL_ENTITY": r"(?U)\b(?:[A-Z][\w&'.-]*\s){0,3}[A-Z][\w&'.-]*\s(?:Ltd\.?|Limited|GmbH|AG|S\.A\.|SA|SpA|LLC|LLP|Inc\.?|plc|PLC|B\.V\.|BV|NV|N\.V\.|SE|Holdings|Partners|Bancorp|Trust)\b",
    "NAME": r"(?U)\b[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?(?:\s[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?){1,2}\b",
}
# --- fixed values: classes in the order in which a term's class is looked up
GAZETTEER_ORDER = ("COUNTERPARTY", "CLIENT", "INTERNAL_SYSTEM", "PERSON", "LOCATION")


def parse_date(s: Column) -> Column:
    """The first format that fits; ordinal endings are dropped."""
    t = F.regexp_replace(F.regexp_replace(F.trim(s), r"(\d)(?:st|nd|rd|th)\b", "$1"), "Sept ", "Sep ")
    return F.coalesce(*[F.try_to_date(t, f) for f in DATE_FORMATS])


def date_token(s: Column, shift_days: Column | None = None) -> Column:
    """A parsed date moved by days, or its month where no shift is given; null if it is no date."""
    d = parse_date(s)
    return F.date_format(d, "yyyy-MM") if shift_days is None else F.date_add(d, shift_days).cast("string")


def shift_days(mac: Column) -> Column:
    """Days in [-182, 182] without 0, from the first four bytes of a keyed digest."""
    n = F.conv(F.substr(F.hex(mac), F.lit(1), F.lit(8)), 16, 10).cast("long") % 364 - 182
    return F.when(n < 0, n).otherwise(n + 1).cast("int")


def parse_amount(s: Column) -> Column:
    """The first number of a text times its k, m or bn."""
    digits = F.regexp_extract(s, r"\d[\d,]*(?:\.\d+)?", 0)
    tail = F.lower(F.ltrim(F.regexp_extract(s, r"\d[\d,]*(?:\.\d+)?(.*)$", 1)))
    by = F.when(tail.startswith("bn"), 1e9).when(tail.startswith("m"), 1e6).when(tail.startswith("k"), 1e3).otherwise(1.0)
    return F.when(digits != "", F.replace(digits, F.lit(","), F.lit("")).cast("double") * by)


def band(amount: Column) -> Column:
    out = F.when(amount.isNull(), "unparsed")
    for end, name in BANDS:
        out = out.when(amount < end, name)
    return out.otherwise(">100m")


def whole(s: Column, kind: str) -> Column:
    """Whether all of a trimmed text is one match of a class pattern."""
    p = PATTERNS[kind].removeprefix("(?U)")
    return F.trim(s).rlike(f"(?U)^(?:{p})$")


def is_of_class(kind: str, s: Column, known: Column | None = None) -> Column:
    """The predicate of a class; ``known`` says whether the term stands in the class's list, null if there is no list."""
    name, legal, t = whole(s, "NAME"), whole(s, "LEGAL_ENTITY"), F.trim(s)
    listed = F.lit(None).cast("boolean") if known is None else known
    rules: Mapping[str, Column] = {
        "EMAIL": whole(s, "EMAIL"), "PHONE": whole(s, "PHONE"), "DATE": whole(s, "DATE") & parse_date(s).isNotNull(),
        "ACCOUNT_ID": whole(s, "ACCOUNT_ID") | whole(s, "IBAN"), "TRADE_ID": whole(s, "TRADE_ID"), "AMOUNT_EXACT": whole(s, "AMOUNT_EXACT") & parse_amount(s).isNotNull(),
        "LEGAL_ENTITY": legal | whole(s, "LEI"), "PERSON": F.coalesce(listed, F.lit(False)) | (name & (F.size(F.split(t, r"\s+")) <= 3)),
        "COUNTERPARTY": F.coalesce(listed, legal | name), "CLIENT": F.coalesce(listed, legal | name), "INTERNAL_SYSTEM": F.coalesce(listed, t.rlike("^[A-Z][A-Z0-9-]{2,}$")),
        "LOCATION": F.coalesce(listed, F.lit(False)) | name | t.rlike("^[A-Z][a-z]+$"),
        "FREE_TEXT_QUOTE": (F.length(t) >= 2) & F.substr(t, F.lit(1), F.lit(1)).isin('"', "'", "“", "‘", "«") & F.substr(t, F.length(t), F.lit(1)).isin('"', "'", "”", "’", "»"),
    }
    return (t != "") & rules[kind] if kind in rules else F.lit(False)


def class_of(classes: Column) -> Column:
    """Of the classes that list a term, the first in order."""
    return F.get(F.filter(F.array(*[F.lit(c) for c in GAZETTEER_ORDER]), lambda c: F.array_contains(classes, c)), F.lit(0))


def band_names() -> Sequence[str]:
    return [name for _, name in BANDS] + [">100m"]
