"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Protected entities (e-mail and IP addresses, card and phone numbers) are found by pattern.
What else gives an entity away is estimated from the corpus: a term t discloses an entity e
to the degree PMI(t, e) / IC(e), where IC(e) = log(N / n_e) is all there is to learn about e
and PMI(t, e) = log(N n_te / (n_t n_e)); the n are documents of the whole corpus that hold
the entity, the term, or both. In a document that mentions e, its terms from REMOVE_AT on
are removed and those from GENERALISE_AT on generalised to their class. Estimates count only
with SUPPORT or more different texts in which term and entity meet, so that a word which
occurs once is not taken for a sign. An entity of fewer texts than that has no estimate of
its own; there the terms that disclose its group count: the domain of an address, the network
of an IP address, the issuer of a card, the area of a phone number; or, where the group is as
rare, those that disclose its kind. Only kinds in fewer texts than that have none.

A term that is too frequent to reach the threshold for an entity, given how many rows hold the
entity and in how many the term stands beside any entity, does not meet it; texts with very many
entities are worked off in blocks.

Null and empty texts hold nothing. Documents are matched by the digest of their text, so
repeated rows and repeated or null ids are all treated alike; offsets are code points, ends
exclusive. Texts are searched whole, in time linear in their length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorana.llm.columns import WORD, let, matches, words
from quorana.workdir import Scratch

#: Kinds in the order in which they are listed; the last two are the terms that the corpus gives away.
KINDS = ("email", "ip", "card", "phone", "removed", "generalised")
REMOVE_AT, GENERALISE_AT, SUPPORT = 0.98, 0.90, 3
#: Java patterns. Runs are taken whole and from their first character on, which finds the same
#: matches as trying every start does, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
IP_VALID = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: Entities of one text that meet its terms in one task.
BLOCK = 64
_FOUND = "array<struct<start: bigint, rank: int, end: bigint, kind: string, value: string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _kind(text: Column, kind: str) -> Column:
    """The valid spans of one kind, each with its normalised value."""
    if kind == "email":
        likely, pattern, value = F.contains(text, F.lit("@")), EMAIL, F.lower
        valid = lambda v: F.lit(True)
    elif kind == "ip":
        likely, pattern, value = text.rlike(r"[0-9]\.[0-9]"), IP, lambda v: v
        valid = lambda v: v.rlike(IP_VALID)
    elif kind == "card":
        likely, pattern, value = text.rlike("[0-9]"), CARD, _digits
        valid = lambda v: (F.length(_digits(v)) <= 19) & F.call_function("luhn_check", _digits(v))
    else:
        likely, pattern, value = F.contains(text, F.lit("+")), PHONE, _digits
        valid = lambda v: F.length(_digits(v)).between(9, 15)
    rank = KINDS.index(kind)
    found = F.transform(
        F.filter(matches(text, pattern), lambda s: valid(s["value"])),
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), value(s["value"]).alias("value")),
    )
    return F.when(likely, found).otherwise(F.array().cast(_FOUND))


def entities(text: Column) -> Column:
    """array<struct(start, rank, end, kind, value)> of the protected entities, by start, then kind."""
    body = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*[_kind(body, k) for k in KINDS[:4]]))


def _term(word: Column) -> Column:
    """A word as a term: lower case, without punctuation at its ends."""
    return F.regexp_replace(F.lower(word), r"^[\p{Punct}]++|[\p{Punct}]++$", "")


def terms(text: Column) -> Column:
    """The distinct terms of a text; a term has three code points or more."""
    return F.filter(F.array_distinct(F.transform(words(text), _term)), lambda t: F.length(t) >= 3)


def _named(e: Column) -> Column:
    """struct(entity, group, kind) of an entity; the names of groups and kinds end in a star, which no entity's does."""
    value, kind = e["value"], e["kind"]
    part = (
        F.when(kind == "email", F.regexp_extract(value, "@.*$", 0)).when(kind == "ip", F.regexp_extract(value, r"^[0-9]+\.[0-9]+", 0))
        .when(kind == "card", F.substr(value, F.lit(1), F.lit(6))).otherwise(F.substr(value, F.lit(1), F.lit(4)))
    )
    return F.struct(F.concat_ws(":", kind, value).alias("entity"), F.concat_ws(":", kind, part, F.lit("*")).alias("group"), F.concat_ws(":", kind, F.lit("*")).alias("kind"))


def _units(holders: DataFrame, support: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What is estimated, (text_id, copies, unit, n_e), and what each text's entities are judged by, (text_id, unit)."""
    named = scratch.write(holders.select("text_id", "copies", F.explode(F.array_distinct(F.transform(entities(F.col("text")), _named))).alias("e")).select("text_id", "copies", "e.*"), "named")
    levels = scratch.write(named.select("text_id", "copies", F.explode(F.array("entity", "group", "kind")).alias("unit")).distinct(), "levels")
    known = levels.groupBy("unit").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts")).where(F.col("texts") >= support).drop("texts")
    known = scratch.write(known, "known")
    own, grouped = known.select(F.col("unit").alias("entity"), F.lit(True).alias("own")), known.select(F.col("unit").alias("group"), F.lit(True).alias("grouped"))
    told = named.select("entity", "group", "kind").distinct().join(own, "entity", "left").join(grouped, "group", "left")
    told = told.select("entity", F.when(F.col("own"), F.col("entity")).when(F.col("grouped"), F.col("group")).otherwise(F.col("kind")).alias("unit"))
    judged = scratch.write(named.select("text_id", "entity").join(told, "entity").select("text_id", "unit").distinct(), "judged")
    asked = judged.select("unit").distinct().join(known, "unit")
    held = scratch.write(levels.join(asked, "unit"), "held")
    for name in ("named", "levels", "known"):
        scratch.drop(name)
    return held, judged


def disclosure(df: DataFrame, text: str = "text", support: int = SUPPORT, least: float = GENERALISE_AT) -> DataFrame:
    """(text_key, terms array<struct(term, degree)>): for each text with entities, the terms that disclose one of them.

    All counts are over all rows; ``text_key`` is the MD5 of the text.
    """
    scratch = Scratch(df.sparkSession, "pii")
    body, n = F.col(text), df.count()
    found = df.select(body.alias("text")).where(F.size(entities(F.col("text"))) > 0).groupBy("text").agg(F.count("*").alias("copies"))
    # inside, a text goes by a number, which takes less room than its digest
    holders = scratch.write(found.withColumn("text_key", F.md5("text")).withColumn("text_id", F.monotonically_increasing_id()), "holders")
    held, judged = _units(holders, support, scratch)
    blocks = F.ceil(F.count("*").over(Window.partitionBy("text_id")) / BLOCK)
    held = scratch.write(held.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks"))), "blocks")
    scratch.drop("held")
    per_text = scratch.joinable(held.groupBy("text_id").agg(F.max("n_e").alias("most"), F.min("n_e").alias("fewest"), F.max("blocks").alias("blocks")), "texts")
    # the degree reaches ``least`` only if n_te is this share of n_t or more; n_te is at most n_e, and at most n_h, the rows with the term and any entity
    times = lambda n_e: F.pow(F.lit(float(max(n, 1))) / n_e, F.lit(1 - least)) * (1 + 1e-9)
    within = lambda most, n_e: F.col("n_t") <= most.cast("double") * times(n_e)
    heard = holders.select("copies", F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.sum("copies").alias("n_h"), F.count("*").alias("texts"))
    heard = scratch.joinable(heard.where(F.col("texts") >= support).drop("texts"), "heard")
    # one row per word of the corpus; partial sums are made before the shuffle
    spread = df.select(F.explode(terms(body)).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= support)
    likely = scratch.joinable(spread.join(heard, "term").where(within(F.col("n_h"), F.lit(float(max(support, 1))))), "likely")
    scratch.drop("heard")
    del spread, heard
    scratch.settle()  # the words of the corpus were shuffled, and next are those of the texts with entities
    worded = holders.select("text_id", F.explode(terms(F.col("text"))).alias("term")).join(likely, "term").join(per_text, "text_id")
    worded = scratch.write(worded.where(within(F.col("most"), F.col("most")) & within(F.col("n_h"), F.col("fewest"))).select("text_id", "blocks", "term", "n_t", "n_h"), "worded")
    keys = scratch.joinable(holders.select("text_id", "text_key"), "keys")
    for name in ("holders", "texts", "likely"):
        scratch.drop(name)
    scratch.settle()
    meeting = worded.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks").hint("merge")  # as many rows as blocks
    met = (
        held.drop("blocks").join(meeting, ["text_id", "block"]).where(within(F.least("n_e", "n_h"), F.col("n_e")))
        .groupBy("unit", "n_e", "term", "n_t").agg(F.sum("copies").alias("n_te"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    )
    gain = F.log(F.lit(float(n)) * F.col("n_te") / (F.col("n_t").cast("double") * F.col("n_e")))
    degree = F.when(F.col("n_e") < n, gain / F.log(F.lit(float(n)) / F.col("n_e")))
    telling = scratch.write(met.withColumn("degree", F.least(degree, F.lit(1.0))).where(F.col("degree") >= least).select("unit", "term", "degree"), "telling")
    scratch.drop("blocks")
    scratch.settle()
    # by term first: a unit may have as many texts as it has telling terms
    told = worded.select("text_id", "term").join(telling, "term").join(judged, ["text_id", "unit"], "left_semi")
    best = told.groupBy("text_id", "term").agg(F.max("degree").alias("degree"))
    per_text = best.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("term", "degree"))).alias("terms"))
    per_text = scratch.write(per_text.join(keys, "text_id").select("text_key", "terms"), "per_text")
    for name in ("worded", "telling", "judged", "keys"):
        scratch.drop(name)
    scratch.settle()
    return per_text


def _term_spans(text: Column, telling: Column, found: Column, remove_at: float) -> Column:
    """Spans of the words whose term is telling and that lie in no entity."""
    degree = lambda word: F.element_at(telling, _term(word))
    hits = F.filter(matches(text, WORD), lambda w: degree(w["value"]).isNotNull() & ~F.exists(found, lambda e: (e["start"] < w["end"]) & (e["end"] > w["start"])))
    kind = lambda w: F.when(degree(w["value"]) >= remove_at, KINDS[4]).otherwise(KINDS[5])
    return F.transform(
        hits,
        lambda w: F.struct(w["start"].alias("start"), F.when(degree(w["value"]) >= remove_at, 4).otherwise(5).cast("int").alias("rank"), w["end"].alias("end"), kind(w).alias("kind"), w["value"].alias("value")),
    )


def _spanned(df: DataFrame, carry: Sequence[str], text: str, keep_text: bool, remove_at: float, generalise_at: float, support: int) -> DataFrame:
    """Columns ``_c0``... for ``carry``, ``_body``, ``_entities`` and ``_spans`` of every row.

    Only texts with entities move through the shuffle; ``keep_text`` moves all of them.
    """
    body, key = F.coalesce(F.col(text), F.lit("")), "_key"
    telling = disclosure(df, text, support, generalise_at).select(F.col("text_key").alias(key), F.map_from_entries("terms").alias("_telling"))
    rows = df.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)], body.alias("_body"), entities(F.col(text)).alias("_entities"))
    holds = F.size("_entities") > 0
    # rows without entities match nothing; a key of their own spreads them
    rows = rows.withColumn(key, F.when(holds, F.md5("_body")).otherwise(F.concat(F.lit("-"), F.xxhash64(*[f"_c{k}" for k in range(len(carry))], "_body").cast("string"))))
    if not keep_text:
        rows = rows.withColumn("_body", F.when(holds, F.col("_body")))
    joined = rows.join(telling, key, "left")
    extra = F.when(F.col("_telling").isNotNull(), _term_spans(F.col("_body"), F.col("_telling"), F.col("_entities"), remove_at)).otherwise(F.array().cast(_FOUND))
    return joined.select(*[f"_c{k}" for k in range(len(carry))], "_body", "_entities", F.sort_array(F.concat("_entities", extra)).alias("_spans"))


def pii_spans(df: DataFrame, id_column: str = "doc_id", text: str = "text", remove_at: float = REMOVE_AT, generalise_at: float = GENERALISE_AT, support: int = SUPPORT) -> DataFrame:
    """id, ``entities``, and ``spans`` (the entities and the telling terms) of every row."""
    got = _spanned(df, [id_column], text, False, remove_at, generalise_at, support)
    return got.select(F.col("_c0").alias(id_column), F.col("_entities").alias("entities"), F.col("_spans").alias("spans"))


def _class(span: Column) -> Column:
    """What stands in the text instead of a span: nothing for a removed term, else its class."""
    shape = F.when(span["value"].rlike("[0-9]"), "[number]").when(span["value"].rlike(r"^\p{Lu}"), "[name]").otherwise("[term]")
    return F.when(span["kind"] == KINDS[4], "").when(span["kind"] == KINDS[5], shape).otherwise(F.concat(F.lit("["), span["kind"], F.lit("]")))


def sanitised(df: DataFrame, text: str = "text", out: str = "sanitised", remove_at: float = REMOVE_AT, generalise_at: float = GENERALISE_AT, support: int = SUPPORT) -> DataFrame:
    """The rows with the sanitised text as ``out``: of spans that overlap, the first stands for all."""
    carry = [c for c in df.columns if c != out]
    got = _spanned(df, carry, text, True, remove_at, generalise_at, support)
    body = F.col("_body")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def put(acc: Column, s: Column) -> Column:
        ahead = F.substr(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(ahead, _class(s))).alias("parts"))
        )

    cut = let(F.aggregate("_spans", zero, put), lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(body, (acc["at"] + 1).cast("int"))))
    given = F.col(f"_c{carry.index(text)}")
    return got.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)], F.when(given.isNotNull(), F.when(F.size("_spans") > 0, cut).otherwise(body)).alias(out))


def digest(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts per kind, the digest of the pattern spans, and all spans."""
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("entities", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return pii_spans(df, id_column, text).select(id_column, *[count(k) for k in KINDS[:4]], F.sha2(told(F.col("entities")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
