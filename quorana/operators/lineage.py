"""Segments of texts, atoms cut from them, and what share of them can be traced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorana.functions.codes import commitment, keep_leaf, manifest_leaf, merkle_root_of, merkle_roots, sha256
from quorana.functions.text import nfc, strip_marks
from quorana.operators.redaction import numbered_within

# --- fixed values: lineage classes, and the class that each way of deriving an atom leads to
CLASSES = ("SPAN_VERIFIED", "PSEUDONYMISED_TRACEABLE", "SYNTHETIC_UNPROVABLE")
CLASS_OF = {"QUOTE": "SPAN_VERIFIED", "PSEUDONYMISE": "PSEUDONYMISED_TRACEABLE", "PARAPHRASE": "SYNTHETIC_UNPROVABLE", "SYNTHESISE": "SYNTHETIC_UNPROVABLE"}
KEEP, REDACT = "KEEP", "REDACT"


def class_of(op: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_OF.items() for x in kv]), op)


def byte_offset(text: Column, chars: Column) -> Column:
    """The UTF-8 offset of a code point offset."""
    return F.octet_length(F.substr(text, F.lit(1), chars.cast("int")))


def segments(text: Column, spans: Column) -> Column:
    """array<struct(idx, start, end, kind, class, token)> of a text: its redacted spans and what lies between.

    ``spans`` is an array of struct(start, end, class, token) in code points, sorted, not empty and not
    overlapping; offsets come out in bytes. The segments cover the text without gaps.
    """
    shape = "array<struct<start: int, end: int, kind: string, class: string, token: string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("out"))
    item = lambda a, b, kind, c, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(kind).alias("kind"), c.alias("class"), t.alias("token"))
    none = F.lit(None).cast("string")

    def add(acc: Column, s: Column) -> Column:
        a, b = byte_offset(text, s["start"]), byte_offset(text, s["end"])
        gap = F.when(a > acc["at"], F.array(item(acc["at"], a, KEEP, none, none))).otherwise(F.array().cast(shape))
        return F.struct(b.alias("at"), F.concat(acc["out"], gap, F.array(item(a, b, REDACT, s["class"], s["token"]))).alias("out"))

    def tail(acc: Column) -> Column:
        n = F.octet_length(text)
        rest = F.when(n > acc["at"], F.array(item(acc["at"], n, KEEP, none, none))).otherwise(F.array().cast(shape))
        return F.concat(acc["out"], rest)

    return F.transform(F.aggregate(spans, zero, add, tail), lambda s, k: F.struct(k.alias("idx"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["class"].alias("class"), s["token"].alias("token")))


def piece(text: Column, s: Column) -> Column:
    """The bytes of one segment of the text."""
    return F.substring(text.cast("binary"), s["start"] + 1, s["end"] - s["start"])


def redacted(text: Column, segs: Column) -> Column:
    """The text with tokens in place of redacted segments."""
    return F.array_join(F.transform(segs, lambda s: F.when(s["kind"] == KEEP, piece(text, s).cast("string")).otherwise(s["token"])), "")


def leaves(doc_id: Column, text: Column, segs: Column, nonce: Column) -> Column:
    """One hash per segment: of the kept bytes, or a commitment to the redacted ones."""
    return F.transform(
        segs,
        lambda s: F.when(s["kind"] == KEEP, keep_leaf(doc_id, s["idx"], s["start"], s["end"], piece(text, s))).otherwise(commitment(doc_id, s["idx"], s["start"], s["end"], s["class"], piece(text, s), nonce)),
    )


def document_root(doc_leaves: Column) -> Column:
    return F.lower(F.hex(merkle_root_of(doc_leaves)))


def uncovered(segs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The segments that break the cover: a gap or overlap before them, or no length."""
    w = Window.partitionBy(*keys).orderBy("idx")
    return segs.withColumn("_before", F.coalesce(F.lag("end").over(w), F.lit(0))).where((F.col("_before") != F.col("start")) | (F.col("end") <= F.col("start"))).drop("_before")


def positions_in_redacted(segs: DataFrame, keys: Sequence[str], length: Column) -> DataFrame:
    """Adds ``at``: where a segment starts in the redacted text, a running sum of the lengths before."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return segs.withColumn("at", F.coalesce(F.sum(length).over(w), F.lit(0)))


def overlaps(spans: DataFrame, segs: DataFrame, doc: str) -> DataFrame:
    """Spans joined with the segments of their document that they overlap; spans have (lo, hi), segments (start, end)."""
    return spans.join(segs, doc).where((F.col("start") < F.col("hi")) & (F.col("end") > F.col("lo")))


def outside(spans: DataFrame, tokens: DataFrame, doc: str) -> DataFrame:
    """The spans (lo, hi) that overlap no token (start, end) of their document."""
    return spans.join(tokens.withColumnRenamed(doc, "_doc"), (F.col(doc) == F.col("_doc")) & (F.col("start") < F.col("hi")) & (F.col("end") > F.col("lo")), "left_anti")


def atom_content(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, content): the clipped pieces of an atom's segments in their order."""
    return pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "piece"))).alias("_p")).select(*keys, F.array_join(F.transform("_p", lambda x: x["piece"]), "").alias("content"))


def content_hash(content: Column, normalise: bool = True) -> Column:
    """The digest of an atom's text without marks."""
    plain = strip_marks(content)
    return F.sha2(nfc(plain) if normalise else plain, 256)


def ratios(atoms: DataFrame, episode: str, lineage: str, content: str) -> DataFrame:
    """(episode, class, n_atoms, n_bytes, pct_atoms, pct_bytes): per episode and, with a null episode, in all."""
    counted = atoms.select(F.col(episode), F.col(lineage).alias("class"), F.octet_length(content).alias("_b"))
    both = counted.groupingSets([[episode, "class"], ["class"]], episode, "class").agg(F.count("*").alias("n_atoms"), F.sum("_b").alias("n_bytes"))
    whole = both.groupBy(F.col(episode).alias("_e")).agg(F.sum("n_atoms").alias("_n"), F.sum("n_bytes").alias("_t"))
    pct = lambda x, of: F.when(F.col(of) > 0, F.bround(F.col(x) / F.col(of), 6)).otherwise(0.0)
    return both.join(whole, F.col(episode).eqNullSafe(F.col("_e"))).select(episode, "class", "n_atoms", "n_bytes", pct("n_atoms", "_n").alias("pct_atoms"), pct("n_bytes", "_t").alias("pct_bytes"))


def summaries(atoms: DataFrame, episode: str, lineage: str, content: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """One row per episode: atoms and bytes of each class, 0 where it has none."""
    of = lambda c: F.col(lineage) == c
    return atoms.groupBy(episode).agg(
        *[F.count_if(of(c)).alias(f"{c.lower()}_atoms") for c in classes], *[F.coalesce(F.sum(F.when(of(c), F.octet_length(content))), F.lit(0)).alias(f"{c.lower()}_bytes") for c in classes], F.count("*").alias("n_atoms")
    )


def duplicates(atoms: DataFrame, key: str) -> DataFrame:
    return atoms.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def atom_problems(atoms: DataFrame, refs: DataFrame, segs: DataFrame) -> DataFrame:
    """(atom_id, problems) of the atoms with any.

    ``atoms``: atom_id, op, lineage_class, content, content_sha256. ``refs``: atom_id, seq, doc_id, idx, leaf.
    ``segs``: doc_id, idx, kind, chunk, leaf.
    """
    held = refs.join(segs.select("doc_id", "idx", F.col("kind").alias("_kind"), F.col("chunk").alias("_chunk"), F.col("leaf").alias("_leaf")), ["doc_id", "idx"], "left")
    per = held.groupBy("atom_id").agg(
        F.count("*").alias("_refs"), F.count_if(F.col("_leaf").isNull()).alias("_lost"), F.count_if(F.col("_leaf") != F.col("leaf")).alias("_other"), F.count_if(F.col("_kind") == REDACT).alias("_redacted"),
        F.array_sort(F.collect_list(F.struct("seq", "_kind", "_chunk"))).alias("_parts"),
    )
    joined = atoms.join(per, "atom_id", "left").withColumn("_refs", F.coalesce("_refs", F.lit(0)))
    kept = F.array_join(F.transform(F.filter("_parts", lambda p: p["_kind"] == KEEP), lambda p: p["_chunk"]), "")
    every = F.array_join(F.transform("_parts", lambda p: p["_chunk"]), "")
    whole, plain = (F.col("_lost") == 0) & (F.col("_other") == 0), strip_marks(F.col("content"))
    quoted, traced = F.col("lineage_class") == CLASSES[0], F.col("lineage_class") == CLASSES[1]
    found = F.array_compact(F.array(
        F.when(class_of(F.col("op")).isNull(), "unknown op"), F.when(class_of(F.col("op")) != F.col("lineage_class"), "class does not follow from op"),
        F.when(content_hash(F.col("content"), normalise=False) != F.col("content_sha256"), "content digest"), F.when(F.col("_lost") > 0, "reference does not resolve"), F.when(F.col("_other") > 0, "leaf differs"),
        F.when((quoted | traced) & (F.col("_refs") == 0), "no references"), F.when(quoted & (F.col("_redacted") > 0), "quotes a redacted segment"),
        F.when(quoted & whole & (F.col("_refs") > 0) & ~F.contains(kept, plain), "not in the kept text"), F.when(traced & whole & (F.col("_refs") > 0) & ~F.contains(every, plain), "not in the redacted text"),
    ))
    return joined.select("atom_id", found.alias("problems")).where(F.size("problems") > 0)


def mode_problems(atoms: DataFrame, refs: DataFrame, modes: DataFrame) -> DataFrame:
    """(doc_id, problem): documents to be synthesised that verifiable atoms cite, and documents cited in both ways."""
    ops = refs.join(atoms.select("atom_id", "op"), "atom_id").groupBy("doc_id").agg(F.max(F.col("op").isin("QUOTE", "PSEUDONYMISE")).alias("_v"), F.max(F.col("op") == "SYNTHESISE").alias("_s"))
    told = ops.join(modes, "doc_id", "left").select("doc_id", F.explode(F.array_compact(F.array(F.when((F.col("mode") == "SYNTHESISE") & F.col("_v"), "synthesised document cited"), F.when(F.col("_v") & F.col("_s"), "mixed modes")))).alias("problem"))
    return told


def manifest_root(doc_ids: Column) -> Column:
    """The root over sorted document ids of one manifest that fits a row."""
    return F.lower(F.hex(merkle_root_of(F.transform(F.array_sort(doc_ids), manifest_leaf))))


def manifest_roots(docs: DataFrame, keys: Sequence[str], doc_id: str) -> DataFrame:
    """(keys, n, root) of manifests that may be large: distinct ids in their order, hashed level by level over the whole table."""
    ids = numbered_within(docs.select(*keys, doc_id).distinct(), keys, [doc_id], "_at")
    counts = ids.groupBy(*keys).agg(F.count("*").alias("n"))
    roots = merkle_roots(ids.select(*keys, "_at", manifest_leaf(F.col(doc_id)).alias("_leaf")), list(keys), "_at", "_leaf")
    return counts.join(roots, list(keys)).select(*keys, "n", F.lower(F.hex("root")).alias("root"))


def doc_id_of(text: Column) -> Column:
    return F.lower(F.hex(sha256(text)))
