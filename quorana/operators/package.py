"""Checks of a lineage package by who receives it. Each gives the rows that break it, as (gate, subject, problem).

A package is tables: ``docs`` (doc_id, mode, redacted, root, segs), with the segments of a document
as an array of its row; ``manifest`` (position, doc_id), ``files`` (path, content) and so on. What
one document needs is in its row, so rebuilding is one pass without a shuffle. Signatures are not
checked: no library here verifies them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorana.functions.codes import keep_leaf, merkle_root_of
from quorana.functions.text import carriers, utc_timestamp
from quorana.functions.values import PATTERNS, band, parse_amount
from quorana.operators import lineage, residual
from quorana.operators.chain import broken_links
from quorana.operators.similarity import containing, near_duplicates

# --- fixed values: the classes of redacted spans, the mode that ships no text, the least share of traced bytes, the token form
SYNTHESISE, TIER_FLOOR = "SYNTHESISE", 0.8
TOKEN = r"⟦([A-Z_]+):[^⟦⟧]*⟧"
# --- fixed values: capitalised words that are no names, and how far a name counts as near
NO_NAME = {
    "the", "please", "this", "that", "these", "those", "our", "your", "their", "from", "subject", "author", "kind", "best", "regards", "thanks", "hello", "dear", "note", "operations", "client", "settlement", "margin", "trade",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
}
PROPER = re.compile(r"\b[A-Z][a-z]{2,}\b")
NAME_WINDOW, TOKEN_WINDOW = 60, 40
ALWAYS, WITH_NAME = ("EMAIL", "PHONE", "IBAN", "ACCOUNT_ID", "TRADE_ID"), ("LEI", "ISIN")
NAMED_CLASSES = ("PERSON", "LEGAL_ENTITY", "COUNTERPARTY", "CLIENT")


def broken(rows: DataFrame, gate: str, subject: Column, problem: Column | str) -> DataFrame:
    told = F.lit(problem) if isinstance(problem, str) else problem
    return rows.select(F.lit(gate).alias("gate"), subject.cast("string").alias("subject"), told.alias("problem"))


def _each(rows: DataFrame, gate: str, subject: Column, problems: Sequence[Column]) -> DataFrame:
    return broken(rows.withColumn("_p", F.explode(F.array_compact(F.array(*problems)))), gate, subject, F.col("_p"))


def rebuilt(redacted: Column, segs: Column) -> Column:
    """array<struct(at, n, chunk, fits)>: where each segment stands in the redacted bytes; ``fits`` is false where its token does not."""
    raw = redacted.cast("binary")
    shape = "array<struct<at: int, n: int>>"
    length = lambda s: F.when(s["kind"] == lineage.KEEP, s["end"] - s["start"]).otherwise(F.octet_length(s["token"])).cast("int")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("out"))
    places = F.aggregate(segs, zero, lambda acc, s: F.struct((acc["at"] + length(s)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), length(s).alias("n")))).alias("out")), lambda acc: acc["out"])

    def cut(s: Column, p: Column) -> Column:
        chunk = F.substring(raw, p["at"] + 1, p["n"])
        fits = (F.octet_length(chunk) == p["n"]) & F.when(s["kind"] == lineage.KEEP, True).otherwise(chunk == s["token"].cast("binary"))
        return F.struct(p["at"].alias("at"), p["n"].alias("n"), chunk.alias("chunk"), fits.alias("fits"))

    return F.zip_with(segs, places, cut)


def rebuilt_root(doc_id: Column, segs: Column, pieces: Column) -> Column:
    """The root over the leaves of the kept pieces and the commitments of the others."""
    leaf = lambda s, p: F.when(s["kind"] == lineage.KEEP, keep_leaf(doc_id, s["idx"], s["start"], s["end"], p["chunk"])).otherwise(F.unhex(s["commit"]))
    return F.lower(F.hex(merkle_root_of(F.zip_with(segs, pieces, leaf))))


def check_manifest(manifest: DataFrame, docs: DataFrame, told_root: str, told_digest: Column, digest: Column, gate: str = "V1") -> DataFrame:
    """A manifest that is out of order, repeats itself, has another root or digest, or lacks documents of the package."""
    repeated = manifest.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    # out of order: the place among the ids in their order is not the stored one
    ranked = lineage.numbered_within(manifest.withColumn("all", F.lit(1)), ["all"], ["doc_id", "position"], "rank")
    unsorted = ranked.where("rank <> position").agg(F.count("*").alias("n")).where("n > 0")
    root = lineage.manifest_roots(manifest.select(F.lit("all").alias("m"), "doc_id"), ["m"], "doc_id").where(F.col("root") != told_root)
    other = docs.sparkSession.range(1).where(digest != told_digest)
    lacking = docs.join(manifest.select("doc_id"), "doc_id", "left_anti")
    parts = [
        broken(repeated, gate, F.col("doc_id"), "repeated"), broken(unsorted, gate, F.lit("manifest"), "order"), broken(root, gate, F.lit("manifest"), "root"),
        broken(other, gate, F.lit("manifest"), "digest"), broken(lacking, gate, F.col("doc_id"), "not in the manifest"),
    ]
    return _all(parts)


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_roots(docs: DataFrame, classes: Sequence[str], gate: str = "V2") -> DataFrame:
    """Documents whose segments leave gaps, do not fit the redacted text, have an unknown class, or give another root."""
    rows = docs.where(F.col("mode") != SYNTHESISE).withColumn("_pieces", rebuilt(F.col("redacted"), F.col("segs")))
    rows = rows.withColumn("_again", rebuilt_root(F.col("doc_id"), F.col("segs"), F.col("_pieces")))
    total = F.aggregate("_pieces", F.lit(0), lambda acc, p: acc + p["n"])
    ends = F.transform("segs", lambda s: s["end"])
    gap = F.exists("segs", lambda s: s["start"] != F.when(s["idx"] == 0, 0).otherwise(F.get(ends, s["idx"] - 1)))
    return _each(rows, gate, F.col("doc_id"), [
        F.when(gap, "cover"), F.when(F.exists("_pieces", lambda p: ~p["fits"]) | (total != F.octet_length("redacted")), "text"),
        F.when(F.exists("segs", lambda s: (s["kind"] == lineage.REDACT) & ~s["class"].isin(*classes)), "class"), F.when(F.col("_again") != F.col("root"), "root"),
    ])


def check_ratios(atoms: DataFrame, shipped: DataFrame, gate: str = "V4") -> DataFrame:
    """Shipped ratios (episode_id, class, n_atoms, n_bytes) that the atoms do not give, in either direction."""
    again = lineage.ratios(atoms, "episode_id", "lineage_class", "content").select("episode_id", "class", "n_atoms", "n_bytes")
    told = shipped.select(F.col("episode_id").alias("_e"), F.col("class").alias("_c"), F.col("n_atoms").alias("_a"), F.col("n_bytes").alias("_b"))
    both = again.join(told, F.col("episode_id").eqNullSafe(F.col("_e")) & (F.col("class") == F.col("_c")), "full_outer")
    wrong = both.where(~(F.col("n_atoms").eqNullSafe(F.col("_a")) & F.col("n_bytes").eqNullSafe(F.col("_b"))))
    subject = F.concat_ws("/", F.coalesce(F.coalesce("episode_id", "_e").cast("string"), F.lit("all")), F.coalesce("class", "_c"))
    return broken(wrong, gate, subject, F.when(F.col("_a").isNull(), "not shipped").when(F.col("n_atoms").isNull(), "not recomputed").otherwise("differs"))


def tiers(atoms: DataFrame, key: str, floor: float = TIER_FLOOR) -> DataFrame:
    """(key, traced_share, tier): VERIFIED from ``floor`` of a package's bytes traced on, else MIXED."""
    size = F.octet_length("content")
    share = F.coalesce(F.sum(F.when(F.col("lineage_class").isin(*lineage.CLASSES[:2]), size)) / F.nullif(F.sum(size), F.lit(0)), F.lit(0.0))
    return atoms.groupBy(key).agg(share.alias("traced_share")).withColumn("tier", F.when(F.col("traced_share") >= floor, "VERIFIED").otherwise("MIXED"))


def check_floor(tiers: DataFrame, meta: DataFrame, key: str, gate: str = "B-G4") -> DataFrame:
    """Packages (key, marketed_tier, tier_label) that are sold as VERIFIED and are not, or as MIXED under another label."""
    joined = meta.join(tiers, key, "left")
    ok = F.when(F.coalesce("marketed_tier", F.lit("VERIFIED")) == "VERIFIED", F.col("tier").eqNullSafe(F.lit("VERIFIED")) & F.col("tier_label").eqNullSafe(F.lit("VERIFIED"))).otherwise(F.col("tier_label").eqNullSafe(F.lit("MIXED")))
    return broken(joined.where(~ok), gate, F.col(key), F.concat_ws(" ", F.coalesce("tier", F.lit("none")), F.lit("as"), F.coalesce("tier_label", F.lit("none"))))


def check_marks(packages: DataFrame, registry: DataFrame, texts: DataFrame, least: int = 3, gate: str = "V5") -> DataFrame:
    """Packages (package_id, recipient_id) without a registered tag, under another recipient's, or whose texts (package_id, text) do not carry it."""
    told = registry.select("package_id", F.col("recipient_id").alias("_r"), F.col("tag").alias("_tag"))
    found = texts.select("package_id", F.explode(carriers(F.col("text"))).alias("c")).groupBy("package_id", F.col("c.tag").alias("tag")).agg(F.count("*").alias("n"))
    best = found.groupBy("package_id").agg(F.max_by("tag", F.struct("n", "tag")).alias("_found"), F.max("n").alias("_n"))
    rows = packages.join(told, "package_id", "left").join(best, "package_id", "left")
    return _each(rows, gate, F.col("package_id"), [
        F.when(F.col("_tag").isNull(), "not registered"), F.when(F.col("_r") != F.col("recipient_id"), "recipient"), F.when(F.col("_tag").isNotNull() & ~((F.coalesce("_n", F.lit(0)) >= least) & F.col("_found").eqNullSafe(F.col("_tag"))), "mark"),
    ])


def check_holdout(commit: DataFrame, files: DataFrame, episodes: DataFrame, items: DataFrame, gate: str = "V6") -> DataFrame:
    """Commitments (holdout_id, items_commit, created_utc) that are malformed, item ids that stand in files, and episodes like an item."""
    shape = _each(commit, gate, F.col("holdout_id"), [
        F.when(~F.coalesce(F.col("items_commit").rlike("^.{64}$"), F.lit(False)), "commitment"), F.when(utc_timestamp(F.col("created_utc")).isNull(), "time"),
    ])
    leaked = containing(files.select("path", "content"), items.where("item_name <> ''").select("item_name", F.col("item_name").alias("item_text")), "path", "item_name", "content", "item_text")
    alike = near_duplicates(episodes, items.select("item_name", F.col("task_text").alias("item_task")), "episode_id", "item_name", "task_text", "item_task")
    return _all([shape, broken(leaked, gate, F.col("path"), F.concat(F.lit("names "), F.col("item_name"))), broken(alike, gate, F.col("episode_id"), F.concat(F.lit("like "), F.col("item_name")))])


def check_files(files: DataFrame, known: DataFrame, gate: str = "V7") -> DataFrame:
    """Files (path, content) that belong into a vault. ``known`` (digest) are the digests that the package explains."""
    named = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.col("content").cast("string"), F.lit(r"\b[0-9a-f]{64}\b"), F.lit(0)))).alias("digest"))
    # only the explained ones among a file's own digests come back to it
    explained = named.join(known.select("digest").distinct(), "digest").groupBy("path").agg(F.collect_set("digest").alias("_known"))
    rows = files.join(explained, "path", "left").withColumn("_r", residual.suspicious(F.col("path"), F.col("content"), F.coalesce("_known", F.array().cast("array<string>"))))
    return broken(rows.select("path", F.explode("_r").alias("r")), gate, F.col("path"), F.col("r"))


def check_registry(lines: DataFrame, packages: DataFrame, gate: str = "B-G2") -> DataFrame:
    """Registry lines (registry, position, payload, told) that break the chain, and packages that no line names."""
    links = broken_links(lines, ["registry"], "position", "payload", "told")
    lacking = packages.join(lines.select("package_id", "recipient_id"), ["package_id", "recipient_id"], "left_anti")
    return _all([broken(links, gate, F.concat_ws("/", "registry", F.col("position").cast("string")), "link"), broken(lacking, gate, F.col("package_id"), "no registered salt")])


def check_leakage(package_docs: DataFrame, files: DataFrame, episodes: DataFrame, items: DataFrame, at_least: float = 0.8, gate: str = "B-G1") -> DataFrame:
    """Documents, tokens and item names that a package shares with the holdout, and episodes like an item.

    ``items``: item_name, task_text, answer, source_doc_ids.
    """
    shared = package_docs.select("doc_id").intersect(items.select(F.explode("source_doc_ids").alias("doc_id")))
    tokens = lambda df, text: df.select(F.explode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("token"))
    both = tokens(files, F.col("content")).intersect(tokens(items, F.concat_ws(" ", "task_text", F.col("answer").cast("string"))))
    alike = near_duplicates(episodes, items.select("item_name", F.col("task_text").alias("item_task")), "episode_id", "item_name", "task_text", "item_task", at_least=at_least)
    named = containing(files.where("path <> 'holdout/commit.json'"), items.where("item_name <> ''").select("item_name", F.col("item_name").alias("item_text")), "path", "item_name", "content", "item_text").select("item_name").distinct()
    return _all([broken(shared, gate, F.col("doc_id"), "document"), broken(both, gate, F.col("token"), "token"), broken(alike, gate, F.col("episode_id"), F.concat(F.lit("like "), F.col("item_name"))), broken(named, gate, F.col("item_name"), "item name")])


def check_again(docs: DataFrame, again: DataFrame, gate: str = "B-G8") -> DataFrame:
    """Documents that a second redaction does not give byte for byte, or has no source for."""
    told = again.select("doc_id", F.col("redacted").alias("_again"), F.col("root").alias("_root"))
    rows = docs.where(F.col("mode") != SYNTHESISE).join(told, "doc_id", "left")
    return _each(rows, gate, F.col("doc_id"), [F.when(F.col("_root").isNull(), "no source"), F.when((F.col("_again") != F.col("redacted")) | (F.col("_root") != F.col("root")), "differs")])


def check_precedence(commits: DataFrame, audit: DataFrame, gate: str = "B-G9") -> DataFrame:
    """Holdouts (package_id, created_utc) that were not committed strictly before their first external review (package_id, event, ts)."""
    reviews = audit.where("event = 'external_review'").select("package_id", utc_timestamp(F.col("ts")).alias("at")).where("at IS NOT NULL")
    first = reviews.groupBy("package_id").agg(F.min("at").alias("_first"))
    created = utc_timestamp(F.col("created_utc"))
    problem = F.when(created.isNull(), "no time").when(created >= F.col("_first"), "after the review")
    return broken(commits.join(first, "package_id", "left").withColumn("_p", problem).where("_p IS NOT NULL"), gate, F.col("package_id"), F.col("_p"))


def check_pseudonyms(entries: DataFrame, gate: str = "E4") -> DataFrame:
    """Vault entries (doc_id, idx, class, original, expected, shipped) whose token is not the derived one, tokens of several originals, originals with several tokens."""
    wrong = entries.where(~F.col("shipped").eqNullSafe(F.col("expected")))
    scope = F.when(F.col("class").isin("DATE", "AMOUNT_EXACT"), F.col("doc_id")).otherwise("*")
    held = entries.select(scope.alias("scope"), F.concat_ws(":", "class", "original").alias("original"), F.col("shipped").alias("token"))
    mixed = residual.inconsistent_tokens(held, ["scope"], "original", "token")
    return _all([broken(wrong, gate, F.concat_ws("#", "doc_id", F.col("idx").cast("string")), "token"), broken(mixed, gate, F.col("value"), F.when(F.col("side") == "token", "collision").otherwise("split"))])


def check_originals(docs: DataFrame, vault: DataFrame, manifest: DataFrame, gate: str = "E5") -> DataFrame:
    """Documents that their kept pieces and the vault's originals do not put together again to what their id says, or that the manifest lacks."""
    held = vault.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "original"))).alias("_held"))
    rows = docs.where(F.col("mode") != SYNTHESISE).join(held, "doc_id", "left").join(manifest.select("doc_id").distinct().withColumn("_listed", F.lit(True)), "doc_id", "left")
    parts = F.zip_with("segs", rebuilt(F.col("redacted"), F.col("segs")), lambda s, p: F.when(s["kind"] == lineage.KEEP, p["chunk"]).otherwise(F.element_at("_held", s["idx"]).cast("binary")))
    whole = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x))
    again = F.sha2(whole, 256)
    return _each(rows, gate, F.col("doc_id"), [F.when(~F.coalesce(again == F.col("doc_id"), F.lit(False)), "original"), F.when(F.col("_listed").isNull(), "not in the manifest")])


def check_origin(origins: DataFrame, institutions: Sequence[str], start: str, end: str, gate: str = "E7") -> DataFrame:
    """Documents (doc_id, institution, period_start, period_end) outside of the declared scope."""
    problem = F.when(~F.col("institution").isin(*institutions), "institution").when(~((F.lit(start) <= F.col("period_start")) & (F.col("period_end") <= F.lit(end))), "period")
    return broken(origins.withColumn("_p", problem).where("_p IS NOT NULL"), gate, F.col("doc_id"), F.col("_p"))


def quasi_tuple(text: Column, products: Sequence[str], venues: Sequence[str]) -> Column:
    """struct(product, band, bucket, venue): what a text says that may give it away together; null for what it does not say."""
    low = F.lower(text)
    first = lambda names: F.get(F.filter(F.array(*[F.lit(n) for n in sorted(names, key=len, reverse=True)]), lambda n: F.contains(low, F.lower(n))), F.lit(0))
    none = F.lit(None).cast("string")
    token, amount = F.regexp_extract(text, "⟦AMOUNT:([^⟧]+)⟧", 1), F.regexp_extract(text, PATTERNS["AMOUNT_EXACT"], 0)
    said = F.when(token != "", token).when(amount != "", band(parse_amount(amount)))
    return F.struct(
        (first(products) if products else none).alias("product"), said.alias("band"), F.nullif(F.regexp_extract(text, r"⟦DATE:(\d{4}-\d{2})", 1), F.lit("")).alias("bucket"), (first(venues) if venues else none).alias("venue")
    )


class NameContext:
    """Capitalised words that may be names: not at a sentence's start, and on no list."""

    def __init__(self, allowed: Sequence[str] = ()):
        self.known = NO_NAME | {a.casefold() for a in allowed}

    def starts_sentence(self, text: str, at: int) -> bool:
        before = text[:at].rstrip()[-1:]
        return not before or before in ".!?:;\n-—]*"

    def names(self, text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        for m in PROPER.finditer(text, max(0, lo), min(len(text), hi)):
            if m[0].casefold() not in self.known and not self.starts_sentence(text, m.start()):
                yield m.span()


def text_findings(text: Column, detector: residual.Detector, allowed: Sequence[str] = ()) -> Column:
    """array<struct(rule, severity, what, at)> of a redacted text by the first, second and fourth rule; tokens themselves are skipped.

    R1: names that detection still finds. R2: identifiers, of which some count only near a name. R4: a counterparty's token near a name.
    """
    kinds = [(re.compile(PATTERNS[k].removeprefix("(?U)")), k) for k in (*ALWAYS, *WITH_NAME)]
    token, context, free = re.compile(TOKEN), NameContext(allowed), {a.casefold() for a in allowed}

    @F.pandas_udf("array<struct<rule: string, severity: string, what: string, at: int>>")
    def found(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts.fillna(""):
            tokens = [m.span() for m in token.finditer(t)]
            inside = lambda a, b, spans=tokens: any(a < e and b > s for s, e in spans)
            rows = [("R1", "HIGH", c, a) for a, b, c, _ in detector.spans(t) if c in NAMED_CLASSES and t[a:b].casefold() not in free and not inside(a, b)]
            for pattern, kind in kinds:
                for m in pattern.finditer(t):
                    if not inside(*m.span()):
                        sure = kind in ALWAYS or next(context.names(t, m.start() - NAME_WINDOW, m.start() + NAME_WINDOW), None) is not None
                        rows.append(("R2", "CRITICAL" if sure else "MEDIUM", kind, m.start()))
            for m in token.finditer(t):
                if m[1] == "COUNTERPARTY":
                    near = next((a for a, b in context.names(t, m.start() - TOKEN_WINDOW, m.end() + TOKEN_WINDOW) if not inside(a, b)), None)
                    if near is not None:
                        rows.append(("R4", "MEDIUM", "COUNTERPARTY", near))
            out.append([{"rule": r, "severity": s, "what": w, "at": a} for r, s, w, a in rows])
        return pd.Series(out, dtype=object)

    return found(text)


def rare_tuples(docs: DataFrame, products: Sequence[str], venues: Sequence[str], k_min: int = residual.K_MIN, gate: str = "R3") -> DataFrame:
    """Documents (doc_id, redacted) whose tuple of two or more known values fewer than ``k_min`` documents share."""
    rows = docs.withColumn("_t", quasi_tuple(F.col("redacted"), products, venues)).select("doc_id", "_t.*")
    names = ["product", "band", "bucket", "venue"]
    rare = residual.k_anonymity(rows, names, k_min=k_min)
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names]
    return broken(rows.alias("l").join(rare.alias("r"), on).select("l.doc_id", "r.k"), gate, F.col("doc_id"), F.format_string("k = %d", "k"))


def severity_counts(findings: DataFrame, n_kept: Column) -> DataFrame:
    """The residual gate over rows with a severity: counts, and whether they pass."""
    return residual.severity_gate(findings, n_kept)
