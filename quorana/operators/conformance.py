"""Rules that released tables must keep, as (gate, subject, problem) of what breaks them; and the release itself."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorana.functions.codes import canonical_json
from quorana.operators.package import _all, _each, broken

#: Verdicts, states that must be told apart, how releases and digests are written.
VERDICTS, STATES = ("PASS", "FAIL", "UNCERTAIN", "NOT_APPLICABLE"), ("directed", "scheduled", "executed", "completed", "verified")
TAG, DIGEST, COMMIT = "^[A-Za-z0-9][A-Za-z0-9_.-]*$", "^[0-9a-f]{64}$", "^[0-9a-f]{40}$"


def cells(rows: DataFrame, admitted: DataFrame, current: str) -> DataFrame:
    """Cells (cell_id, urls, public_source, magnitude_band, status, division_key, history) against the admitted keys (run, division_key).

    Citations need a URL, the anchor a public source and no invented precision; a key that is not
    retired must be admitted in the current run, and a historical key stand as its run has it.
    """
    urls = rows.select("cell_id", F.posexplode("urls").alias("k", "url")).where(~F.col("url").startswith("http"))
    anchor = _each(rows, "S3-G2", F.col("cell_id"), [
        F.when(F.coalesce("public_source", F.lit("")) == "", "no public source"), F.when(F.coalesce("magnitude_band", F.lit("")).rlike(r"\d+\.\d{3,}"), "precision"),
    ])
    now = admitted.where(F.col("run") == current).select("division_key").distinct()
    unknown = rows.where("status <> 'RETIRED'").join(now, "division_key", "left_anti")
    past = rows.select("cell_id", F.col("division_key").alias("_now"), F.posexplode("history").alias("k", "h")).select("cell_id", "_now", "k", "h.*")
    known = admitted.select("run", "division_key").distinct().withColumn("_was", F.lit(True))
    told = past.join(known, ["run", "division_key"], "left")
    was, claims = F.coalesce("_was", F.lit(False)), F.coalesce("admission_status", F.lit("ADMITTED")) == "ADMITTED"
    subject = F.concat_ws("#", "cell_id", F.col("k").cast("string"))
    history = _each(told, "S3-G5", subject, [F.when(F.col("division_key") == F.col("_now"), "repeats the current key"), F.when(claims & ~was, "was not admitted"), F.when(~claims & was, "was admitted")])
    return _all([broken(urls, "S3-G1", F.concat_ws("#", "cell_id", F.col("k").cast("string")), "no URL"), anchor, broken(unknown, "S3-G5", F.col("cell_id"), "not admitted"), history])


def deny_list(lines: DataFrame, line: str = "value") -> DataFrame:
    """(kind, entry) of a deny list's lines: literal in lower case, regex after 'regex:'; comments and blanks are none."""
    text = F.trim(line)
    rows = lines.where((text != "") & ~text.startswith("#")).withColumn("kind", F.when(text.startswith("regex:"), "regex").otherwise("literal"))
    return rows.select("kind", F.when(F.col("kind") == "regex", F.substr(text, F.lit(7))).otherwise(F.lower(text)).alias("entry"))


def denied(texts: DataFrame, literals: Sequence[str], patterns: Sequence[str]) -> DataFrame:
    """Texts (path, text) with an entry of a deny list; literals anywhere, patterns in any case."""
    low = F.lower("text")
    hits = [F.when(F.contains(low, F.lit(x)), F.concat(F.lit("literal "), F.lit(x))) for x in literals] + [F.when(F.col("text").rlike(f"(?i){p}"), F.concat(F.lit("pattern "), F.lit(p))) for p in patterns]
    return _each(texts, "S3-G3", F.col("path"), hits)


def numbered_rows(rows: DataFrame, least: int) -> DataFrame:
    """A statused list (number, status) that is too short or has lost or moved a row; ``position`` is where a row stands."""
    short = rows.agg(F.count("*").alias("n")).where(F.col("n") < least)
    return _all([broken(short, "S3-G4", F.lit("rows"), F.format_string("%d rows", "n")), broken(rows.where("number <> position"), "S3-G4", F.col("number"), "number"), broken(rows.where(~F.col("status").isin("EVIDENCED", "PARTIAL", "NOT MET")), "S3-G4", F.col("number"), "status")])


def mappings(rows: DataFrame, standards: DataFrame, relations: Sequence[str], objects: DataFrame) -> DataFrame:
    """Mappings (location, authority, relation, term) under an undeclared authority, a prohibited relation or without a term; relations between unknown objects.

    ``standards``: authority, uri, label, use. ``objects``: (location, needs) of what must have a mapping.
    """
    declared = standards.select("authority").distinct().withColumn("_d", F.lit(True))
    told = rows.join(declared, "authority", "left")
    bad = _each(told, "S4-G2", F.col("location"), [F.when(F.col("_d").isNull(), "authority"), F.when(~F.coalesce(F.col("relation").isin(*relations), F.lit(False)), "relation"), F.when(F.coalesce("term", F.lit("")) == "", "term")])
    weak = _each(standards, "S4-G2", F.col("authority"), [F.when(~F.coalesce(F.col("uri").startswith("https://"), F.lit(False)), "uri"), F.when((F.coalesce("label", F.lit("")) == "") | (F.coalesce("use", F.lit("")) == ""), "label")])
    bare = objects.join(rows.select("location").distinct(), "location", "left_anti")
    return _all([bad, weak, broken(bare, "S4-G3", F.col("location"), "no mapping")])


def lacking(held: DataFrame, key: str, required: Sequence[str], gate: str = "S5-G2") -> DataFrame:
    """Required values that a set (key, value) lacks."""
    per = held.groupBy(key).agg(F.collect_set("value").alias("_v"))
    return broken(per.select(key, F.explode(F.array_except(F.array(*[F.lit(x) for x in required]), "_v")).alias("x")), gate, F.col(key), F.concat(F.lit("lacks "), F.col("x")))


def run_ledger(rows: DataFrame, verdicts: Sequence[str] = VERDICTS) -> DataFrame:
    """Ledger rows (position, body, row_sha256, replaces, verdict): wrong or repeated digests, corrections of later rows, unknown verdicts."""
    wrong = rows.where(F.sha2("body", 256) != F.col("row_sha256"))
    first = rows.groupBy("row_sha256").agg(F.min("position").alias("_first"))
    again = rows.join(first, "row_sha256").where("position > _first")
    claims = rows.where("replaces IS NOT NULL").join(first.select(F.col("row_sha256").alias("replaces"), "_first"), "replaces", "left")
    # a row may name itself: it has been seen by then
    late = claims.where(F.col("_first").isNull() | (F.col("_first") > F.col("position")))
    at = F.col("position")
    return _all([broken(wrong, "S7-G2", at, "digest"), broken(again, "S7-G2", at, "repeated"), broken(late, "S7-G2", at, "replaces no earlier row"), broken(rows.where(~F.coalesce(F.col("verdict").isin(*verdicts), F.lit(False))), "S7-G3", at, "verdict")])


def concepts(members: DataFrame, released: DataFrame, rulings: DataFrame, divisions: DataFrame) -> DataFrame:
    """Concepts that do not partition what is released, or claim a review that is not there.

    ``members``: concept_id, division_key, kind, reference_id. ``released``: reference_id, division_key, kind. ``rulings``:
    division_key, ruled_by, ruled_at, basis. ``divisions``: division_key, review_status.
    """
    told = released.select("reference_id", F.col("division_key").alias("_d"), F.col("kind").alias("_k"))
    astray = members.join(told, "reference_id", "left").where(~(F.col("_d").eqNullSafe(F.col("division_key")) & F.col("_k").eqNullSafe(F.col("kind"))))
    counted = members.groupBy("reference_id").agg(F.count("*").alias("n")).join(released.select("reference_id").withColumn("_r", F.lit(True)), "reference_id", "full_outer")
    uneven = counted.where(F.col("_r").isNotNull() & (F.coalesce("n", F.lit(0)) != 1))
    argued = F.coalesce((F.trim("ruled_by") != "") & F.col("ruled_at").isNotNull() & (F.trim("basis") != ""), F.lit(False))
    reviewed = divisions.join(rulings.withColumn("_ruled", F.lit(True)), "division_key", "left")
    status = F.when((F.col("review_status") == "REVIEWED") & ~argued, "reviewed without a ruling").when((F.col("review_status") != "REVIEWED") & F.col("_ruled").isNotNull(), "ruled without a review")
    return _all([
        broken(astray, "S8-G2", F.concat_ws("/", "concept_id", "reference_id"), "outside its division or kind"), broken(uneven, "S8-G2", F.col("reference_id"), F.format_string("in %d concepts", F.coalesce("n", F.lit(0)))),
        broken(reviewed.withColumn("_p", status).where("_p IS NOT NULL"), "S8-G3", F.col("division_key"), F.col("_p")),
    ])


def manifest(artifacts: DataFrame, release: Mapping[str, str]) -> DataFrame:
    """(document): a release manifest as canonical JSON over artifacts (path, size, media_type, sha256, role), with its aggregate and its own digest.

    The list of a release's files is what the document holds, so it is one row.
    """
    listed = artifacts.select(F.struct("path", "role", "media_type", "size", "sha256").alias("a")).agg(F.sort_array(F.collect_list("a")).alias("artifacts"))
    body = listed.select("artifacts", F.sha2(canonical_json(F.to_json("artifacts")), 256).alias("aggregate_sha256"), F.struct(*[F.lit(v).alias(k) for k, v in release.items()]).alias("release"))
    whole = body.withColumn("manifest_sha256", F.sha2(canonical_json(F.to_json(F.struct("aggregate_sha256", "artifacts", "release"))), 256))
    return whole.select(canonical_json(F.to_json(F.struct("aggregate_sha256", "artifacts", "manifest_sha256", "release"))).alias("document"))


def manifest_problems(documents: DataFrame) -> DataFrame:
    """Manifests (name, document) whose artifacts are out of order, or whose digests are not those of what they hold."""
    shape = "aggregate_sha256 string, artifacts array<struct<path: string, role: string, media_type: string, size: bigint, sha256: string>>, manifest_sha256 string, release map<string,string>"
    rows = documents.withColumn("m", F.from_json("document", shape))
    paths = F.transform("m.artifacts", lambda a: a["path"])
    aggregate = F.sha2(canonical_json(F.to_json("m.artifacts")), 256)
    own = F.sha2(canonical_json(F.to_json(F.struct(F.col("m.aggregate_sha256").alias("aggregate_sha256"), F.col("m.artifacts").alias("artifacts"), F.col("m.release").alias("release")))), 256)
    return _each(rows, "S4-G5", F.col("name"), [F.when(F.col("m.artifacts").isNull(), "unreadable"), F.when(paths != F.array_sort(paths), "order"), F.when(aggregate != F.col("m.aggregate_sha256"), "aggregate"), F.when(own != F.col("m.manifest_sha256"), "digest")])


def snapshot_index(releases: DataFrame) -> DataFrame:
    """Index entries (tag, manifest_sha256, manifest_file_sha256, commit_sha, snapshot_dir) that are malformed or stand for more than one release."""
    fits = lambda c, p: F.coalesce(F.col(c).rlike(p), F.lit(False))
    shape = _each(releases, "snapshot", F.coalesce("tag", F.lit("")), [
        F.when(~fits("tag", TAG), "tag"), F.when(~fits("manifest_sha256", DIGEST), "manifest digest"), F.when(~fits("manifest_file_sha256", DIGEST), "file digest"), F.when(~fits("commit_sha", COMMIT), "commit"),
        F.when(~F.col("snapshot_dir").eqNullSafe(F.concat(F.lit("reference/release-snapshots/"), "tag")), "folder"),
    ])
    twice = lambda c: broken(releases.groupBy(c).agg(F.count("*").alias("n")).where("n > 1"), "snapshot", F.col(c), f"repeated {c}")
    return _all([shape, twice("tag"), twice("manifest_sha256")])


def archive_problems(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Archived files (tag, path, sha256) that are missing or differ from (tag, path, content), and files that no list names."""
    there = files.select("tag", "path", F.sha2("content", 256).alias("_is"))
    both = listed.join(there, ["tag", "path"], "full_outer")
    problem = F.when(F.col("_is").isNull(), "missing").when(F.col("sha256").isNull(), "not listed").when(F.col("sha256") != F.col("_is"), "differs")
    return broken(both.withColumn("_p", problem).where("_p IS NOT NULL"), "archive", F.concat_ws("/", "tag", "path"), F.col("_p"))


def surface_problems(catalogue: DataFrame, grouped: DataFrame, matrix: DataFrame) -> DataFrame:
    """Division keys that the catalogue, the concepts and the matrix do not all have."""
    held = lambda df, name: df.select("division_key").distinct().withColumn(name, F.lit(True))
    all_three = held(catalogue, "c").join(held(grouped, "g"), "division_key", "full_outer").join(held(matrix, "m"), "division_key", "full_outer")
    gone = F.array_join(F.array_compact(F.array(F.when(F.col("c").isNull(), "catalogue"), F.when(F.col("g").isNull(), "concepts"), F.when(F.col("m").isNull(), "matrix"))), ",")
    return broken(all_three.withColumn("_p", gone).where("_p <> ''"), "surface", F.col("division_key"), F.concat(F.lit("not in "), F.col("_p")))


def resolved_items(explicit: DataFrame | None, vault: DataFrame, holdouts: DataFrame) -> DataFrame:
    """(holdout_id, items, source): the items of each holdout, as given, else from the vault, else none."""
    given = holdouts.select("holdout_id") if explicit is None else holdouts.select("holdout_id").join(explicit.select("holdout_id", F.col("items").alias("_given")), "holdout_id", "left")
    given = given if explicit is not None else given.withColumn("_given", F.lit(None).cast(dict(vault.dtypes)["items"]))
    rows = given.join(vault.select("holdout_id", F.col("items").alias("_kept")), "holdout_id", "left")
    source = F.when(F.col("_given").isNotNull(), "given").when(F.col("_kept").isNotNull(), "vault").otherwise("none")
    return rows.select("holdout_id", F.coalesce("_given", "_kept").alias("items"), source.alias("source"))


def without_text(docs: DataFrame, synthesised: Column) -> DataFrame:
    """Documents to be synthesised ship neither text nor root, nor what an earlier run made of them."""
    return docs.withColumn("redacted", F.when(~synthesised, F.col("redacted"))).withColumn("root", F.when(~synthesised, F.col("root")))
