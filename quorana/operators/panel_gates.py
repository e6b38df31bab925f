"""The gates of a panel run. Each gives the rows that break it, as (gate, subject, problem); no row is a pass.

Gates recompute from the records and compare with what was stored, so that an edited table is found out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorana.functions.text import contains_word, phrases, without_allowed
from quorana.operators import ledger

SAMPLE = ("model_id", "sample_idx")
#: Samples and vendors that a panel needs, the call parameters that a record must show, how far an admission may be off.
LEAST_SAMPLES, LEAST_VENDORS, PARAMETERS, EXACT = 3, 4, ("temperature", "top_p", "max_tokens", "seed"), 1e-6


def _broken(rows: DataFrame, gate: str, subject: Column, problem: Column | str) -> DataFrame:
    told = F.lit(problem) if isinstance(problem, str) else problem
    return rows.select(F.lit(gate).alias("gate"), subject.cast("string").alias("subject"), told.alias("problem"))


def _sample() -> Column:
    return F.concat_ws("/", F.col("model_id"), F.col("sample_idx").cast("string"))


def _marked(samples: DataFrame, stored: DataFrame, reason: str | None) -> DataFrame:
    """The samples with ``marked``: whether the record or the stored table says that they are invalid, for ``reason`` if one is given."""
    told = stored.select(*SAMPLE, F.col("sample_status").alias("_told"), F.col("reasons").alias("_why"))
    by_record = F.col("status").isin("INVALID", "ERROR") if reason in (None, "SCHEMA_INVALID", "PARSE_ERROR") else F.lit(False)
    by_table = (F.col("_told") == "INVALID") & (F.lit(True) if reason is None else F.array_contains("_why", reason))
    return samples.join(told, list(SAMPLE), "left").withColumn("marked", F.coalesce(by_record, F.lit(False)) | F.coalesce(by_table, F.lit(False))).drop("_told", "_why")


def contamination(runs: DataFrame, prompts: DataFrame, tokens: Sequence[str], hashed: DataFrame, allowed: Sequence[str], published: str) -> DataFrame:
    """Prompt texts (name, text) with a denied word or a phrase whose digest is denied, and runs under another prompt than the published one."""
    plain = prompts.select("name", without_allowed(F.col("text"), allowed).alias("text"))
    open_words = plain.select("name", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), contains_word(F.col("text"), F.lit(t)).alias("n")) for t in tokens])).alias("x")).where("x.n > 0")
    secret = plain.select("name", F.explode(phrases(F.col("text"))).alias("p")).withColumn("digest", F.sha2("p", 256)).join(hashed, "digest", "left_semi")
    other = runs.where(~F.col("prompt_sha256").eqNullSafe(F.lit(published)))
    return (
        _broken(open_words, "A-G1", F.col("name"), F.concat(F.lit("token "), F.col("x.t"))).unionByName(_broken(secret.select("name", "digest").distinct(), "A-G1", F.col("name"), F.concat(F.lit("digest "), F.substr("digest", F.lit(1), F.lit(8)))))
        .unionByName(_broken(other, "A-G1", _sample(), "other prompt"))
    )


def schema(samples: DataFrame, stored: DataFrame) -> DataFrame:
    """Responses that do not have their digest, and those that break the schema unmarked."""
    rows = _marked(samples.where("status <> 'ERROR'"), stored, None)
    problem = F.when(F.array_contains("reasons", "SHA_MISMATCH"), "digest").when(~F.col("schema_ok") & ~F.col("marked"), "invalid and unmarked")
    return _broken(rows.withColumn("_p", problem).where("_p IS NOT NULL"), "A-G2", _sample(), F.col("_p"))


def order(samples: DataFrame, stored: DataFrame) -> DataFrame:
    """Responses that name a division before its anchors, unmarked."""
    rows = _marked(samples.where("status <> 'ERROR' AND schema_ok AND NOT ordered"), stored, "ORDER_VIOLATION")
    return _broken(rows.where("NOT marked"), "A-G3", _sample(), "order")


def rejection(samples: DataFrame, stored: DataFrame) -> DataFrame:
    """Responses that reject nothing, unmarked."""
    rows = samples.where("status <> 'ERROR' AND parses AND n_rejected < 1")
    for reason in ("REJECTED_EMPTY", "SCHEMA_INVALID"):
        rows = _marked(rows, stored, reason).where("NOT marked").drop("marked")
    return _broken(rows, "A-G4", _sample(), "nothing rejected")


def admission(divs: DataFrame, stored_samples: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored divisions of samples that are stored as VALID whose admission does not follow from the response, or that are not in it."""
    valid = stored_samples.where("sample_status = 'VALID'").select(*SAMPLE)
    told = stored.join(valid, list(SAMPLE), "left_semi").select(*SAMPLE, "index", F.col("admitted").alias("_admitted"), F.col("recomputed").alias("_recomputed"))
    both = told.join(divs.select(*SAMPLE, "index", "admitted", "recomputed"), [*SAMPLE, "index"], "full_outer").join(valid, list(SAMPLE), "left_semi")
    problem = (
        F.when(F.col("_admitted").isNull(), "not stored").when(F.col("admitted").isNull(), "not in the response").when(F.col("admitted") != F.col("_admitted"), "admission")
        .when(F.abs(F.col("recomputed") - F.col("_recomputed")) > EXACT, "value")
    )
    subject = F.concat_ws("/", F.col("model_id"), F.col("sample_idx").cast("string"), F.col("index").cast("string"))
    return _broken(both.withColumn("_p", problem).where("_p IS NOT NULL"), "A-G5", subject, F.col("_p"))


def corroboration(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """Ledger rows that break the ledger's rules, and divisions that are neither rejected nor fit to publish."""
    keys = ["division_key", "anchor_type", "anchor_text"]
    bad = _broken(ledger.problems(rows), "A-G6", F.col("anchor_text"), F.array_join("problems", ","))
    told = ledger.summary(ledger.worst_status(expected, rows, keys), "division_key", "anchor_type")
    return bad.unionByName(_broken(told.where("NOT rejected_post AND NOT publishable"), "A-G6", F.col("division_key"), F.format_string("%d types, %s, %d open", "verified_types", "last_status", "unverified_count")))


def aliases(table: DataFrame, keys: DataFrame, actual: Column, published: Column, used: Column) -> DataFrame:
    """An alias table that is not the published one or not the one that the matrix used, and keys that it lacks."""
    lacking = keys.select("division_key").distinct().join(table.select(F.col("key").alias("division_key")), "division_key", "left_anti")
    one = table.sparkSession.range(1).select(F.explode(F.array_compact(F.array(F.when(actual != published, "published"), F.when(actual != used, "matrix")))).alias("p"))
    return _broken(lacking, "A-G7", F.col("division_key"), "no alias").unionByName(_broken(one, "A-G7", F.lit("aliases"), F.concat(F.lit("digest of the "), F.col("p"))))


def self_assessment(samples: DataFrame, stored: DataFrame, prompts: DataFrame, patterns: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Prompts and unmarked responses that assess themselves."""
    plain = without_allowed(F.col("text"), allowed)
    asks = prompts.where(plain.rlike("|".join(f"(?:{p})" for p in patterns)))
    rows = _marked(samples.where("status <> 'ERROR' AND size(hits) > 0"), stored, "SELF_ASSESSMENT_LANGUAGE")
    return _broken(asks, "A-G8", F.col("name"), "asked for").unionByName(_broken(rows.where("NOT marked"), "A-G8", _sample(), "unmarked"))


def replay(again: DataFrame, stored: DataFrame) -> DataFrame:
    """Cells (key, rater, cell) that a second run of the whole pipeline does not give as they were stored."""
    told = stored.select("key", "rater", F.col("cell").alias("_told"))
    both = again.select("key", "rater", "cell").join(told, ["key", "rater"], "full_outer").where(~F.col("cell").eqNullSafe(F.col("_told")))
    problem = F.when(F.col("_told").isNull(), "not stored").when(F.col("cell").isNull(), "not reproduced").otherwise("differs")
    return _broken(both, "A-G9", F.concat_ws("/", "key", "rater"), problem)


def panel(runs: DataFrame, stored: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Too few vendors or samples with data, warm or undocumented calls, and exclusions without a reason or a model.

    ``runs`` has ``params`` (a map) and ``cold`` (struct of tools, browsing, retrieval, prior_turns, provider_cold_guarantee).
    """
    valid = stored.where("sample_status = 'VALID'").groupBy("model_id").agg(F.count("*").alias("valid"))
    models = runs.groupBy("model_id").agg(F.min("vendor").alias("vendor"), F.count("*").alias("k")).join(valid, "model_id", "left").withColumn("valid", F.coalesce("valid", F.lit(0)))
    counted = models.join(exclusions.select("model_id"), "model_id", "left_anti")
    vendors = counted.agg(F.countDistinct(F.when(F.col("valid") >= LEAST_SAMPLES, F.col("vendor"))).alias("n")).where(F.col("n") < LEAST_VENDORS)
    cold: Mapping[str, Column] = {c: F.col(f"cold.{c}").eqNullSafe(F.lit(v)) for c, v in (("tools", False), ("browsing", False), ("retrieval", False), ("prior_turns", 0), ("provider_cold_guarantee", True))}
    warm = runs.where(~(cold["tools"] & cold["browsing"] & cold["retrieval"] & cold["prior_turns"] & cold["provider_cold_guarantee"]))
    lacking = runs.select(*SAMPLE, F.explode(F.array_except(F.array(*[F.lit(p) for p in PARAMETERS]), F.map_keys("params"))).alias("p"))
    known = runs.select("model_id").distinct().withColumn("_known", F.lit(True))
    wrong = exclusions.join(known, "model_id", "left").where(F.col("_known").isNull() | (F.trim(F.coalesce("reason", F.lit(""))) == ""))
    parts = [
        _broken(vendors, "A-G10", F.lit("panel"), F.format_string("%d vendors", "n")), _broken(counted.where(F.col("k") < LEAST_SAMPLES), "A-G10", F.col("model_id"), "few samples"),
        _broken(counted.where(F.col("valid") < LEAST_SAMPLES), "A-G10", F.col("model_id"), "few valid samples"), _broken(warm, "A-G10", _sample(), "not cold"),
        _broken(lacking, "A-G10", _sample(), F.concat(F.lit("lacks "), F.col("p"))), _broken(wrong, "A-G10", F.col("model_id"), "exclusion"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
