"""Where responses come from: a registry of providers by name. Recorded ones are replayed; live ones need a network that is not there."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[DataFrame, DataFrame], DataFrame]


def jobs(panel: DataFrame) -> DataFrame:
    """(provider, model_id, vendor, sample_idx): what a panel (provider, model_id, vendor, samples) asks for."""
    return panel.select("provider", "model_id", "vendor", F.explode(F.when(F.col("samples") > 0, F.sequence(F.lit(0), (F.col("samples") - 1).cast("int")))).alias("sample_idx"))


def replayed(panel: DataFrame, records: DataFrame) -> DataFrame:
    """A run record per job from recorded responses (model_id, sample_idx, response_raw); a job without one is an ERROR.

    The vendor is the panel's, else the record's, else the provider's name.
    """
    told = records.select("model_id", "sample_idx", "response_raw", F.col("vendor").alias("_vendor"))
    got = jobs(panel).join(told, ["model_id", "sample_idx"], "left")
    status = F.when(F.col("response_raw").isNull(), "ERROR").otherwise("OK")
    return got.select("model_id", F.coalesce("vendor", "_vendor", "provider").alias("vendor"), "provider", "sample_idx", status.alias("status"), "response_raw", F.sha2("response_raw", 256).alias("response_sha256"))


def _offline(panel: DataFrame, records: DataFrame) -> DataFrame:
    raise RuntimeError("a live provider needs a network; replay its records instead")


#: Providers by the name that a panel gives them.
PROVIDERS: Mapping[str, Provider] = {"fixture": replayed, "recorded": replayed, "live": _offline}


def provider(spec: Mapping[str, str]) -> Provider:
    """The provider that a configuration names; an unknown one is an error."""
    name = spec.get("provider", "")
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(PROVIDERS)}")
    return PROVIDERS[name]


def discovered(records: DataFrame) -> DataFrame:
    """(model_id, vendor, samples): the models that stand in recorded responses, as a panel would ask for them."""
    return records.groupBy("model_id").agg(F.min("vendor").alias("vendor"), (F.max("sample_idx") + 1).alias("samples"))


#: The only anchor there is: a local record, which proves nothing to others.
LOCAL_ANCHOR = "local-record"


def anchored(digest: Column, at: Column) -> Column:
    """A local proof record that binds a digest to a time."""
    return F.struct(F.lit(LOCAL_ANCHOR).alias("provider"), digest.alias("digest"), at.alias("stamped_utc"), F.lit("LOCAL_ONLY").alias("status"))


def anchor_problems(proofs: DataFrame) -> DataFrame:
    """Proofs (name, digest, proof) of an unknown provider or of another digest; no proof is none."""
    problem = F.when(F.col("proof.provider") != LOCAL_ANCHOR, "provider").when(~F.col("proof.digest").eqNullSafe(F.col("digest")), "digest")
    return proofs.where("proof IS NOT NULL").select(F.lit("anchor").alias("gate"), F.col("name").alias("subject"), problem.alias("problem")).where("problem IS NOT NULL")
