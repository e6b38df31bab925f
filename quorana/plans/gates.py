"""A registry of pass/fail gates. A gate returns its evidence as data; one that raises has failed."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Gate = Callable[[], DataFrame]

SCHEMA = "gate string, status string, n_violations long, evidence string"


def violations(found: DataFrame, *shown: str, limit: int = 20) -> DataFrame:
    """(n_violations, evidence): how many rows break a rule, and the first ``limit`` of them in order."""
    count = found.agg(F.count("*").alias("n_violations"))
    top = found.select(F.to_json(F.struct(*shown)).alias("_e")).orderBy("_e").limit(limit)
    said = top.agg(F.array_join(F.array_sort(F.collect_list("_e")), "; ").alias("evidence"))
    return count.join(F.broadcast(said))  # one row each


def report(spark: SparkSession, gates: Mapping[str, Gate]) -> DataFrame:
    """One row per gate. Each is evaluated by itself, so that one that fails to run does not hide the others."""
    rows = []
    for name, gate in gates.items():
        try:
            r = gate().select("n_violations", "evidence").first()
            rows.append((name, "PASS" if not r.n_violations else "FAIL", r.n_violations, r.evidence or ""))
        except Exception as error:  # noqa: BLE001  a gate that cannot be decided has failed
            rows.append((name, "FAIL", None, f"raised {type(error).__name__}"))
    return spark.createDataFrame(rows, SCHEMA)
