"""All queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quorana.plans import conformance_queries, consensus_queries, context_queries, ledger_queries, named_gates, observatory_queries, package_queries, redaction_queries, run_queries, text_queries

MODULES = (consensus_queries, ledger_queries, text_queries, context_queries, redaction_queries, run_queries, package_queries, conformance_queries, observatory_queries, named_gates)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query(spark, sf_dir)."""
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> SQL that DuckDB runs over the same tables."""
    return {k: q for m in MODULES for k, q in m.SQL.items()}
