"""All gates and checks by their names, each a query whose rows are what breaks it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorana.plans import conformance_queries, gates, package_queries, run_queries
from quorana.tables import read

#: The names of the gates of a panel run (A), of a package (B), of its buyer (V) and examiner (E), and of released tables (S).
GATES = {
    "A-G1": "gate_contamination", "A-G2": "gate_schema", "A-G3": "gate_order", "A-G4": "gate_rejection", "A-G5": "gate_admission", "A-G6": "gate_corroboration", "A-G7": "gate_aliases", "A-G8": "gate_self_assessment", "A-G9": "gate_replay", "A-G10": "gate_panel",
    "B-G1": "gate_leakage", "B-G2": "gate_canary", "B-G3": "gate_manifest", "B-G4": "gate_floor", "B-G6": "check_files", "B-G7": "gate_mode", "B-G8": "gate_determinism", "B-G9": "gate_holdout",
    "V1": "check_manifest", "V2": "check_roots", "V4": "check_ratios", "V5": "check_marks", "V6": "check_holdout", "V7": "check_files", "E4": "check_pseudonyms", "E5": "check_originals", "E7": "check_origin", "R3": "rare_tuples",
    "S3": "gate_cells", "S3-G3": "gate_deny", "S3-G4": "gate_numbering", "S4": "gate_mappings", "S4-G5": "gate_release_manifest", "S5": "gate_lifecycle", "S7": "gate_run_ledger", "S8": "gate_concepts",
}
_MODULES = (run_queries, package_queries, conformance_queries)
#: What the query reports on: gates that are quick, whose report shows all statuses.
REPORTED = ("B-G2", "B-G4", "B-G7", "B-G9", "V4", "E7", "S3-G4", "S5", "S7", "S8")


def _found(name: str):
    return next(m.QUERIES[GATES[name]] for m in _MODULES if GATES[name] in m.QUERIES)


def report(spark: SparkSession, sf: str, names: Sequence[str] = tuple(GATES)) -> DataFrame:
    """One row per gate: status, how many rows break it, and the first of them."""
    return gates.report(spark, {n: lambda n=n: gates.violations(_found(n)(spark, sf), "subject", "problem") for n in names})


def gate_report(spark: SparkSession, sf: str) -> DataFrame:
    """Named gates, one that nothing breaks, and one that cannot be decided."""
    found = report(spark, sf, REPORTED)
    more = gates.report(spark, {
        "no order below nothing": lambda: gates.violations(read(spark, sf, "orders").where("o_totalprice < 0").select("o_orderkey"), "o_orderkey"),
        "crash": lambda: gates.violations(read(spark, sf, "no_such_table"), "x"),
    })
    return found.unionByName(more).select("gate", "status", "n_violations", F.when(F.col("gate") == "S3-G4", F.col("evidence")).alias("evidence"))


QUERIES = {"gate_report": gate_report}
_SQL = {n: next(m.SQL[GATES[n]] for m in _MODULES if GATES[n] in m.SQL) for n in REPORTED}
_EVIDENCE = """(SELECT string_agg('{"subject":"' || subject || '","problem":"' || problem || '"}', '; ' ORDER BY '{"subject":"' || subject || '","problem":"' || problem || '"}') FROM (""" + _SQL["S3-G4"] + "))"
SQL = {
    "gate_report": " UNION ALL ".join(
        f"SELECT '{n}' AS gate, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS n_violations, {_EVIDENCE if n == 'S3-G4' else 'NULL'} AS evidence FROM ({q})" for n, q in _SQL.items()
    ) + " UNION ALL SELECT 'no order below nothing', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*), NULL FROM orders WHERE o_totalprice < 0 UNION ALL SELECT 'crash', 'FAIL', NULL, NULL",
}
