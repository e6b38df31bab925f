"""The registered queries and gates from a shell.

python -m quorana list | run QUERY SF_DIR OUT | sql QUERY | gate SF_DIR [GATE ...] | manifest FOLDER OUT TAG COMMIT
"""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import functions as F

from quorana.operators import catalogue, conformance
from quorana.plans import named_gates, registry
from quorana.session import local_session
from quorana.sources import sinks


def main() -> None:
    parser = argparse.ArgumentParser(prog="quorana", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list")
    verbs.add_parser("sql").add_argument("query")
    run = verbs.add_parser("run")
    for name in ("query", "sf_dir", "out"):
        run.add_argument(name)
    gate = verbs.add_parser("gate")
    gate.add_argument("sf_dir")
    gate.add_argument("gates", nargs="*", choices=[*named_gates.GATES, []], help="all of them if none is named")
    manifest = verbs.add_parser("manifest")
    for name in ("folder", "out", "tag", "commit"):
        manifest.add_argument(name)
    for verb in (run, gate, manifest):
        verb.add_argument("--cores", default="*")
    told = parser.parse_args()
    if told.verb == "list":
        print("\n".join(sorted(registry.queries())))
        return
    if told.verb == "sql":
        print(registry.oracle_sql().get(told.query, "-- none"))
        return
    spark = local_session(told.cores)
    if told.verb == "run":
        registry.queries()[told.query](spark, told.sf_dir).write.mode("overwrite").parquet(told.out)
    elif told.verb == "gate":
        rows = named_gates.report(spark, told.sf_dir, told.gates or tuple(named_gates.GATES)).collect()
        for r in rows:
            print(f"{r.gate:6} {r.status} {r.n_violations if r.n_violations is not None else '-'} {r.evidence[:160]}")
        spark.stop()
        sys.exit(any(r.status != "PASS" for r in rows))
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(told.folder)
        root = told.folder.rstrip("/") + "/"
        found = catalogue.described(files.select(F.split_part("path", F.lit(root), F.lit(-1)).alias("path"), "content")).withColumn("role", F.lit("artifact"))
        release = {"tag": told.tag, "commit_sha": told.commit, "generated_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")}
        sinks.parquet(conformance.manifest(found, release), told.out)
    spark.stop()


if __name__ == "__main__":
    main()
