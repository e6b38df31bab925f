"""Writers whose bytes do not depend on the run: sorted keys, fixed separators, explicit order."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorana.functions.codes import sealed
from quorana.operators.chain import appended

#: Rows up to which a table may become one driver-side document.
DOCUMENT_ROWS = 100_000


def json_document(df: DataFrame, order: Sequence[str], rows: int = DOCUMENT_ROWS) -> str:
    """A small table as pretty JSON with sorted keys; larger tables are refused and belong into Parquet."""
    got = df.orderBy(*order).limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError("too many rows for one document")
    return json.dumps([r.asDict(recursive=True) for r in got], sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """CSV in one order, split into files of that order."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True, lineSep="\n", quote='"', escape='"', emptyValue="")


def json_lines(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """JSON lines with members in alphabetical order."""
    df.select(*sorted(df.columns)).orderBy(*order).write.mode("overwrite").json(path, lineSep="\n")


def parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def append_chain(table: DataFrame, new: DataFrame, keys: Sequence[str], path: str) -> None:
    """Appends the rows whose keys the table lacks."""
    known = table.select(*table.columns)
    appended(known, new, keys).join(known, list(keys), "left_anti").write.mode("append").parquet(path)


def bundle_manifest(files: DataFrame) -> DataFrame:
    """Lines of a manifest: digest, two blanks, path, by path."""
    return files.select("path", F.concat_ws("  ", F.sha2("content", 256), F.col("path")).alias("line")).orderBy("path")


def bundle_problems(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): what a manifest names that is missing or different."""
    told = lines.select(F.split_part("line", F.lit("  "), F.lit(2)).alias("path"), F.split_part("line", F.lit("  "), F.lit(1)).alias("_told"))
    there = files.select("path", F.sha2("content", 256).alias("_is"))
    problem = F.when(F.col("_is").isNull(), "missing").when(F.col("_is") != F.col("_told"), "digest")
    return told.join(there, "path", "left").select("path", problem.alias("problem")).where("problem IS NOT NULL")


def vault(df: DataFrame, value: str, key: Column, bound_to: str) -> DataFrame:
    """The table with a column sealed under a random vector and bound to another column."""
    return df.withColumn(value, sealed(F.col(value), key, F.col(bound_to)))


def report_sections(df: DataFrame, section: str, order: str, line: Column) -> DataFrame:
    """(section, body): Markdown bullets of each section in order."""
    rows = df.select(F.col(section), F.struct(F.col(order), F.concat(F.lit("- "), line).alias("l")).alias("x"))
    return rows.groupBy(section).agg(F.array_sort(F.collect_list("x")).alias("_x")).select(section, F.array_join(F.transform("_x", lambda x: x["l"]), "\n").alias("body"))


def public_rows(df: DataFrame, column: str, prefixes: Sequence[str]) -> DataFrame:
    """The rows that a public projection may show."""
    allowed = F.lit(False)
    for p in prefixes:
        allowed = allowed | F.col(column).startswith(p)
    return df.where(F.coalesce(allowed, F.lit(False)))
