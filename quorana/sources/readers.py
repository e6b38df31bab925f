"""Scans: run records, ledgers, JSON lines, text corpora, term lists, configuration, sealed files, streams of chunks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorana.functions.codes import opened
from quorana.functions.text import nfc

RUN_SCHEMA = (
    "model_id STRING, vendor STRING, response_raw STRING, response_sha256 STRING, ts_utc STRING, status STRING, invalid_reasons ARRAY<STRING>, repair_pass BOOLEAN, error STRING, "
    "usage STRUCT<input_tokens: BIGINT, output_tokens: BIGINT>, params STRUCT<temperature: DOUBLE, top_p: DOUBLE, max_tokens: INT, seed: INT>, note STRING"
)
RESPONSE_SCHEMA = (
    "divisions ARRAY<STRUCT<a1_regulatory: ARRAY<STRUCT<regime: STRING, jurisdiction: STRING, citation: STRING>>, a2_segment: ARRAY<STRUCT<bank: STRING, filing: STRING, fiscal_year: INT, line_item: STRING>>, "
    "a3_market_size: ARRAY<STRUCT<publisher: STRING, series: STRING, value: DOUBLE, unit: STRING, as_of: STRING>>, a4_seat: STRUCT<`function`: STRING, headcount_range: ARRAY<INT>, cost_per_seat: ARRAY<DOUBLE>, cost_source: STRING, "
    "determinable_fraction: DOUBLE, relational_fraction: DOUBLE, addressable_seat_cost: DOUBLE, terminality: ARRAY<STRUCT<task: STRING, input_records: STRING, terminal_state: STRING, evidence_record: STRING>>>, "
    "name: STRING, axis: STRUCT<business_line: STRING, side: STRING, region: ARRAY<STRING>, product: ARRAY<STRING>, office: STRING>, confidence: DOUBLE>>, "
    "rejected ARRAY<STRUCT<name: STRING, reason_codes: ARRAY<STRING>, note: STRING>>"
)
LEDGER_COLUMNS = ("division_key", "anchor_type", "anchor_text", "source_url_or_doc", "checked_by", "checked_ts", "status", "verified_value", "note")
ORIGIN_DEFAULTS = {"institution_code": "UNKNOWN", "period_start": "", "period_end": "", "channel": "unknown"}


def run_records(spark: SparkSession, root: str, schema: str = RUN_SCHEMA) -> DataFrame:
    """Run records of <root>/<model>/<sample>.json with model_dir, sample and their scan order; samples that are no number come last."""
    path = F.col("_metadata.file_path")
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{root.rstrip('/')}/*/*.json")
    stem = F.regexp_extract(path, r"([^/]+)\.json$", 1)
    return rows.select("*", F.regexp_extract(path, r"([^/]+)/[^/]+\.json$", 1).alias("model_dir"), stem.alias("sample"), F.coalesce(F.expr("try_cast(regexp_extract(_metadata.file_path, '([^/]+)\\\\.json$', 1) AS INT)"), F.lit(1_000_000_000)).alias("sample_order"))


def ledger_csv(spark: SparkSession, path: str, columns: Sequence[str] = LEDGER_COLUMNS) -> DataFrame:
    """A ledger; all columns are text, and another header than the expected one fails."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, quote='"', escape='"', multiLine=True, mode="FAILFAST")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON file, with its name; numbers that are not finite are refused."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value"), F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"))
    return rows.select("file", F.from_json("value", schema, {"mode": "FAILFAST", "allowNonNumericNumbers": "false"}).alias("x")).select("file", "x.*")


def text_corpus(spark: SparkSession, root: str, origins: DataFrame | None = None) -> DataFrame:
    """(doc_id, name, text, origin columns) of <root>/*.txt, in NFC; documents that ``origins`` (name, ...) lacks get defaults."""
    docs = spark.read.text(f"{root.rstrip('/')}/*.txt", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("name"), nfc(F.col("value")).alias("text"))
    docs = docs.withColumn("doc_id", F.sha2("text", 256))
    if origins is None:
        return docs.select("doc_id", "name", "text", *[F.lit(v).alias(k) for k, v in ORIGIN_DEFAULTS.items()])
    return docs.join(origins, "name", "left").select("doc_id", "name", "text", *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in ORIGIN_DEFAULTS.items()])


def term_lists(spark: SparkSession, root: str) -> DataFrame:
    """(list, term) of <root>/*.txt: one term per line, blank lines and # comments skipped."""
    rows = spark.read.text(f"{root.rstrip('/')}/*.txt").select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.txt$", 1).alias("list"), F.trim("value").alias("term"), "value")
    return rows.where((F.col("term") != "") & ~F.col("value").startswith("#")).select("list", "term").distinct()


def taxonomy_csv(spark: SparkSession, path: str, key: str = "division_key") -> DataFrame:
    """A matrix file: a header, unique keys of [a-z0-9_]; anything else fails."""
    rows = spark.read.csv(path, header=True, mode="FAILFAST")
    bad = rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | ~F.coalesce(F.col(key).rlike("^[a-z0-9_]+$"), F.lit(False)))
    if bad.take(1):
        raise ValueError(f"{path}: keys that repeat or are malformed")
    return rows


def yaml_rows(spark: SparkSession, text: str, schema: str, member: str | None = None) -> DataFrame:
    """A small configuration document as rows; PyYAML is needed for anything but JSON."""
    try:
        import yaml

        value = yaml.safe_load(text)
    except ImportError:
        value = json.loads(text)
    rows = value[member] if member else value
    return spark.createDataFrame(rows if isinstance(rows, list) else [rows], schema)


def aliases(spark: SparkSession, rows: Sequence[Mapping[str, str]]) -> DataFrame:
    """(canon, key, rationale) of an alias list; a canon with two keys, or a key that is malformed, fails."""
    seen: dict[str, str] = {}
    for r in rows:
        if seen.setdefault(r["canon"], r["key"]) != r["key"] or not r["key"].replace("_", "").isalnum():
            raise ValueError(f"bad alias {r['canon']!r} -> {r['key']!r}")
    return spark.createDataFrame([(r["canon"], r["key"], r.get("rationale", "")) for r in rows], "canon string, key string, rationale string").dropDuplicates(["canon"])


def identity_aliases(canons: DataFrame, canon: str, key: Column) -> DataFrame:
    """A draft alias table: every distinct name stands for its own slug."""
    return canons.select(F.col(canon).alias("canon")).distinct().withColumn("key", key).withColumn("auto_generated", F.lit(True))


def pinned_files(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """(path, content) of the files that a manifest (path, size, sha256) pins and whose bytes are those it names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    rows = files.select(F.regexp_replace("path", rf"^.*?{prefix}/", "").alias("path"), "content", "length")
    told = manifest.select("path", F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    return rows.join(told, "path").where((F.col("length") == F.col("_size")) & (F.sha2("content", 256) == F.col("_sha"))).select("path", "content")


def sealed_files(files: DataFrame, key: Column, magic: int = 5) -> DataFrame:
    """(path, value) of sealed files (path, content): a magic of some bytes, then vector and ciphertext, bound to the path."""
    body = F.substring("content", F.lit(magic + 1), F.octet_length("content") - magic)
    return files.select("path", opened(body, key, F.col("path")).alias("value"))


def reassembled(chunks: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """Texts put together from streamed pieces by their order."""
    return chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_p")).select(*keys, F.array_join(F.transform("_p", lambda p: p[text]), "").alias(text))


def responses_for(jobs: DataFrame, files: DataFrame, key: str, raw: str) -> DataFrame:
    """Jobs with their responses, fences taken off; a job without one fails the scan."""
    from quorana.operators.validate import unfenced

    joined = jobs.join(files, key, "left")
    return joined.withColumn(raw, F.when(F.col(raw).isNull(), F.raise_error(F.concat(F.lit("no response for "), F.col(key).cast("string")))).otherwise(unfenced(F.col(raw))))


def vendor_of(panel: DataFrame, runs: DataFrame) -> DataFrame:
    """(provider, vendor): the panel's, else that of the first run, else the provider itself."""
    first = runs.groupBy("provider").agg(F.min_by("vendor", "sample").alias("_first"))
    return panel.join(first, "provider", "left").select("provider", F.coalesce("vendor", "_first", "provider").alias("vendor"))
