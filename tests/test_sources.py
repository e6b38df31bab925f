"""Readers, writers and streams on small files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quorana.functions import codes
from quorana.operators import catalogue
from quorana.sources import readers, sinks
from quorana.streaming import ledger as streams


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_run_records_are_ordered_by_sample_number(spark, tmp_path):
    for model, sample in (("alpha", "10"), ("alpha", "2"), ("beta", "x")):
        put(f"{tmp_path}/{model}/{sample}.json", json.dumps({"model_id": model, "response_raw": '{"divisions": [], "rejected": [{"name": "n"}]}', "usage": {"input_tokens": 3}}, indent=1))
    rows = readers.run_records(spark, str(tmp_path)).orderBy("model_dir", "sample_order").collect()
    assert [(r.model_dir, r.sample) for r in rows] == [("alpha", "2"), ("alpha", "10"), ("beta", "x")] and rows[0].usage.input_tokens == 3
    parsed = readers.run_records(spark, str(tmp_path)).select(F.from_json("response_raw", readers.RESPONSE_SCHEMA).alias("r")).select("r.rejected").first()
    assert parsed.rejected[0].name == "n"


def test_ledger_csv_checks_its_header(spark, tmp_path):
    put(f"{tmp_path}/l.csv", ",".join(readers.LEDGER_COLUMNS) + '\nd,A1,"text, with ""quotes""",u,me,,VERIFIED,,\n')
    assert readers.ledger_csv(spark, f"{tmp_path}/l.csv").first().anchor_text == 'text, with "quotes"'
    put(f"{tmp_path}/bad.csv", "a,b,c,d,e,f,g,h,i\n1,2,3,4,5,6,7,8,9\n")
    with pytest.raises(Exception, match="(?i)header|name"):
        readers.ledger_csv(spark, f"{tmp_path}/bad.csv").collect()


def test_text_corpus_joins_origins_with_defaults(spark, tmp_path):
    put(f"{tmp_path}/a.txt", "é one")
    put(f"{tmp_path}/b.txt", "two\n")
    origins = spark.createDataFrame([("a.txt", "BANK", "2024", "2025", "mail")], "name string, institution_code string, period_start string, period_end string, channel string")
    got = {r.name: r for r in readers.text_corpus(spark, str(tmp_path), origins).collect()}
    assert got["a.txt"].text == "é one" and got["a.txt"].institution_code == "BANK" and got["b.txt"].institution_code == "UNKNOWN"


def test_lists_lines_and_taxonomies(spark, tmp_path):
    put(f"{tmp_path}/g/clients.txt", "# comment\n Acme \n\nBeta\nBeta\n")
    assert sorted(r.term for r in readers.term_lists(spark, f"{tmp_path}/g").collect()) == ["Acme", "Beta"]
    put(f"{tmp_path}/x.jsonl", '{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, f"{tmp_path}/x.jsonl", "a int").collect()) == [1, 2]
    put(f"{tmp_path}/m.csv", "division_key,tier\nrates,STRONG\nrates,WEAK\n")
    with pytest.raises(ValueError):
        readers.taxonomy_csv(spark, f"{tmp_path}/m.csv")
    assert readers.yaml_rows(spark, "models:\n- {provider: p, vendor: v}\n", "provider string, vendor string", "models").first().vendor == "v"
    with pytest.raises(ValueError):
        readers.aliases(spark, [{"canon": "a", "key": "x"}, {"canon": "a", "key": "y"}])


def test_pinned_files_and_bundles(spark, tmp_path):
    put(f"{tmp_path}/r/a/x.json", "{}")
    put(f"{tmp_path}/r/y.txt", "text")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/r").select(F.regexp_replace("path", ".*/r/", "").alias("path"), "content")
    manifest = catalogue.described(files)
    assert {(r.path, r.size, r.media_type) for r in manifest.collect()} == {("a/x.json", 2, "application/json"), ("y.txt", 4, "text/plain")}
    assert readers.pinned_files(spark, f"{tmp_path}/r", manifest).count() == 2
    lines = sinks.bundle_manifest(files)
    assert sinks.bundle_problems(lines, files).count() == 0
    assert [r.problem for r in sinks.bundle_problems(lines, files.where("path = 'y.txt'")).collect()] == ["missing"]
    forged = files.withColumn("content", F.when(F.col("path") == "y.txt", F.lit(b"tExt")).otherwise(F.col("content")))
    assert [tuple(r) for r in catalogue.release_problems(manifest, forged).collect()] == [("y.txt", "digest")]


def test_sealed_files(spark):
    key = F.lit(bytes(range(32)))
    df = spark.createDataFrame([("v/1.bin", "secret")], "path string, t string").select("path", F.concat(F.lit(b"LATV1"), codes.sealed(F.col("t"), key, F.col("path"))).alias("content"))
    assert bytes(readers.sealed_files(df, key).first().value) == b"secret"


def test_responses_and_chunks(spark):
    jobs, files = spark.createDataFrame([(1,), (2,)], "job int"), spark.createDataFrame([(1, "```json\n{}\n```")], "job int, raw string")
    assert readers.responses_for(jobs.where("job = 1"), files, "job", "raw").first().raw == "{}"
    with pytest.raises(Exception, match="no response for 2"):
        readers.responses_for(jobs, files, "job", "raw").collect()
    chunks = spark.createDataFrame([("m", 2, "lo"), ("m", 1, "hel")], "k string, i int, t string")
    assert readers.reassembled(chunks, ["k"], "i", "t").first().t == "hello"


def test_documents_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(2, "b"), (1, "é")], "i int, s string")
    assert sinks.json_document(df, ["i"]) == sinks.json_document(df.repartition(5), ["i"]) and "é" in sinks.json_document(df, ["i"])
    with pytest.raises(ValueError):
        sinks.json_document(df, ["i"], rows=1)
    assert sinks.report_sections(df.withColumn("sec", F.lit("s")), "sec", "i", F.col("s")).first().body == "- é\n- b"


def test_appends_only_what_is_new(spark, tmp_path):
    path = f"{tmp_path}/chain"
    sinks.parquet(spark.createDataFrame([(1, "a")], "k int, v string"), path)
    sinks.append_chain(spark.read.parquet(path), spark.createDataFrame([(1, "x"), (2, "b")], "k int, v string"), ["k"], path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b")]


def test_streams(spark, tmp_path):
    rows = [(f"k{i % 2}", i, f"2024-01-01 00:{i:02d}:00") for i in range(20)] + [("k0", 3, "2024-01-01 00:03:00")]
    spark.createDataFrame(rows, "k string, i int, t string").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("k string, i int, t timestamp").parquet(f"{tmp_path}/in")
    got = streams.run_once(streams.windowed(stream(), "t", ["k"], "i", "10 minutes"), "complete", f"{tmp_path}/c1").collect()
    assert sum(r.n for r in got) == 21 and len(got) == 4
    once = streams.run_once(streams.deduplicated(stream(), "t", "i"), "append", f"{tmp_path}/c2")
    assert once.count() == 20
    assert streams.run_once(streams.sessions(stream(), "t", "k", "5 minutes"), "complete", f"{tmp_path}/c3").count() == 2
    line = stream().dropDuplicates(["i"]).withColumn("h", F.sha2(F.col("i").cast("string"), 256)).withColumn("told", F.when(F.col("i") < 2, "0" * 64).when(F.col("i") == 7, "bad").otherwise(F.sha2((F.col("i") - 2).cast("string"), 256)))
    checked = streams.run_once(streams.chain_state(line, "k", "i", "h", "told"), "append", f"{tmp_path}/c4")
    assert [r.i for r in checked.where("NOT ok").collect()] == [7]
