"""Schemas, sketches, package checks and combined detectors against known answers."""

import random

import pytest
from pyspark.sql import functions as F

from quorana.functions import text as X
from quorana.functions.schema import Schema, schema_errors
from quorana.operators import conformance as C
from quorana.operators import package as P
from quorana.operators import residual


def test_schema_keywords():
    schema = Schema({"type": "object", "required": ["a"], "properties": {"a": {"type": ["integer", "null"], "exclusiveMinimum": 0}, "b": {"type": "array", "uniqueItems": True, "maxItems": 2, "items": {"anyOf": [{"type": "string", "minLength": 2}, {"const": 1}]}}, "c": {"oneOf": [{"type": "number"}, {"type": "integer"}]}, "d": {"not": {"type": "string"}}}, "additionalProperties": {"type": "boolean"}})
    of = lambda v: list(schema.errors(v))
    assert of({"a": 1, "b": ["xy", 1], "c": 1.5, "d": 1, "e": True}) == []
    assert of([]) == ["/: type"] and of({}) == ["/: required a"]
    assert of({"a": 0, "b": ["x", "x", 1], "c": 1, "d": "s", "e": 3}) == ["/a: exclusiveMinimum", "/b: uniqueItems", "/b: maxItems", "/b/0: anyOf", "/b/1: anyOf", "/c: oneOf", "/d: not", "/e: type"]
    assert of({"a": True}) == ["/a: type"] and of({"a": None}) == []
    with pytest.raises(ValueError):
        Schema({"properties": {"a": {"contains": {}}}})


def test_schema_of_texts(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "{"), (3, None), (4, "[1]")], "i int, t string")
    got = {r.i: r.e for r in df.select("i", schema_errors(F.col("t"), {"type": "object"}).alias("e")).collect()}
    assert got == {1: [], 2: ["/: json"], 3: None, 4: ["/: type"]}


def test_sketches_estimate_jaccard(spark):
    rng = random.Random(1)
    rows = []
    for k in range(40):
        both = [f"s{k}-{i}" for i in range(rng.randint(0, 60))]
        a, b = both + [f"a{i}" for i in range(rng.randint(0, 40))], both + [f"b{i}" for i in range(rng.randint(1, 40))]
        rows.append((k, a, b, len(both) / len(set(a) | set(b))))
    df = spark.createDataFrame(rows, "k int, a array<string>, b array<string>, exact double")
    got = df.withColumn("m", X.minhash("a")).withColumn("n", X.minhash("b")).select("exact", X.sketch_similarity(F.col("m"), F.col("n")).alias("e"), F.size("m").alias("size")).collect()
    errors = [abs(r.e - r.exact) for r in got]
    assert all(r.size == 64 for r in got) and max(errors) < 0.3 and sum(errors) / len(errors) < 0.06


def test_combined_and_fixed_detectors():
    own = residual.Combined(residual.Detector(), residual.Fixed([(0, 4, "CLIENT"), (3, 9, "PERSON"), (50, 60, "PERSON")]))
    assert [(a, b, c) for a, b, c, _ in own.spans("Acme paid x@y.com")] == [(0, 4, "CLIENT"), (10, 17, "EMAIL")]
    assert residual.Fixed([(0, 1, "PERSON")]).spans("") == []


def test_rebuilding_finds_gaps_and_other_texts(spark):
    seg = "array<struct<idx: int, start: int, end: int, kind: string, class: string, token: string, commit: string>>"
    row = lambda i, red, segs: (i, "REDACT", red, "?", segs)
    good = [(0, 0, 4, "KEEP", None, None, None), (1, 4, 9, "REDACT", "PERSON", "⟦PERSON:x⟧", "00" * 32), (2, 9, 12, "KEEP", None, None, None)]
    gap = [good[0], (1, 5, 9, *good[1][3:]), good[2]]
    df = spark.createDataFrame([row("a", "see ⟦PERSON:x⟧ ok", good), row("b", "see ⟦PERSON:y⟧ ok", good), row("c", "see ⟦PERSON:x⟧ ok", gap), row("d", "see", good)], f"doc_id string, mode string, redacted string, root string, segs {seg}")
    got = {}
    for r in P.check_roots(df, ["PERSON"]).collect():
        got.setdefault(r.subject, set()).add(r.problem)
    assert got == {"a": {"root"}, "b": {"root", "text"}, "c": {"root", "cover"}, "d": {"root", "text"}}


def test_text_findings_by_rule(spark):
    texts = ["mail ann@x.example to ⟦COUNTERPARTY:ab⟧ and Hamburg now", "ISIN DE0001234567 is listed", "we told Meier that DE0001234567 is listed", "⟦PERSON:John Smith⟧ wrote", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: {(f.rule, f.severity, f.what) for f in r.f} for r in df.select("i", P.text_findings(F.col("t"), residual.Detector()).alias("f")).collect()}
    assert ("R2", "CRITICAL", "EMAIL") in got[0] and ("R4", "MEDIUM", "COUNTERPARTY") in got[0]
    assert ("R2", "MEDIUM", "ISIN") in got[1] and ("R2", "CRITICAL", "ISIN") in got[2]
    assert not any(rule == "R1" for rule, *_ in got[3]) and got[4] == set()


def test_quasi_tuples(spark):
    df = spark.createDataFrame([("Rates swap at Alpha for ⟦AMOUNT:1k-10k⟧ on ⟦DATE:2024-05-01⟧",), ("swap for USD 5,000",), ("nothing",)], "t string")
    got = [tuple(r.q) for r in df.select(P.quasi_tuple(F.col("t"), ["swap", "rates swap"], ["Alpha"]).alias("q")).collect()]
    assert got == [("rates swap", "1k-10k", "2024-05", "Alpha"), ("swap", "1k-10k", None, None), (None, None, None, None)]


def test_manifest_holds_its_digests(spark):
    files = spark.createDataFrame([("b", "x", "text/plain", 3, "0" * 64), ("a", "y", "text/plain", 4, "1" * 64)], "path string, role string, media_type string, size long, sha256 string")
    own = C.manifest(files, {"tag": "v1"})
    assert C.manifest_problems(own.select(F.lit("m").alias("name"), "document")).count() == 0
    assert own.first().document.index('"path":"a"') < own.first().document.index('"path":"b"')
