"""Known answers for ledgers, chains, lineage, detection, roll-ups and similarity."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quorana.functions import codes, values
from quorana.functions import text as X
from quorana.operators import catalogue, chain, ledger, lineage, overlay, residual, similarity
from quorana.operators import validate as V
from quorana.plans import gates


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize(("name", "want"), [
    ("The Équities & Derivatives Trading Desk", "equity derivatif trading"), ("Boxes, Classes and Policies", "box class policy"), ("FX Ops", "fx ops"), ("Heroes of the Analysis", "hero analysis"), ("", ""),
])
def test_canon_name(spark, name, want):
    assert one(spark, X.canon_name(F.col("x")), name) == want


def test_slug_and_directory(spark):
    assert one(spark, X.slug_key(F.col("x")), "rates  trading!") == "rates_trading" and one(spark, X.slug_key(F.col("x")), "--") == "unnamed"
    assert one(spark, X.safe_dirname(F.col("x")), "a/b c.json") == "a_b_c.json"


def test_shingles(spark):
    assert one(spark, X.word_shingles(F.col("x")), "One two, three FOUR") == ["one two three", "two three four"]
    assert one(spark, X.word_shingles(F.col("x")), "only two") == ["only two"] and one(spark, X.word_shingles(F.col("x")), None) == []


def test_marks_round_trip(spark):
    tag = 0xDEADBEEF
    text = one(spark, F.concat(F.col("x"), F.lit(X.MARK_SUFFIX), X.encode_tag(F.lit(tag)), F.lit(X.MARK_END)), "words")
    assert [(r.tag, r.method) for r in one(spark, X.carriers(F.col("x")), text)] == [("deadbeef", "PSEUD_SUFFIX")]
    assert one(spark, X.strip_marks(F.col("x")), text) == "words" and one(spark, X.has_marks(F.col("x")), text)
    escaped = json.dumps(text)[1:-1]
    assert one(spark, F.size(X.carriers(F.col("x"))), escaped) == 1


def test_recipients_are_told_apart(spark):
    tags = [catalogue.mark_tag(b"salt", "p", r) for r in ("one", "two")]
    df = spark.createDataFrame([(f"a{i}", f"some words of {i} ⟦PERSON:x⟧ text") for i in range(4)], "atom_id string, text string")
    marked = df.withColumn("text", catalogue.marked(F.col("text"), F.col("atom_id"), b"salt", tags[0]))
    assert [(r.tag, r.n_carriers, r.n_methods, r.winner) for r in catalogue.detected(marked, "text", "atom_id").collect()] == [(f"{tags[0]:08x}", 8, 2, True)]
    assert marked.select(X.strip_marks(F.col("text"))).collect() == df.select("text").collect() and tags[0] != tags[1]


def lp(*xs):
    return b"".join(len(x).to_bytes(4, "big") + x for x in xs)


def sha(b):
    return hashlib.sha256(b).digest()


def test_hashes_equal_an_independent_version(spark):
    leaf = sha(lp(b"KEEP", b"doc", (3).to_bytes(8, "big"), (10).to_bytes(8, "big"), (12).to_bytes(8, "big"), b"\xc3\xa9"))
    assert bytes(one(spark, codes.keep_leaf(F.lit("doc"), F.lit(3), F.lit(10), F.lit(12), F.col("x")), "é")) == leaf
    leaves = [sha(bytes([i])) for i in range(5)]

    def root(level):
        while len(level) > 1:
            level = level + level[-1:] if len(level) % 2 else level
            level = [sha(lp(b"NODE", a, b)) for a, b in zip(level[::2], level[1::2])]
        return level[0]

    assert bytes(one(spark, codes.merkle_root_of(F.col("x")), leaves, "array<binary>")) == root(leaves)
    assert bytes(one(spark, codes.merkle_root_of(F.col("x")), leaves[:1], "array<binary>")) == leaves[0]
    assert bytes(one(spark, codes.merkle_root_of(F.col("x")), [], "array<binary>")) == sha(lp(b"NODE", b"", b""))
    table = spark.createDataFrame([("k", i, x) for i, x in enumerate(leaves)] + [("one", 0, leaves[2])], "k string, p int, h binary")
    assert {r.k: bytes(r.root) for r in codes.merkle_roots(table, ["k"], "p", "h").collect()} == {"k": root(leaves), "one": leaves[2]}


def test_canonical_json_and_self_hash(spark):
    assert one(spark, codes.canonical_json(F.col("x")), '{"b": 1.50, "a": ["é", null]}') == '{"a":["é",null],"b":1.5}'
    assert one(spark, codes.canonical_json(F.col("x")), "NaN {") is None
    body = {"a": 1, "row_sha256": "x"}
    assert one(spark, codes.self_hash(F.col("x"), "row_sha256"), json.dumps(body)) == hashlib.sha256(b'{"a":1}').hexdigest()
    assert one(spark, codes.reference_id(F.lit("task"), F.lit("d"), F.col("x")), "book é") == "task:d:" + hashlib.sha256('["task","d","book é"]'.encode()).hexdigest()[:24]


def test_secrets_stay_out_of_plans(spark):
    key = b"very secret key"
    df = spark.createDataFrame([("ann",)], "x string").select(codes.pseudonym(key, F.lit("PERSON"), F.col("x")).alias("p"), codes.hmac_sha256(key, F.col("x")).alias("m"))
    plan = df._jdf.queryExecution().toString()
    assert "secret" not in plan and len(df.first().p) == 10


@pytest.mark.parametrize(("said", "want"), [("3rd March 2024", "2024-03-03"), ("2024-02-30", None), ("13/02/2024", "2024-02-13"), ("02/13/2024", "2024-02-13"), ("Sept 5, 2023", "2023-09-05"), ("5.6.2020", "2020-06-05"), ("May 7 2021", "2021-05-07"), ("x", None)])
def test_dates(spark, said, want):
    assert one(spark, values.parse_date(F.col("x")).cast("string"), said) == want


@pytest.mark.parametrize(("said", "want"), [("USD 1,250.50", "1k-10k"), ("3.5mm EUR", "1m-10m"), ("£2bn", ">100m"), ("900", "<1k"), ("none", "unparsed"), ("12 k", "10k-100k")])
def test_amounts(spark, said, want):
    assert one(spark, values.band(values.parse_amount(F.col("x"))), said) == want


@pytest.mark.parametrize(("kind", "text", "ok"), [
    ("EMAIL", "a.b@c.example", True), ("EMAIL", "a.b@c", False), ("TRADE_ID", "TRD-2024-00017", True), ("ACCOUNT_ID", "ACC-12345", True), ("LEGAL_ENTITY", "Émile Bank AG", False), ("LEGAL_ENTITY", "Acme Bank Ltd", True),
    ("PERSON", "Ann Example", True), ("PERSON", "ann", False), ("INTERNAL_SYSTEM", "OPS-1", True), ("LOCATION", "Paris", True), ("FREE_TEXT_QUOTE", '"so it is"', True), ("DATE", "2024-01-05", True), ("EMAIL", " ", False), ("NONE", "x", False),
])
def test_class_predicates(spark, kind, text, ok):
    assert one(spark, values.is_of_class(kind, F.col("x")), text) is ok


def test_detector_resolves_overlaps():
    d = residual.Detector({"COUNTERPARTY": ["Acme Bank"], "LOCATION": ["York", "New York"]}, allowed=["Blue Sky"])
    got = [(t, c) for a, b, c, _ in d.spans("Acme Bank Ltd wrote to ann@x.example on 3 May 2024 in New York. Kind Regards, Jane Doe; Blue Sky") for t in ["Acme Bank Ltd wrote to ann@x.example on 3 May 2024 in New York. Kind Regards, Jane Doe; Blue Sky"[a:b]]]
    assert got == [("Acme Bank", "COUNTERPARTY"), ("ann@x.example", "EMAIL"), ("3 May 2024", "DATE"), ("New York", "LOCATION"), ("Jane Doe", "PERSON")]


def test_segments_cover_and_rebuild(spark):
    df = spark.createDataFrame([("d", "é call 😀 Ann now", [(2, 6, "VERB", "<v>"), (9, 12, "PERSON", "<p>")])], "id string, t string, s array<struct<start: int, end: int, class: string, token: string>>")
    got = df.withColumn("g", lineage.segments(F.col("t"), F.col("s"))).select("*", lineage.redacted(F.col("t"), F.col("g")).alias("r")).first()
    assert got.r == "é <v> 😀 <p> now" and [x.kind for x in got.g] == ["KEEP", "REDACT", "KEEP", "REDACT", "KEEP"]
    assert [x.start for x in got.g][1:] == [x.end for x in got.g][:-1] and got.g[-1].end == len("é call 😀 Ann now".encode())


def test_admission_and_order(spark):
    df = spark.createDataFrame([(2, 3, 100.0, 300.0, 0.5), (1, 2, 1.0, 1.0, 0.1)], "a int, t int, lo double, hi double, f double")
    got = V.admission(df, F.col("a"), V.recomputed(F.col("lo"), F.col("hi"), F.col("f")), F.col("t"), 100.0).collect()
    assert got[0].admitted and got[0].reasons == [] and got[1].reasons == ["R_ANCHORS_LT2", "R_SEAT_BELOW_THRESHOLD", "R_TERMINALITY_LT3"]
    raw = '```json\n{"divisions": [{"a1": [], "name": "x"}, {"name": "y", "a1": null}]}\n```'
    assert one(spark, V.key_before(F.col("x"), "divisions", "a1", "name"), raw) is False
    assert one(spark, V.key_before(F.col("x"), "divisions", "a1", "name"), raw.replace('"name": "y", "a1": null', '"a1": null, "name": "y"')) is True
    assert one(spark, V.key_before(F.col("x"), "divisions", "a1", "name"), '{"divisions": []}') is False
    assert one(spark, V.mismatch(F.lit(0.0), F.lit(0.0))) is False and one(spark, V.mismatch(F.lit(105.0), F.lit(100.0))) is False and one(spark, V.mismatch(F.lit(105.1), F.lit(100.0))) is True


def test_ledger_takes_the_worst_and_fills_what_is_missing(spark):
    keys = ["k", "t", "x"]
    claims = spark.createDataFrame([("d", "A1", "1"), ("d", "A2", "2"), ("d", "A4", "s"), ("e", "A1", "1")], "k string, t string, x string")
    rows = spark.createDataFrame([("d", "A1", "1", "VERIFIED"), ("d", "A1", "1", "PARTIAL"), ("d", "A2", "2", "VERIFIED"), ("d", "A4", "s", "VERIFIED")], "k string, t string, x string, status string")
    checked = ledger.worst_status(claims, rows, keys)
    assert {(r.k, r.t): r.status for r in checked.collect()} == {("d", "A1"): "PARTIAL", ("d", "A2"): "VERIFIED", ("d", "A4"): "VERIFIED", ("e", "A1"): "MISSING"}
    assert ledger.extended(rows, claims, keys).count() == 5
    s = {r.k: r for r in ledger.summary(checked, "k", "t").collect()}
    assert not s["d"].rejected_post and s["d"].verified_types == 1 and not s["d"].publishable and s["e"].rejected_post


def test_chain_breaks_where_a_line_changes(spark):
    df = spark.createDataFrame([("k", i, f"line {i}") for i in range(5)], "k string, p int, t string")
    told = chain.chained(df, ["k"], "p", "t").withColumnRenamed("prev_hash", "told").drop("line_hash")
    assert chain.broken_links(told, ["k"], "p", "t", "told").count() == 0
    forged = told.withColumn("t", F.when(F.col("p") == 2, "other").otherwise(F.col("t")))
    assert [r.p for r in chain.broken_links(forged, ["k"], "p", "t", "told").collect()] == [3]


def test_ancestors_and_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x")], "id string, up string")
    got = {(r.child, r.ancestor): r.cycle for r in chain.ancestors(df, "id", "up", 8).collect()}
    assert got[("a", "c")] is False and got[("x", "x")] is True and ("c", "a") not in got
    chained = spark.createDataFrame([(i, i + 1) for i in range(100)], "id long, up long")
    assert chain.ancestors(chained, "id", "up").where("child = 0").count() == 100
    assert chain.ancestors(chained, "id", "up", 8).where("child = 0").count() == 8


def test_supersession_and_appends(spark):
    df = spark.createDataFrame([("a", None, 0), ("b", "a", 1), ("c", "z", 2), ("d", "e", 3), ("e", None, 4)], "h string, r string, p int")
    assert sorted(r.h for r in chain.current(df, "h", "r").collect()) == ["b", "c", "d"]
    assert sorted(r.h for r in chain.dangling(df, "h", "r", "p").collect()) == ["c", "d"]
    assert chain.appended(df.select("h"), spark.createDataFrame([("a",), ("n",), ("n",)], "h string"), ["h"]).count() == 6


def test_similarity_and_clusters(spark):
    texts = spark.createDataFrame([(1, "one two three four five"), (2, ""), (3, None)], "i int, t string")
    items = spark.createDataFrame([(7, "one two three four five six"), (8, "")], "j int, u string")
    assert [tuple(r) for r in similarity.near_duplicates(texts, items, "i", "j", "t", "u", at_least=0.5).collect()] == [(1, 7, 0.75)]
    labels = spark.createDataFrame([("d", x, x.split()) for x in ("book trade", "trade book fast", "settle cash", "x")], "g string, l string, w array<string>")
    got = {r.l: (r.representative, r.size) for r in similarity.clusters(labels, "g", "l", "w").collect()}
    assert got == {"book trade": ("book trade", 2), "trade book fast": ("book trade", 2), "settle cash": ("settle cash", 1), "x": ("x", 1)}
    machine = similarity.clusters(labels, "g", "l", "w")
    ruled = {r.l: (r.representative, r.basis) for r in similarity.ruled(machine, spark.createDataFrame([("d", "x", "settle cash")], "g string, l string, representative string"), "g", "l").collect()}
    assert ruled["x"] == ("settle cash", "argued_merge") and ruled["book trade"] == ("book trade", "standalone_under_review")


def test_rollup_depth_and_verdicts(spark):
    rows = spark.createDataFrame([("a", "r1", 2), ("a", "r2", 0), ("a", "r3", 3)], "k string, id string, w int")
    got = {r.k: r for r in overlay.rollup(spark.createDataFrame([("a",), ("b",)], "k string"), rows, "k", "w", "id").collect()}
    assert (got["a"].saturation, got["a"].row_ids, got["a"].void) == (5, ["r1", "r3"], False) and got["b"].void and got["b"].saturation == 0
    points = spark.createDataFrame([("e", "task_concept", "PROPOSED"), ("e", "division", "RATIFIED_MAPPING")], "e string, d string, s string")
    assert overlay.deepest(points, "e", "d", "s", overlay.PAINTING, "x").first().x == "division"
    sheet = lambda case, who, verdicts, promo: [(case, who, f, v, promo) for f, v in zip("pq", verdicts)]
    sheets = sheet(1, "A", ["PASS", "NOT_APPLICABLE"], "PASS") + sheet(1, "B", ["PASS", "PASS"], "PASS") + sheet(2, "A", ["PASS", "FAIL"], "PASS") + sheet(2, "B", ["PASS", "PASS"], "PASS") + sheet(3, "A", ["PASS", "PASS"], "PASS") + sheet(4, "A", ["FAIL", "FAIL"], "FAIL") + sheet(4, "B", ["FAIL", "FAIL"], "FAIL")
    df = spark.createDataFrame(sheets, "case int, assessor string, family string, verdict string, promotion string")
    assert {r.case: r.verdict for r in overlay.judged(df, "case", ["p", "q"], ("A", "B")).collect()} == {1: "PASS", 2: "UNCERTAIN", 3: "FAIL", 4: "FAIL"}


def test_gates_that_crash_fail(spark):
    bad = spark.createDataFrame([(1,), (2,)], "x int")
    got = {r.gate: r for r in gates.report(spark, {"ok": lambda: gates.violations(bad.where("x > 5"), "x"), "bad": lambda: gates.violations(bad, "x"), "crash": lambda: gates.violations(bad.select("nope"), "nope")}).collect()}
    assert (got["ok"].status, got["bad"].status, got["crash"].status) == ("PASS", "FAIL", "FAIL")
    assert got["bad"].evidence == '{"x":1}; {"x":2}' and got["crash"].n_violations is None


def test_k_anonymity_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None, "x")] * 3 + [(1, 2, "x")] * 6 + [(None, None, "z")], "a int, b int, c string")
    assert [tuple(r) for r in residual.k_anonymity(df, ["a", "b", "c"]).collect()] == [(1, None, "x", 3)]


def test_forbidden_words(spark):
    count = lambda token, text: spark.createDataFrame([(text, token)], "t string, k string").select(X.contains_word(F.col("t"), F.col("k")).alias("n")).first().n
    assert count("private bench", "Private-Bench, the private  bench; privatebench") == 2
    assert count("a.b", "a.b axb a.bc") == 1 and count("c (d)", "c (d) c d") == 1 and count("the", "the other The") == 2
    assert one(spark, X.phrases(F.col("x"), 2), "B a, b") == ["b", "a", "b a", "a b"]


def test_sealed_values_open_only_where_they_belong(spark):
    key = F.lit(bytes(32))
    df = spark.createDataFrame([("v", "a.bin")], "x string, p string").select("p", codes.sealed(F.col("x"), key, F.col("p")).alias("s"))
    assert bytes(df.select(codes.opened(F.col("s"), key, F.col("p")).alias("o")).first().o) == b"v"
    assert df.select(codes.opened(F.col("s"), key, F.lit("b.bin")).alias("o")).first().o is None


def test_files_outside_a_package(spark):
    rows = [("a/vault.json", b"{}"), ("b.txt", b"f" * 64), ("c.txt", b"0" * 64), ("d.txt", b"plain"), ("e.bin", b"LATV1..."), ("k.txt", b"e" * 64), ("f.json", b'{"a": [{"nonce": 1}]}'), ("g.json", b'{"a":'), ("h.jsonl", b'{"a": 1}\n\n{"original": 2}'), ("i.bin", bytes(range(256)) * 4), ("j.txt", bytes(range(32)) * 40), ("l.png", b"\x89PNG"), ("m", b"\xff")]
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "n string, c binary")
    got = {r.n: r.s for r in df.select("n", residual.suspicious(F.col("n"), F.col("c"), F.array(F.lit("e" * 64))).alias("s")).collect()}
    assert got == {"a/vault.json": ["name"], "b.txt": ["unknown digest"], "c.txt": [], "d.txt": [], "e.bin": ["magic"], "k.txt": [], "f.json": ["key nonce"], "g.json": ["no JSON"], "h.jsonl": ["key original"], "i.bin": ["entropy", "no UTF-8"], "j.txt": [], "l.png": ["magic", "no UTF-8"], "m": ["no UTF-8"]}


def test_overlapping_terms_and_spans_that_stay():
    detector = residual.Detector({"CLIENT": ["Acme", "Acme Corp", "Corp North"], "INTERNAL_SYSTEM": ["North"]})
    assert [(a, b, c) for a, b, c, _ in detector.spans("see acme corp north.")] == [(4, 8, "CLIENT"), (9, 19, "CLIENT")]
    assert [(a, b) for a, b, *_ in residual._Terms(["Acme", "Acme Corp", "Corp North"]).spans("acme corp north acmes")] == [(0, 9), (0, 4), (5, 15)]
    rng = random.Random(1)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 6), "X", rng.randint(1, 3)) for a in (rng.randint(0, 25) for _ in range(rng.randint(0, 12)))]
        stay = []
        for s in sorted(spans, key=lambda s: (-s[3], s[0] - s[1], s[0])):
            if all(s[1] <= t[0] or s[0] >= t[1] for t in stay):
                stay.append(s)
        assert residual.resolved(spans) == sorted(stay)


def test_token_near_a_name(spark):
    near = lambda t: one(spark, residual.near_proper_noun(F.col("x"), "⟦COUNTERPARTY:[^⟧]*⟧"), t)
    assert near("we paid ⟦COUNTERPARTY:ab⟧ through Hamburg today") == "Hamburg" and near("we paid ⟦COUNTERPARTY:ab⟧ today") is None
    assert near("⟦COUNTERPARTY:ab⟧ " + "x" * 60 + " by Hamburg") is None


def test_greedy_spans_in_the_jvm(spark):
    spans = [(50, 3, 0, 3, "a"), (90, 2, 2, 4, "b"), (50, 5, 4, 9, "c"), (50, 5, 3, 8, "d")]
    got = one(spark, residual.greedy(F.col("x")), spans, "array<struct<rank: int, length: int, start: int, end: int, class: string>>")
    assert sorted(s["class"] for s in got) == ["b", "c"]


def test_tokens_and_lists(spark):
    from quorana.operators import redaction

    df = spark.createDataFrame([("DATE", "3 May 2024"), ("DATE", "soon"), ("AMOUNT_EXACT", "EUR 5k"), ("PERSON", "Ann")], "k string, o string")
    got = [r.t for r in df.select(redaction.make_token(F.col("k"), F.col("o"), F.lit("ID"), F.lit(-2)).alias("t")).collect()]
    assert got == ["⟦DATE:2024-05-01⟧", "⟦DATE:ID⟧", "⟦AMOUNT:1k-10k⟧", "⟦PERSON:ID⟧"]
    lists = spark.createDataFrame([("CLIENT", "Acme  Bank"), ("COUNTERPARTY", "ACME bank."), ("ALLOW", "Blue")], "list string, term string")
    terms = spark.createDataFrame([("(Acme Bank)",), ("blue",), ("none",)], "t string")
    assert {r.t: (r["class"], r.allowed) for r in redaction.listed_class(terms, lists, "t").collect()} == {"(Acme Bank)": ("COUNTERPARTY", False), "blue": (None, True), "none": (None, False)}
    assert [one(spark, redaction.safe_path(F.col("x")), p) for p in ("a/b.json", "../a", "/a", "a/..", "a\\b", "C:/x", "", "a..b")] == [True, False, False, False, False, False, False, True]
