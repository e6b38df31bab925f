"""Personal data against a brute-force version of the patterns and of the corpus estimate."""

import hashlib
import math
import random
import re

import pytest

from quorana.llm import pii
from quorana.workdir import Scratch

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(s):
    s = s or ""
    only = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end(), "email", m[0].lower()) for m in EMAIL.finditer(s)]
    found += [(m.start(), 1, m.end(), "ip", m[0]) for m in IP.finditer(s) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end(), "card", only(m)) for m in CARD.finditer(s) if 12 <= len(only(m)) <= 19 and luhn(only(m))]
    found += [(m.start(), 3, m.end(), "phone", only(m)) for m in PHONE.finditer(s) if 9 <= len(only(m)) <= 15]
    return sorted(found)


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in spans)


def fuzz(rng):
    bits = ["a@b.c", "x@y", "@", ".", "_d@e.f", "a@b@c.d", "+", "+1 (415) 555-0134", "+4 ", "1.2.3.4", "300.1.1.1", "001.002.003.255", "10.0.0.1", "0.00.0.256", "000.0.255.00", "1.2.3.4.5.6.7.8", "4539 1488 0343 6467", "4539148803436467", "1-2-3-4-5-6-7-8-9-0-1-2", " - ", "7", " ", "é", "日", "😀", "\n", "-", "(", ")", "%", "word"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))


TEXTS = [None, "", "plain words only", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "x" * 50_000 + "@" + "y" * 1000, "a@" + "b.c" * 3000, "9" * 20_000, "+" + "1 " * 5000, "4111 1111 1111 1111 4111-1111-1111-1111"]


def test_patterns_equal_brute_force(spark):
    rng = random.Random(5)
    texts = TEXTS + [fuzz(rng) for _ in range(600)]
    rows = {r.doc_id: r for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        got = [x for x in rows[i].spans.split(",") if x and not x.startswith(("removed", "generalised"))]
        assert got == [x for x in joined(want).split(",") if x], repr(t)[:200]
        assert rows[i].base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[3] == k for x in want) for k in pii.KINDS[:4]]


def corpus():
    person = [f"Zorblax met mail me ann@corp.example now item{k}" for k in range(4)]
    return person + ["Zorblax alone", "met now me"] + [f"met me now words number {k}" for k in range(40)] + person[:1] * 3


def group(kind, value):
    return {"email": value[value.find("@") :] if "@" in value else "", "ip": ".".join(value.split(".")[:2]), "card": value[:6], "phone": value[:4]}[kind]


def brute_disclosure(texts):
    """{text: {term: degree}} by counting everything for every unit and term."""
    n, distinct = len(texts), sorted({t for t in texts if t})
    told = lambda t: {x for w in re.findall(r"[^\x20\x09-\x0D]+", t) if len(x := re.sub(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "", w.lower())) >= 3}
    entities = {t: {(k, v) for *_, k, v in brute(t)} for t in distinct}
    groups = {t: {(k, group(k, v), "*") for k, v in e} | {(k, "*") for k, _ in e} for t, e in entities.items()}
    terms = {t: told(t) for t in distinct}
    holders = lambda unit: [t for t in distinct if unit in entities[t] or unit in groups[t]]
    out = {}
    for t in distinct:
        for k, v in entities[t]:
            unit = next((u for u in ((k, v), (k, group(k, v), "*")) if len(holders(u)) >= pii.SUPPORT), (k, "*"))
            mine = holders(unit)
            n_e = sum(texts.count(x) for x in mine)
            if len(mine) < pii.SUPPORT or n_e >= n:
                continue
            for term in terms[t]:
                both = [x for x in mine if term in terms[x]]
                if len(both) >= pii.SUPPORT:
                    n_te, n_t = sum(map(texts.count, both)), sum(term in terms.get(x, ()) for x in texts)
                    degree = math.log(n * n_te / (n_t * n_e)) / math.log(n / n_e)
                    if degree >= pii.GENERALISE_AT:
                        out.setdefault(t, {})[term] = max(degree, out.get(t, {}).get(term, 0))
    return out


def mixed_corpus(seed):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(60)]
    people = [("ann@corp.example", ["zorblax", "quendle"]), ("bob@corp.example", ["vintry"]), ("10.2.2.3", ["rackhouse"]), ("10.3.9.9", []), ("+49 170 5550134", ["teltow"])]
    people += [(f"x{k}@corp.example", ["corpish"]) for k in range(20)] + [(f"10.1.7.{k}", ["subnetty"]) for k in range(20)] + [(f"lone{k}@d{k}.example", ["never"]) for k in range(3)]
    texts = []
    for _ in range(160):
        text = [rng.choice(words) for _ in range(rng.randint(3, 12))]
        for who, tell in rng.sample(people, rng.choice([0, 0, 0, 1, 1, 2])):
            text.insert(rng.randint(0, len(text)), who)
            text += [x for x in tell if rng.random() < 0.9]
        texts.append(" ".join(text))
    return texts + texts[:5] + [None, ""] + [" ".join(x for p in people for x in (p[0], *p[1]))]


@pytest.mark.parametrize(("seed", "block"), [(0, 64), (1, 64), (2, 2)])
def test_disclosure_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(pii, "BLOCK", block)
    texts = mixed_corpus(seed) if seed else corpus()
    want = {hashlib.md5(t.encode()).hexdigest(): d for t, d in brute_disclosure(texts).items()}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.text_key: {t.term: t.degree for t in r.terms} for r in pii.disclosure(df).collect()}
    assert want and got.keys() == want.keys()
    for k, terms in got.items():
        assert terms == pytest.approx(want[k])
    if seed:
        assert any("corpish" in d or "subnetty" in d for d in want.values())  # by the group alone


def test_sanitised_text_and_clean_documents(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(corpus())] + [(None, None, 2)], "doc_id long, text string, spans int")
    rows = {r.doc_id: r for r in pii.sanitised(df).collect()}
    assert rows[0].sanitised == "[name] met  me [email] now item0"
    assert rows[5].sanitised == "met now me" and rows[None].sanitised is None and rows[0].spans == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(empty).count() == 0


def test_terms_that_stand_elsewhere_are_not_kept_for_pairs(spark, monkeypatch):
    """A term with too few of its rows beside entities meets none, however rare it is; nothing telling is lost."""
    written, write = {}, Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: (table := write(self, df, name), written.setdefault(name, table.count()))[0])
    texts = [f"zorblax ann{k}@corp.example common{k % 8}" for k in range(40)] + [f"common{k % 8} other{k}" for k in range(320)]
    want = {hashlib.md5(t.encode()).hexdigest(): d for t, d in brute_disclosure(texts).items()}
    got = {r.text_key: {t.term: t.degree for t in r.terms} for r in pii.disclosure(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert len(want) == 40 and got == {k: pytest.approx(d) for k, d in want.items()}
    assert written["worded"] == 40
