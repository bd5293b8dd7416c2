import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetfold.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


PIECES = ["a", "b.c", "@", "@x", ".de", "-", "+", "1", "23", "255", "256", ".", "..", " ", "(", ")", "4111111111111111", "5500 0055-5555 5559", "+1 (499) 555-6503", "1.2.3.4", "é", "\n", "%", "００"]


@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
@settings(max_examples=1500, deadline=None)
def test_rules_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == brute(text)
    assert pii.suspicious(text) or not brute(text)


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + "(" * 300_000, "1 " * 150_000, "a@" * 100_000, "ab." * 100_000 + "@"):
        pii.base_spans(text)
        pii.candidates(text)
    many = "(499) 555-6503, 1.2.3.4, " * 20_000
    assert len(pii.examples(many, 1)) == pii.EACH
    assert len(pii.chosen([(0.9, s) for s in pii.candidates(many)], pii.base_spans(many))) == 20_000


def test_other_forms_are_proposed():
    text = "mail jo.doe (at) mail.example[dot]org or jo at mail dot example dot org, 10[.]1[.]2[.]3, 2001:db8:0:1::5:6:7, 4111.1111.1111.1111, (499) 555-6503"
    got = {(k, text[a:b]) for k, a, b in pii.candidates(text)}
    assert {("email", "jo.doe (at) mail.example[dot]org"), ("email", "jo at mail dot example dot org"), ("ip", "10[.]1[.]2[.]3"), ("card", "4111.1111.1111.1111"), ("phone", "(499) 555-6503")} <= got


def test_calibration_is_a_probability():
    rng = np.random.default_rng(0)
    odds = rng.normal(size=5000) * 3
    y = (rng.random(5000) < 1 / (1 + np.exp(-(0.5 * odds - 1)))).astype(int)
    a, b, least = pii.calibrate(odds, y)
    assert abs(a - 0.5) < 0.06 and abs(b + 1) < 0.1
    p = 1 / (1 + np.exp(-(a * odds + b)))
    assert least > 1 or y[p >= least].mean() >= pii.PRECISION
    assert pii.calibrate(odds, np.ones(5000, int))[2] > 1 and pii.calibrate(np.zeros(0), np.zeros(0, int))[2] > 1


def test_overlapping_proposals_give_the_most_probable():
    scored = [(0.9, ("card", 0, 10)), (0.95, ("phone", 5, 20)), (0.8, ("phone", 20, 30)), (0.99, ("ip", 40, 50))]
    assert [s for _, s in pii.chosen(scored, [("email", 45, 60)])] == [("phone", 5, 20), ("phone", 20, 30)]


def filler(rng, n):
    return " ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(n))


def card(rng):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def person(rng):
    kind = rng.choice(pii.KINDS)
    value = {
        "email": lambda: f"{filler(rng, 1)}.{rng.randint(10, 99)}@mail{rng.randint(0, 9)}.example.com",
        "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        "card": lambda: card(rng),
        "phone": lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
    }[kind]()
    return kind, value


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(3)
    rows = [(i, f"{filler(rng, 8)} {person(rng)[1]} {filler(rng, 8)}. Version {rng.randint(1, 9)}.{rng.randint(0, 9)} of {rng.randint(1900, 2030)}.") for i in range(500)]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)


def test_model_finds_forms_the_rules_miss_and_leaves_others(people):
    rng = random.Random(9)
    model = pii.train(people)
    hits = misses = wrong = 0
    for _ in range(150):
        kind, value = person(rng)
        for other, right in pii._rewrites(kind, value, rng):
            text = f"{filler(rng, 6)} {other} {filler(rng, 6)}"
            got = [s for s, p in pii.spans_of([text], model)[0] if p is not None]
            there = any(text[a:b] == other for _, a, b in got)
            hits, misses, wrong = hits + (right and there), misses + (right and not there), wrong + (not right and there)
    assert hits > 5 * misses and wrong < 0.03 * hits, (hits, misses, wrong)
    clean = [f"{filler(rng, 30)} in {rng.randint(1900, 2030)}, {rng.randint(10, 99)}.{rng.randint(10, 99)} or {rng.randint(1, 9)}.{rng.randint(0, 9)}" for _ in range(200)]
    assert all(s == [] for s in pii.spans_of(clean, model))


def test_digests_equal_a_plain_loop(spark, people):
    model = pii.train(people)
    odd = [(None, None), (None, "x 1.2.3.4"), (5, ""), (5, "a@b.cd a@b.cd"), (5, "a@b.cd a@b.cd"), (6, " \n"), (7, "call (499) 555-6503 now, " * 2000)]
    docs = people.unionByName(spark.createDataFrame(odd, people.schema)).withColumns({"spans": F.lit("x"), "kind": F.lit(1)})
    got = sorted(map(tuple, pii.digests(docs).collect()), key=str)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert pii.train(docs.filter("doc_id >= 0").select("doc_id", "text").limit(0)) is None
    refit = pii.train(docs)
    want = []
    for doc_id, text in texts:
        base = brute(text or "")
        spans = [s for s, _ in pii.spans_of([text], refit)[0]]
        assert set(base) <= set(spans)
        counts = [sum(s[0] == k for s in base) for k in pii.KINDS]
        join = lambda rows: ",".join(f"{k}:{a}:{b}" for k, a, b in rows)
        want.append((doc_id, *counts, hashlib.sha256(join(base).encode()).hexdigest(), join(spans)))
    assert got == sorted(want, key=str)
    assert pii.digests(docs.limit(0)).count() == 0 and model is not None


def test_without_anything_to_learn_rules_decide(spark):
    docs = spark.createDataFrame([(1, "no data here 12", "k"), (2, "a@b.cd", "k")], "doc_id BIGINT, text STRING, spans STRING")
    rows = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert rows[1].text == "no data here 12" and rows[2].text == "[email]" and rows[1].spans == "k"
