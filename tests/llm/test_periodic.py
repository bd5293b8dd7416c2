import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetfold.llm import periodic


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i - q] for i in range(q, len(words))))


def brute(words, fewest=6, times=4):
    """Every maximal stretch of every period, kept if that is its smallest."""
    out, n = set(), len(words)
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - first >= max(fewest, times * q) and smallest_period(words[first:i]) == q:
                out.add((first, i - first, q))
    return sorted(out)


@given(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abc"), max_size=40))
@settings(max_examples=400, deadline=None)
def test_runs_equal_brute_force(words):
    assert periodic.runs(periodic.numbered(words)) == brute(words)
    assert periodic.runs(periodic.numbered(words), 2, 2) == brute(words, 2, 2)


@pytest.mark.parametrize("seed", range(60))
def test_planted_repeats_equal_brute_force(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < 150:
        root = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
        words += (root * rng.randint(1, 7))[: rng.randint(1, 50)]
        words += [rng.choice("abcxyz") for _ in range(rng.randint(0, 4))]
    assert periodic.runs(periodic.numbered(words)) == brute(words)


def test_stretches_rule_out_plain_text():
    assert periodic.stretches(list(range(1000))) == []
    low, high = periodic.stretches([*range(100), 7, 8, 7, 8, 7, 8, 7, 8, 7, 8, *range(200, 300)])[0]
    assert low <= 100 and high == 110


def test_a_long_run_is_quick():
    ids = list(range(5_000)) * 6
    assert periodic.runs(ids) == [(0, 30_000, 5_000)]
    assert periodic.runs([1] * 50_000) == [(0, 50_000, 1)]


def test_collapsed_keeps_the_first_period():
    words = "x a b a b a b a b y y y y y y z".split()
    found = periodic.runs(periodic.numbered(words))
    assert found == [(1, 8, 2), (9, 6, 1)]
    assert periodic.collapsed(words, found) == "x a b y z".split()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return doc_id, len(found), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept)


def test_summaries_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab ab c  d e f g".split(" ")) for _ in range(rng.randint(0, 120))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (5, ""), (5, " \n\t"), (7, "ha " * 40), (7, "ha " * 40), (None, "na " * 9), (9, "é\x0bé\ré é é é é")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id BIGINT, text STRING, lang STRING, period STRING, start BIGINT")
    got = [tuple(r) for r in periodic.summaries(docs, periodic.planted).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r))
    assert sorted(got, key=key) == sorted((expected(*r) for r in rows), key=key)
    assert sum(r[1] > 0 and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in got if r[0] is not None) > 2
    assert periodic.summaries(docs.limit(0)).count() == 0


def test_runs_and_reduced_texts(spark):
    docs = spark.createDataFrame([(1, "a  b\nc", 0), (2, "k " * 8 + "end", 0), (3, None, 0)], "doc_id BIGINT, text STRING, length BIGINT")
    assert [tuple(r) for r in periodic.runs_of(docs).collect()] == [(2, 0, 8, 1)]
    assert {r.doc_id: r.text for r in periodic.without_runs(docs).collect()} == {1: "a  b\nc", 2: "k end", 3: None}
