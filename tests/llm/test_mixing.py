"""Pareto sampling with an inclusion probability of each document's own, against a plain loop."""

import hashlib
import math
import random

import pytest

from fleetfold.llm import mixing
from tests.llm.test_small import brute_targets


def level_of(sizes, target, most=2):
    """The level at which min(most, level * size) copies of each document give the target on average, by bisection."""
    low, high = 0.0, most / min(sizes)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(most, middle * s) * s for s in sizes) < target else (low, middle)
    return high


def brute(rows, seed=1):
    """rows: (doc_id, text, source) -> copies of each, in order."""
    sizes = [len(t.split()) if t else 0 for _, t, _ in rows]
    per = {s: sum(n for n, r in zip(sizes, rows) if r[2] == s) for s in {r[2] for r in rows}}
    targets = brute_targets(per)
    copies = [0] * len(rows)
    for source in per:
        own = [i for i, r in enumerate(rows) if r[2] == source and sizes[i]]
        if not own:
            continue
        level = level_of([sizes[i] for i in own], targets[source])
        ranked = []
        for i in own:
            m = min(2.0, level * sizes[i])
            copies[i] = math.floor(m + 1e-9)
            digest = hashlib.md5(f"{seed}/{'' if rows[i][0] is None else rows[i][0]}/{rows[i][1] or ''}".encode()).hexdigest()
            u, p = (int(digest[:13], 16) + 0.5) / 2**52, m - copies[i]
            if p > 1e-9:
                ranked.append(((u / (1 - u)) / (p / (1 - p)), digest, i))
        left = targets[source] - sum(copies[i] * sizes[i] for i in own)
        for _, _, i in sorted(ranked):
            if sizes[i] / 2 > left:
                break
            left -= sizes[i]
            copies[i] += 1
    return copies


def corpus(seed, n=200):
    rng = random.Random(seed)
    return [(i, f"t{i} " + "w " * int(rng.paretovariate(1.1) * 5), rng.choice(["a", "b", None])) for i in range(n)] + [(n, None, "a"), (n + 1, "", "b"), (n + 2, " ", "z")]


@pytest.mark.parametrize("seed", range(3))
def test_mix_equals_a_plain_loop(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    got = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert [got[r[0]] for r in rows] == brute(rows)


def test_documents_are_taken_by_their_own_probabilities(spark):
    """Over many seeds documents come as often as their size says; one probability for all would not do that."""
    rng = random.Random(4)
    rows = [(i, "w " * (10 if i % 2 else 40), "abc"[i % 3]) for i in range(90)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING").cache()
    sizes = {i: len(t.split()) for i, t, _ in rows}
    seen = dict.fromkeys(sizes, 0.0)
    seeds = 400
    for seed in range(seeds):
        for r, n in zip(rows, brute(rows, seed)):
            seen[r[0]] += n / seeds
    for seed in (7, 8):
        assert [r.copies for r in sorted(mixing.mix(docs, seed).collect(), key=lambda r: r.doc_id)] == [n for _, n in sorted(zip([r[0] for r in rows], brute(rows, seed)))]
    goal = brute_targets({s: sum(sizes[r[0]] for r in rows if r[2] == s) for s in "abc"})
    for source in "abc":
        own = [r[0] for r in rows if r[2] == source]
        level = level_of([sizes[i] for i in own], goal[source])
        for size in (10, 40):
            these = [seen[i] for i in own if sizes[i] == size]
            assert sum(these) / len(these) == pytest.approx(min(2, level * size), abs=0.06)
    # An even rate for all documents of a source lies far from these.
    assert any(abs(min(2, level_of([sizes[r[0]] for r in rows if r[2] == s], goal[s]) * 10) - goal[s] / sum(sizes[r[0]] for r in rows if r[2] == s)) > 0.3 for s in "abc")
