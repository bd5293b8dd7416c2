"""Near copies of the pipeline's stage, against brute force over all pairs."""

import itertools
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from fleetfold.llm import near, simhash

SCHEMA = "doc_id LONG, text STRING, source STRING"


def brute_shingles(text):
    own = (text or "").lower().split()
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} or ({tuple(own)} if own else set())


def brute_similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_components(texts):
    root, sets = list(range(len(texts))), [brute_shingles(t) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        if brute_similarity(sets[i], sets[j]) >= 0.8:
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    return root


def edited(rng, own, n):
    own = list(own)
    for at in rng.sample(range(len(own)), n):
        own[at] = f"new{rng.randrange(10**6)}"
    return own


def corpus(seed=3):
    """Texts with copies on both sides of the threshold, and chains of copies."""
    rng, texts = random.Random(seed), []
    for _ in range(60):
        own = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        texts.append(own)
        for part in (0.005, 0.01, 0.02, 0.025, 0.03, 0.05):
            texts.append(edited(rng, own, max(1, int(part * len(own)))))
            texts.append(edited(rng, texts[-1], max(1, int(part * len(own)))))
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_stage_reaches_its_similarity(spark):
    texts = corpus() + ["one two", "One  two", "one three", None, "", " "]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    root = brute_components(texts)
    assert got == {min(i for i, r in enumerate(root) if r == c) for c in set(root)}


def test_copies_that_their_first_does_not_match_are_found(spark):
    """A bucket whose first member is a copy of nothing still links the others."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, 9))) for i in range(40)]
    for i, text in rows[:20]:
        rows.append((100 + i, " ".join(edited(rng, text.split(), 1))))
    docs = spark.createDataFrame([(*r, "a") for r in rows], SCHEMA)
    root = brute_components([t for _, t in rows])
    want = {min(rows[i][0] for i, r in enumerate(root) if r == c) for c in set(root)}
    assert {r.doc_id for r in near.representatives(docs).collect()} == want
    assert near.representatives(docs.limit(0)).count() == 0


@pytest.mark.parametrize("way", [near, simhash])
def test_rows_without_an_id_or_with_a_shared_one_are_decided_apart(spark, way):
    rng = random.Random(2)
    one, two, three, four = ([f"w{rng.randrange(10**6)}" for _ in range(600)] for _ in range(4))
    joined = lambda w, end="": " ".join(w) + end
    rows = [
        (None, "alone"), (7, joined(one)), (None, joined(one)), (None, joined(one, " x")),
        (None, joined(two)), (None, joined(two, " x")), (None, joined(two, " x")), (8, joined(three)), (8, joined(four)), (9, joined(four, " x")), (9, joined(four, " x")),
    ]
    got = [(r.doc_id, r.text.split()[0]) for r in way.representatives(spark.createDataFrame([(*r, "a") for r in rows], SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(None, "alone"), (7, one[0]), (None, two[0]), (8, three[0]), (8, four[0])], key=str)


@pytest.mark.parametrize("bucket", [3, 16])
def test_large_buckets_are_dealt_into_blocks(spark, monkeypatch, bucket):
    """Two families of copies that share buckets: no bucket is small enough to be compared at once."""
    monkeypatch.setattr(near, "BUCKET", bucket)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    other = base[:252] + [f"v{i}" for i in range(48)]
    rows = [(i, " ".join(edited(rng, (base, other)[i % 2], 1))) for i in range(60)]
    docs = spark.createDataFrame([(*r, "a") for r in rows], SCHEMA)
    root = brute_components([t for _, t in rows])
    want = {min(rows[i][0] for i, r in enumerate(root) if r == c) for c in set(root)}
    assert {r.doc_id for r in near.representatives(docs).collect()} == want


def test_sets_larger_than_a_sketch_are_decided_exactly(spark, monkeypatch):
    monkeypatch.setattr(near, "SKETCH", 64)
    monkeypatch.setattr(near, "SLACK", 0.3)
    texts = [t for t in corpus(11) if len(t.split()) > 120][:200]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], SCHEMA)
    root = brute_components(texts)
    assert {r.doc_id for r in near.representatives(docs).collect()} == {min(i for i, r in enumerate(root) if r == c) for c in set(root)}


def test_traits_estimate_the_similarity():
    """Sets at 0.8 stay above the limit of the block check, sets at 0.65 below it."""
    rng = np.random.default_rng(4)
    for n in (20, 300, 5000):
        for similarity, passes in ((0.8, True), (0.65, False)):
            common = rng.integers(-(1 << 63), 1 << 63, size=int(n * similarity))
            own = lambda k: rng.integers(-(1 << 63), 1 << 63, size=k)
            rest = n - len(common)
            a, b = (np.frombuffer(near.traits(np.concatenate([common, own(k)])), dtype=np.uint8) for k in (rest // 2, rest - rest // 2))
            assert (np.count_nonzero(a == b) >= near.AGREE) == passes
    assert len(near.traits(np.empty(0, np.int64))) == near.TRAITS


def test_a_pair_belongs_to_the_first_bucket_it_shares():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 3, size=(500, near.GROUPS * near.PLACES))
    b = np.where(rng.random(a.shape) < 0.7, a, 7)
    for x, y, got in zip(a, b, near._first_table(a, b)):
        shared = []
        for group in range(near.GROUPS):
            for at, mask in enumerate(near._TABLES):
                if all(x[group * near.PLACES + i] == y[group * near.PLACES + i] for i in range(near.PLACES) if mask >> i & 1):
                    shared.append(group * len(near._TABLES) + at)
        assert got == min(shared, default=-1)


def test_a_block_gives_a_forest_not_its_pairs():
    """Forty sets, each like every other: 39 links leave the block, and they connect all."""
    rng = np.random.default_rng(7)
    common = rng.integers(-(1 << 63), 1 << 63, size=95)
    sets = [np.unique(np.concatenate([common, rng.integers(-(1 << 63), 1 << 63, size=5)])) for _ in range(40)]
    rows = [(i, i, 0, few, i > 0, [0] * near.GROUPS * near.PLACES, near.traits(v), len(v), v) for few in (True, False) for i, v in enumerate(sets) if i or not few]
    names = ["node", "root", "table", "few", "outside", "minima", "traits", "n", "sketch"]
    types = dict(zip(names, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.list_(pa.int64()))))
    found = near._pairs(pa.table({n: pa.array(list(c), types[n]) for n, c in zip(names, zip(*rows))}), 0.8).to_pylist()
    root = list(range(40))
    for link in found:
        assert link["sure"] and brute_similarity(set(sets[link["a"]].tolist()), set(sets[link["b"]].tolist())) >= 0.8
        root = [root[link["b"]] if r == root[link["a"]] else r for r in root]
    assert len(found) == 39 and len(set(root)) == 1
