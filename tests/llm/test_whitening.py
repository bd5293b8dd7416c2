import math

import numpy as np
import pytest

from fleetfold.llm import whitening

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, n INT, component STRING"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors)], SCHEMA)


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("values", [[3, -1, 0.5, -2, 7], [1, 1, 1, -1], [5.0], [-2, -3]])
def test_inertia_counts_positive_eigenvalues(values):
    assert whitening.inertia(symmetric(values)) == sum(v > 0 for v in values)


def test_inertia_needs_no_diagonal():
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    assert whitening.inertia(np.zeros((3, 3))) == 0


@pytest.mark.parametrize("values", [np.geomspace(1e-3, 1e4, 40), np.concatenate([np.full(12, 2.0), np.arange(1, 30) / 30]), np.array([1e6, 1.0, 1 + 1e-9, 0.5])])
def test_feast_finds_every_eigenpair(values):
    v = symmetric(values, 3)
    v = (v + v.T) / 2
    parts = whitening.intervals(v, len(values), 1e-6)
    assert sum(p[2] for p in parts) == len(values)
    found = [whitening.feast(v, *p) for p in parts]
    got, vectors = whitening.settle(v, np.concatenate([f[1] for f in found], axis=1), len(values))
    assert np.allclose(got, np.sort(values)[::-1], rtol=1e-10, atol=1e-9 * values.max() * 1e-3)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.linalg.norm(v @ vectors - vectors * got, axis=0).max() < 1e-12 * values.max()


def brute(vectors, k):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    d = (n * x - s).astype(float) / n
    e, u = np.linalg.eigh(d.T @ d / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, deviation, d @ u / np.sqrt(e), e / np.trace(d.T @ d / n)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((400, 40)) @ rng.standard_normal((40, 40))).tolist()
    bad = [None, [None] * 40, [float("nan")] * 40, [float("inf")] + [0.0] * 39, [], [1.0], [1e30] * 40]
    rows = whitening.whiten(table(spark, bad + vectors + vectors[:3])).collect()
    n, deviation, whitened, explained = brute(vectors + vectors[:3], 32)
    assert len(rows) == 403 * 32 and {r.n for r in rows} == {n} and {r.component for r in rows} == set(range(1, 33))
    signs = {}
    for r in rows:
        i, k = r.vec_id - len(bad), r.component - 1
        assert r.deviation == deviation[i] and math.isclose(r.explained, explained[k], rel_tol=1e-9)
        sign = signs.setdefault(k, np.sign(r.whitened * whitened[i, k]))
        assert math.isclose(r.whitened * sign, whitened[i, k], abs_tol=1e-7)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_tables_without_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [None, []])).count() == 0
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 5)).count() == 0
    rows = whitening.whiten(table(spark, [[0.0, 1.0, 5.0], [1.0, 0.0, 5.0]])).collect()
    assert sorted((r.vec_id, r.component) for r in rows) == [(0, 1), (1, 1)]
    assert {round(abs(r.whitened), 12) for r in rows} == {1.0} and rows[0].identity_error < 1e-12


def test_deviation_beyond_a_long_is_null():
    fitted = whitening.Fit(10**9, (10**15, 10**15), np.ones(1), np.ones((2, 1)), 1.0, np.eye(2))
    assert fitted.deviation(np.array([[1_000_000, 1_000_005], [1_000_000, 1_000_002]])) == [None, 4 * 10**18]
    assert fitted.deviation(np.array([[1_000_000, 1_000_001]])) == [10**18]
