"""Whitening of embeddings: principal components by FEAST contour integration.

Entries become whole numbers x = floor(64 c) + 1,000,000, so sums and second moments are integers: tasks
add them exactly and the covariance does not depend on how rows are split or in which order they arrive.
Every entry is centred by the whole number nearest the mean before anything is multiplied; the rest of the
mean (half a unit at the most) is taken off exactly, in integers.

The covariance V is as large as the dimension allows and no larger, whatever the table. Its spectrum
is cut into intervals of few eigenvalues each; the inertia of V - s (signs of a pivoted symmetric
factorisation) counts those above s, so every interval is known to hold a given number before it is solved.
FEAST then solves each interval in a task of its own: the resolvent (z - V)^-1, applied to a block of
vectors at the points of a quadrature rule on a circle around the interval, projects the block onto
the eigenvectors inside; Rayleigh-Ritz extracts them; the steps are repeated until the residuals are those
of double precision. The number found must be the counted one, else the block grows and the interval is
solved again. A last Rayleigh-Ritz step over all intervals makes clusters that a border cut orthogonal.

Rows whose vector is null or holds null or non-finite entries are dropped, and so are those whose length is
not the most frequent one (of equally frequent ones the greatest) or with entries of 2**46 or more. Repeated rows
count as often as they occur; null and repeated ids are kept. Directions without variance (constant
tables, fewer rows than dimensions) cannot be whitened and have no component, so such tables give fewer
rows, and an empty table or a single row gives none. ``deviation`` is null where it exceeds a long. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import stored, wide_enough

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LARGEST = float(1 << 46)
NODES = 8  # quadrature points of the upper half circle
BLOCK = 8  # eigenvalues to an interval, as far as they can be told apart
ROUNDS = 60
FLOOR = 1e-11  # share of all variance below which a direction is rounding
_EXACT = 1 << 53


# -- eigenvectors of one symmetric matrix -----------------------------------------------------


def inertia(matrix: np.ndarray) -> int:
    """Number of positive eigenvalues, from a symmetric factorisation with 1x1 and 2x2 pivots."""
    a = matrix.astype(float).copy()
    positive = 0
    while len(a):
        size = np.abs(a)
        diagonal = size.diagonal()
        r = int(np.argmax(diagonal))
        p, q = np.unravel_index(int(np.argmax(size)), size.shape)
        if size[p, q] == 0:
            break
        # Fixed value: the bound of Bunch and Parlett, (1 + sqrt(17)) / 8.
        pivots = [r] if diagonal[r] >= 0.6403882032022076 * size[p, q] else [int(p), int(q)]
        rest = np.setdiff1d(np.arange(len(a)), pivots)
        block, side = a[np.ix_(pivots, pivots)], a[np.ix_(rest, pivots)]
        # A 2x2 pivot is taken only where its determinant is negative: one eigenvalue of each sign.
        positive += int(block[0, 0] > 0) if len(pivots) == 1 else 1
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return positive


def above(v: np.ndarray, at: float) -> int:
    """Eigenvalues of v greater than ``at``."""
    return inertia(v - at * np.eye(len(v)))


def intervals(v: np.ndarray, wanted: int, floor: float, block: int = BLOCK) -> list[tuple[float, float, int]]:
    """(low, high, number) of intervals that together hold the ``wanted`` largest eigenvalues above ``floor``."""
    top, floor = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9) + float(floor), float(floor)
    total = above(v, floor)
    open_, out = [(floor, top, total, 0)], []
    while open_:
        low, high, below, over = open_.pop()  # counts above low and above high
        if below == over or over >= wanted:
            continue
        narrow = high - low <= 1e-10 * top
        if below - over <= block or narrow:
            out.append((low, high, below - over))
            continue
        middle = (low + high) / 2
        count = above(v, middle)
        open_ += [(low, middle, below, count), (middle, high, count, over)]
    return sorted(out)


def feast(v: np.ndarray, low: float, high: float, number: int, tolerance: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``number`` eigenpairs of v in (low, high]."""
    n = len(v)
    centre, radius = (low + high) / 2, (high - low) / 2
    # Gauss-Legendre rule on the half circle; the other half is its complex conjugate.
    points, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (1 - points)
    norm = float(np.abs(v).sum(axis=1).max())
    size = min(n, number + max(4, number // 2))
    while True:
        basis = np.random.default_rng(number + 1000 * size).standard_normal((n, size))
        best = None
        for _ in range(ROUNDS):
            projected = np.zeros((n, size))
            for angle, weight in zip(angles, weights):
                turn = radius * np.exp(1j * angle)
                solved = np.linalg.solve((centre + turn) * np.eye(n) - v, basis.astype(complex))
                projected += weight / 2 * (turn * solved).real
            q, _ = np.linalg.qr(projected)
            values, small = np.linalg.eigh(q.T @ v @ q)
            basis = q @ small
            inside = (values > low) & (values <= high)
            residual = np.linalg.norm(v @ basis - basis * values, axis=0)
            worst = residual[inside].max(initial=0.0)
            if inside.sum() == number:
                if best is None or worst < best[0]:
                    best = (worst, values[inside], basis[:, inside])
                elif best[0] <= 64 * tolerance * norm:
                    break  # no better than the rounding of v allows
                if worst <= tolerance * norm:
                    break
        if best is not None and best[0] <= 1e-11 * norm:
            return best[1], best[2]
        if size == n:
            raise ArithmeticError(f"{number} eigenvalues counted in ({low}, {high}], not found")
        size = min(n, 2 * size)


def settle(v: np.ndarray, vectors: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenpairs out of all intervals' vectors, by one more Rayleigh-Ritz step."""
    q, _ = np.linalg.qr(vectors)
    values, small = np.linalg.eigh(q.T @ v @ q)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], (q @ small)[:, order]


# -- exact sums over a table ------------------------------------------------------------------


def _matrix(batch: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): numbers of the usable rows of a batch of lists and their whole entries. Entries are longs.

    Without ``width``, x is empty and rows are those usable in themselves.
    """
    lengths = batch.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = batch.flatten()
    numbers = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * numbers)
        good = np.abs(scaled) < LARGEST
    row = np.repeat(np.arange(len(batch)), np.maximum(lengths, 0))
    usable = lengths >= 0
    usable[row[~good]] = False
    if width is not None:
        usable &= lengths == width
        taken = scaled[usable[row]] if len(row) else scaled
        return np.flatnonzero(usable), taken.reshape(int(usable.sum()), width).astype(np.int64) + SHIFT
    return np.flatnonzero(usable), np.zeros((0, 0), np.int64)


def _moments(d: np.ndarray) -> np.ndarray:
    """d.T @ d of whole numbers, exactly."""
    most = int(np.abs(d).max(initial=0))
    rows = _EXACT // max(1, most * most)
    if rows == 0:
        d = d.astype(object)
        return d.T.dot(d)
    total = np.zeros((d.shape[1], d.shape[1]), dtype=object)
    for at in range(0, len(d), rows):
        part = d[at : at + rows].astype(float)
        total = total + (part.T @ part).astype(np.int64)
    return total


def _decimals(values) -> pa.Array:
    return pa.array([str(int(v)) for v in values], pa.string())


def _summed(rows: DataFrame, keys: list[str]) -> list:
    """Sums of the partial sums that tasks emit as text; one row per key, as many as the dimension gives."""
    return rows.groupBy(*keys).agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()


@dataclass(frozen=True)
class Fit:
    """What whitening needs of the table: counts, sums, and the components (columns of ``vectors``)."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    covariance: np.ndarray

    @property
    def base(self) -> np.ndarray:
        """The whole number nearest each mean."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n) - int(b)) for s, b in zip(self.sums, self.base)])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.base).astype(float) - self.rest) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)**2."""
        offsets = [self.n * int(b) - s for s, b in zip(self.sums, self.base)]
        d = x - self.base
        most = self.n * int(np.abs(d).max(initial=0)) + max(map(abs, offsets), default=0)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * d + np.array(offsets, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * d.astype(object) + np.array(offsets, dtype=object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def dimension(vectors: DataFrame) -> tuple[int, int] | None:
    """(n, length) of the vectors that are whitened. ``vectors``: embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in batches:
            rows, _ = _matrix(batch.column(0))
            for length, count in zip(*np.unique(batch.column(0).value_lengths().to_numpy(zero_copy_only=False)[rows], return_counts=True)):
                counts[int(length)] = counts.get(int(length), 0) + int(count)
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["width", "n"])

    lengths = vectors.mapInArrow(run, "width LONG, n LONG").groupBy("width").agg(F.sum("n").alias("n"))
    found = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    return None if found is None or found["width"] == 0 else (found["n"], found["width"])


def sums(vectors: DataFrame, width: int) -> tuple[int, ...]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=object)
        for batch in batches:
            total = total + _matrix(batch.column(0), width)[1].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), _decimals(total)], names=["i", "s"])

    found = {r["i"]: int(r["s"]) for r in _summed(vectors.mapInArrow(run, "i INT, s STRING"), ["i"])}
    return tuple(found[i] for i in range(width))


def covariance(vectors: DataFrame, n: int, total: tuple[int, ...]) -> np.ndarray:
    """V with divisor n, each entry the exact value rounded once."""
    width = len(total)
    base = np.array([(2 * s + n) // (2 * n) for s in total], dtype=np.int64)
    low, high = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = np.zeros((width, width), dtype=object)
        for batch in batches:
            moments = moments + _moments(_matrix(batch.column(0), width)[1] - base)
        names = ["i", "j", "s"]
        yield pa.RecordBatch.from_arrays([pa.array(low, pa.int32()), pa.array(high, pa.int32()), _decimals(moments[low, high])], names=names)

    left = [s - n * int(b) for s, b in zip(total, base)]
    v = np.zeros((width, width))
    for r in _summed(vectors.mapInArrow(run, "i INT, j INT, s STRING"), ["i", "j"]):
        i, j = r["i"], r["j"]
        v[i, j] = v[j, i] = float(Fraction(n * int(r["s"]) - left[i] * left[j], n * n))
    return v


def solve(vectors: DataFrame, v: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the greatest eigenpairs of v; each interval is a task."""
    spark = vectors.sparkSession
    floor = FLOOR * float(np.trace(v))
    wanted = min(components, above(v, floor) if floor > 0 else 0)
    parts = intervals(v, wanted, floor) if wanted else []
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch.itertuples():
                _, found = feast(v, part.low, part.high, part.number)
                yield pd.DataFrame({"high": part.high, "vector": list(found.T)})

    rows = spark.createDataFrame(parts, "low DOUBLE, high DOUBLE, number INT").repartition(len(parts), "high")
    found = stored(rows.mapInPandas(run, "high DOUBLE, vector ARRAY<DOUBLE>"), "intervals").orderBy("high").collect()
    return settle(v, np.array([r["vector"] for r in found]).T, wanted)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of all vectors (column ``embedding``); None where none can be whitened."""
    found = dimension(vectors)
    if found is None:
        return None
    n, width = found
    total = sums(vectors, width)
    v = covariance(vectors, n, total)
    values, basis = solve(vectors, v, components)
    return Fit(n, total, values, basis, float(np.trace(v)), v) if len(values) else None


def identity_error(vectors: DataFrame, fitted: Fit) -> float:
    """Largest entry of the whitened vectors' covariance less the identity, measured over all rows."""
    width, k = len(fitted.sums), len(fitted.values)
    low, high = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, moments = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = fitted.whiten(_matrix(batch.column(0), width)[1])
            mean, moments = mean + w.sum(axis=0), moments + w.T @ w
        i = np.concatenate([np.full(k, -1), low])
        j = np.concatenate([np.arange(k), high])
        values = np.concatenate([mean, moments[low, high]])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values)], names=["i", "j", "s"])

    sums_ = vectors.mapInArrow(run, "i INT, j INT, s DOUBLE").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    mean, c = np.zeros(k), np.zeros((k, k))
    for r in sums_:
        if r["i"] < 0:
            mean[r["j"]] = r["s"] / fitted.n
        else:
            c[r["i"], r["j"]] = c[r["j"], r["i"]] = r["s"] / fitted.n
    return float(np.abs(c - np.outer(mean, mean) - np.eye(k)).max())


WHITENED = "vec_id BIGINT, n BIGINT, deviation BIGINT, whitened ARRAY<DOUBLE>"


def transform(rows: DataFrame, fitted: Fit) -> DataFrame:
    """(vec_id, n, deviation, whitened): one row per usable vector. ``rows``: vec_id, embedding."""
    width = len(fitted.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _matrix(batch.column(1), width)
            w = fitted.whiten(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            count = pa.array(np.full(len(at), fitted.n), pa.int64())
            ids = batch.column(0).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([ids, count, pa.array(fitted.deviation(x), pa.int64()), lists], names=["vec_id", "n", "deviation", "whitened"])

    return wide_enough(rows).mapInArrow(run, WHITENED)


def _input(rows: DataFrame, embedding: Column | str = "embedding") -> DataFrame:
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col(embedding) if isinstance(embedding, str) else embedding).cast("array<double>").alias("embedding"))


def whiten(rows: DataFrame, components: int = COMPONENTS, embedding: str = "embedding") -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    usable = _input(rows, embedding)
    vectors = wide_enough(usable.select("embedding"))
    fitted = fit(vectors, components)
    empty = "vec_id BIGINT, component INT, n BIGINT, deviation BIGINT, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE"
    if fitted is None:
        return rows.sparkSession.createDataFrame([], empty)
    error = identity_error(vectors, fitted)
    shares = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.values])
    spread = transform(usable, fitted).select("vec_id", "n", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return spread.select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get(shares, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
