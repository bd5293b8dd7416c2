"""Language identification by nearest centroid.

A text is a vector of character n-grams (one to three characters, blanks at word borders included),
hashed to ``BUCKETS`` columns, weighted by 1 + log of the count and by inverse document frequency, and
brought to length one. Document frequencies are counted over all documents that may be learned from.
The vectors of each language's sample are clustered by spherical k-means, so a language that is written
in several manners has several centroids; a text gets the language of the centroid with the largest
cosine. Distances of the sample to its own centroids give each centroid a radius: a text outside it is
marked as rejected, as no language that was learned is near.

Text that is null or has no letter is ``und`` with score 0; without anything to learn from, every text
is. Very long texts are read whole. Null languages and null ids are not learned from. Ties go to the
centroid that stands first by language and number. Repeated rows are predicted like any other; extra
columns pass through, and names of results replace columns of the same name.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import stored, wide_enough

BUCKETS = 1 << 14
SAMPLE, CLUSTERS, ROUNDS = 1_500, 4, 12  # of each language: documents at most, centroids, k-means rounds
REJECT_QUANTILE, REJECT_SLACK = 0.995, 1.25
NONE = "und"
_MODEL = "lang STRING, number INT, centroid ARRAY<FLOAT>, radius DOUBLE"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(sys.maxunicode + 1)], dtype=np.uint32)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(columns, counts) of a text's n-grams; None if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _letters()[points]
    if not letters.any():
        return None
    padded = np.concatenate([[0], letters, [0]]).astype(np.uint32)
    # A run of characters that are not letters is one blank.
    padded = padded[np.concatenate([[True], (padded[1:] != 0) | (padded[:-1] != 0)])]
    one, two = padded[1:-1], padded[:-1] * np.uint32(0x9E3779B1) + padded[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + padded[2:] * np.uint32(0x27D4EB2F)
    hashes = np.concatenate([one[one != 0] * np.uint32(0x165667B1), two, three])
    columns = (hashes ^ (hashes >> 15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - (BUCKETS - 1).bit_length())
    counts = np.bincount(columns, minlength=BUCKETS)
    known = np.flatnonzero(counts)
    return known, counts[known]


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    found = grams(text)
    if found is None:
        return None
    columns, counts = found
    weights = (1 + np.log(counts)) * idf[columns]
    return columns, (weights / (np.linalg.norm(weights) + 1e-12)).astype(np.float32)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each column occurs, over all of them: one row of sums per task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = grams(text)
                if found is not None:
                    seen[found[0]] += 1
                    total += 1
        columns = np.concatenate([np.flatnonzero(seen), [BUCKETS]])
        values = np.concatenate([seen[columns[:-1]], [total]])
        yield pa.RecordBatch.from_arrays([pa.array(columns, pa.int64()), pa.array(values, pa.int64())], names=["column", "n"])

    rows = wide_enough(docs.select("text")).mapInArrow(run, "column LONG, n LONG").groupBy("column").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for column, n in rows:
        out[column] = n
    return out[:-1], int(out[-1])


def _kmeans(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out first centroids: (centroids, own centroid of each row)."""
    centroids = [x[0]]
    while len(centroids) < min(k, len(x)):
        nearest = np.max(x @ np.stack(centroids).T, axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        centroids.append(x[int(np.argmin(nearest))])
    c = np.stack(centroids)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-12)
    return c, np.argmax(x @ c.T, axis=1)


def centroids(docs: DataFrame, idf: np.ndarray, size: int = SAMPLE, clusters: int = CLUSTERS) -> pd.DataFrame:
    """Centroids of each language of docs (text, lang), from at most about ``size`` different texts of each."""
    counts = docs.groupBy("lang").agg(F.count("*").alias("_n"))
    # Equal texts are chosen together and then count once, however often a row is repeated.
    mark = F.pmod(F.xxhash64("text", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    some = docs.join(counts, "lang").filter(mark < F.lit(float(size)) / F.greatest("_n", F.lit(size)))
    chosen = some.groupBy("lang", F.xxhash64("text").alias("_key")).agg(F.min("text").alias("text"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_key", kind="stable")
        found = [v for v in (vector(t, idf) for t in rows["text"]) if v is not None]
        if not found:
            return pd.DataFrame({"lang": [], "number": [], "centroid": [], "radius": []})
        x = np.zeros((len(found), BUCKETS), dtype=np.float32)
        for row, (columns, weights) in zip(x, found):
            row[columns] = weights
        c, own = _kmeans(x, clusters, ROUNDS)
        apart = 1 - np.sum(x * c[own], axis=1)
        radius = [float(np.quantile(apart[own == i], REJECT_QUANTILE)) * REJECT_SLACK if (own == i).any() else 0.0 for i in range(len(c))]
        return pd.DataFrame({"lang": key[0], "number": range(len(c)), "centroid": [r.tolist() for r in c], "radius": radius})

    found = stored(chosen.groupBy("lang").applyInPandas(run, _MODEL), "centroids")
    return found.orderBy("lang", "number").toPandas()


def predict(docs: DataFrame, model: pd.DataFrame, idf: np.ndarray, text: str = "text") -> DataFrame:
    """Add lang_pred, score (cosine of the nearest centroid, 0 to 1) and rejected."""
    names, radius = model["lang"].tolist(), model["radius"].tolist()
    matrix = np.stack(model["centroid"].tolist()).astype(np.float32).T.copy() if names else None

    def one(value: str | None) -> tuple[str, float, bool]:
        found = vector(value, idf) if names else None
        if found is None:
            return NONE, 0.0, True
        columns, weights = found
        cosines = weights @ matrix[columns]
        best = int(np.argmax(cosines))
        cosine = float(np.clip(cosines[best], 0, 1))
        return names[best], cosine, 1 - cosine > radius[best]

    @F.pandas_udf("lang_pred STRING, score DOUBLE, rejected BOOLEAN")
    def nearest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([one(t) for t in batch], columns=["lang_pred", "score", "rejected"])

    kept = [c for c in docs.columns if c not in {"lang_pred", "score", "rejected"}]
    return wide_enough(docs.select(*kept)).withColumn("_near", nearest(F.col(text))).select(*kept, "_near.*")


def identify(docs: DataFrame, learnable: DataFrame, size: int = SAMPLE, clusters: int = CLUSTERS) -> DataFrame:
    """Learn from ``learnable`` (doc_id, text, lang) and predict every row of docs."""
    learnable = learnable.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    seen, total = document_frequencies(learnable)
    idf = np.log((1 + total) / (1 + seen)) + 1
    return predict(docs, centroids(learnable, idf, size, clusters), idf)
