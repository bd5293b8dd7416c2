"""Toxicity by classifier chains.

Categories are predicted one after the other. The linear model of a category sees the words of a text
and the probabilities that the chain gave for the categories before it. When it is trained, those
probabilities come from models that had not seen the row (out of fold), because a later model that is
fed fitted ones would trust them more than they deserve when it meets new text.

Features are words and word beginnings (so inflected forms of a stem count together), present or not.
Each fit keeps the ``FEATURES`` that tell its classes apart best in its own training rows. The models
are fitted on at most ``SAMPLE`` labelled documents, chosen by a hash of their id; each (category, fold)
is a task of its own, and only weights and the numbers of the sampled rows come to the driver. Every
document is scored in full.

Null, empty and wordless texts have no features and get the models' constant term. Labels without a
document and null ids do not train; a null label of a category leaves a row out of that category's fit alone;
of several labels of a document the largest counts, of several texts of an id the least. Without labels of both kinds a category has probability 0. Repeated rows are scored like any other;
extra columns pass through, and names of results replace columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import stored, wide_enough

SAMPLE, FOLDS, FEATURES = 6_000, 4, 1_200
SEEN = 3  # sampled documents that must have a feature for a fit to see it
STEMS = (4, 5, 6)
LOWEST, HIGHEST = 0.1, 0.5  # between these the threshold is chosen
WORDS = re.compile(r"[^\W\d_]+")
_MODEL = "fold INT, kind STRING, name STRING, value DOUBLE"


def features(text: str | None) -> set[str]:
    """Distinct words, and beginnings of words marked by a closing dash."""
    words = set(WORDS.findall((text or "").lower()))
    return words.union(*({f"{w[:n]}-" for w in words if len(w) > n} for n in STEMS))


def sample(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], size: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(row, fold, y, words) of at most about ``size`` labelled documents, chosen and folded by hash, and the vocabulary (word, code)."""
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(c.cast("double")).alias(n) for n, c in categories.items()])
    known = known.filter(F.coalesce(*categories).isNotNull())
    share = size / max(size, known.count())
    mark = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.filter(mark < share)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    # An id with several texts keeps one that does not depend on how rows arrive.
    texts = docs.select("doc_id", "text").join(chosen.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).join(chosen, "doc_id")
    words = F.pandas_udf(lambda s: s.map(lambda t: sorted(features(t))), "array<string>")
    rows = stored(texts.select(F.col("doc_id").alias("row"), fold.alias("fold"), F.array(*categories).alias("y"), words("text").alias("words")), "words")
    # Most words of a text are in no other; they can teach nothing and would fill the fits' memory.
    each = rows.select("row", F.explode("words").alias("word"))
    common = stored(each.groupBy("word").agg(F.count("*").alias("_n")).filter(F.col("_n") >= SEEN).select("word", F.xxhash64("word").alias("code")), "vocabulary")
    # Fits get numbers, not texts; what a number stands for is looked up for the few that a model keeps.
    shared = each.join(common, "word").groupBy("row").agg(F.sort_array(F.collect_list("code")).alias("words"))
    none = F.array().cast("array<bigint>")
    return rows.drop("words").join(shared, "row", "left").withColumn("words", F.coalesce("words", none)), common


class Matrix:
    """Rows of features that are present or not, and dense columns beside them; a constant is the last column.

    Only the places of ones are kept, so a matrix takes a few bytes for every word of its rows.
    """

    def __init__(self, row: np.ndarray, column: np.ndarray, dense: np.ndarray, width: int):
        self.row, self.column, self.width = row.astype(np.int32), column.astype(np.int32), width
        self.dense = np.concatenate([dense, np.ones((len(dense), 1))], axis=1)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[: self.width][self.column], minlength=len(self.dense)) + self.dense @ w[self.width :]

    def transposed_dot(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, v[self.row], minlength=self.width), self.dense.T @ v])


def _fit(x: Matrix, y: np.ndarray, penalty: float = 1.0, steps: int = 150) -> np.ndarray:
    """Logistic regression with an L2 penalty, by accelerated gradient steps; the last weight is the constant.

    Both classes weigh the same, so the constant does not drown a rare class.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    size = x.width + x.dense.shape[1]
    v = np.ones(size)
    for _ in range(20):
        v = x.transposed_dot(weight * x.dot(v))
        v /= np.linalg.norm(v) + 1e-9
    bound = 0.25 * float(np.linalg.norm(x.transposed_dot(weight * x.dot(v)))) + penalty
    shrink = np.full(size, penalty)
    shrink[-1] = 0
    w = look = np.zeros(size)
    for k in range(steps):
        p = 1 / (1 + np.exp(-x.dot(look)))
        new = look - (x.transposed_dot(weight * (p - y)) + shrink * look) / bound
        look = new + k / (k + 3) * (new - w)
        w = new
    return w


def _select(codes: np.ndarray, row: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """The features, as codes, that differ most between the classes, by the signed root of their chi-square."""
    seen = np.bincount(codes, minlength=size)
    positive = np.bincount(codes, y[row] > 0, minlength=size)
    expected = seen * max(1, int((y > 0).sum())) / max(1, len(y))
    score = np.where(seen > 1, np.abs(positive - expected) / np.sqrt(expected + 1), -1)
    best = np.argsort(-score, kind="stable")[:FEATURES]
    return np.sort(best[score[best] >= 0])


def _matrix(codes: np.ndarray, row: np.ndarray, chosen: np.ndarray, earlier: np.ndarray, size: int) -> Matrix:
    column = np.full(size, -1, dtype=np.int32)
    column[chosen] = np.arange(len(chosen))
    at = column[codes]
    return Matrix(row[at >= 0], at[at >= 0], earlier, len(chosen))


def _train(category: int, names: list[str]):
    """For one fold: fit on the other folds and predict it; fold -1 fits on all rows and keeps the model, its words as codes."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        fold = key[0].as_py()
        ids = rows["row"].to_numpy()
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int32)
        place[order] = np.arange(len(ids))
        y = np.array([v[category] for v in rows["y"].to_pylist()], dtype=float)[order]
        earlier = np.array(rows["earlier"].to_pylist(), dtype=float).reshape(len(rows), category)[order]
        held = rows["own_fold"].to_numpy()[order] == fold
        # Features in order of their codes, so that ties between them do not depend on how rows arrived.
        lengths = rows["words"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        vocabulary, codes = np.unique(rows["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        codes, row = codes.astype(np.int32), np.repeat(place, lengths)
        train = ~held & ~np.isnan(y)
        if len(set(y[train] > 0)) < 2:
            chosen, weights = np.zeros(0, np.int64), np.zeros(category + 1)
            weights[-1] = 30.0 if train.any() and y[train].min() > 0 else -30.0
        else:
            seen, number = train[row], np.cumsum(train, dtype=np.int32) - 1
            own, at = codes[seen], number[row[seen]]
            chosen = _select(own, at, y[train], len(vocabulary))
            weights = _fit(_matrix(own, at, chosen, earlier[train], len(vocabulary)), y[train])
        if fold < 0:
            labels = [*map(str, vocabulary[chosen].tolist()), *[f"\0{n}" for n in names[:category]], ""]
            return pa.table({"fold": pa.array([-1] * len(labels), pa.int32()), "kind": ["weight"] * len(labels), "name": labels, "value": weights.astype(float)})
        seen, number = held[row], np.cumsum(held, dtype=np.int32) - 1
        p = 1 / (1 + np.exp(-_matrix(codes[seen], number[row[seen]], chosen, earlier[held], len(vocabulary)).dot(weights)))
        unseen = [str(r) for r in ids[order][held]]
        return pa.table({"fold": pa.array([fold] * len(unseen), pa.int32()), "kind": pa.array(["probability"] * len(unseen), pa.string()), "name": pa.array(unseen, pa.string()), "value": p.astype(float)})

    return run


def choose_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap in out-of-fold probabilities at which F1 is largest, within the bounds."""
    if not (y > 0).any() or (y > 0).all():
        return HIGHEST
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order] > 0)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + (y > 0).sum())
    at = int(np.argmax(f1))
    below = p[order[at + 1]] if at + 1 < len(p) else 0.0
    return float(np.clip((p[order[at]] + below) / 2, LOWEST, HIGHEST))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], size: int = SAMPLE) -> tuple[list[dict[str, float]], dict[str, float]]:
    """(models, thresholds). Models of the chain in order: weights by feature, by "\\0category" for earlier ones, "" the constant.

    ``categories``: name -> column over ``labels``, in the order of the chain.
    """
    spark, names = docs.sparkSession, list(categories)
    rows, vocabulary = sample(docs, labels, categories, size)
    rows = stored(rows, "sample")
    earlier = rows.select("row", F.array().cast("array<double>").alias("earlier"))
    chain, thresholds = [], {}
    for category in range(len(names)):
        ready = rows.withColumnRenamed("fold", "own_fold").join(earlier, "row")
        spread = ready.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(-1, FOLDS)])))
        out = spread.groupBy("fold").applyInArrow(_train(category, names), _MODEL)
        found = [(r.kind, r.name, r.value) for r in stored(out, "chain").collect()]
        weights = {name: value for kind, name, value in found if kind == "weight"} or {"": -30.0}
        # The words of a model: FEATURES at the most.
        codes = spark.createDataFrame([(int(n),) for n in weights if n and n[0] != "\0"], "code BIGINT")
        meant = {str(r["code"]): r["word"] for r in vocabulary.join(F.broadcast(codes), "code").collect()}
        chain.append({meant.get(name, name): value for name, value in weights.items()})
        unseen = {int(n): v for k, n, v in found if k == "probability"}
        truth = {r.row: r.y[category] for r in rows.select("row", "y").collect()}
        ids = sorted(i for i in unseen if truth[i] is not None)
        thresholds[names[category]] = choose_threshold(np.array([unseen[i] for i in ids]), np.array([truth[i] for i in ids]))
        fresh = spark.createDataFrame(list(unseen.items()), "row LONG, p DOUBLE")
        earlier = earlier.join(fresh, "row").select("row", F.concat("earlier", F.array("p")).alias("earlier"))
    return chain, thresholds


def score(docs: DataFrame, chain: list[dict[str, float]], names: list[str], text: str = "text") -> DataFrame:
    """Add p_<category> for every category."""
    models = [({k: v for k, v in m.items() if k and k[0] != "\0"}, [m.get(f"\0{n}", 0.0) for n in names[:i]], m[""]) for i, m in enumerate(chain)]
    vocabulary: dict[str, list[float]] = {}
    for i, (weights, _, _) in enumerate(models):
        for w, v in weights.items():
            vocabulary.setdefault(w, [0.0] * len(models))[i] = v
    whole = {w: v for w, v in vocabulary.items() if not w.endswith("-")}
    stems = {w[:-1]: v for w, v in vocabulary.items() if w.endswith("-")}
    lengths = sorted({len(s) for s in stems})

    def one(value: str | None) -> list[float]:
        words = set(WORDS.findall((value or "").lower()))
        sums = [constant for _, _, constant in models]
        hits = [whole[w] for w in words if w in whole]
        for n in lengths:
            hits += [stems[s] for s in {w[:n] for w in words if len(w) > n} if s in stems]
        for v in hits:
            for i, x in enumerate(v):
                sums[i] += x
        given: list[float] = []
        for i, (_, links, _) in enumerate(models):
            total = sums[i] + sum(a * b for a, b in zip(links, given))
            given.append(float(1 / (1 + np.exp(-np.clip(total, -30, 30)))))
        return given

    @F.pandas_udf("array<double>")
    def probabilities(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(one)

    kept = [c for c in docs.columns if c not in {f"p_{n}" for n in names}]
    scored = wide_enough(docs.select(*kept)).withColumn("_p", probabilities(F.col(text)))
    return scored.select(*kept, *[F.get("_p", i).alias(f"p_{n}") for i, n in enumerate(names)])


def classify(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], verdict: str, threshold: float | None = None, size: int = SAMPLE) -> DataFrame:
    """Add p_<category> for each category and ``toxic``: whether that of ``verdict`` reaches the threshold.

    Unless one is given, the threshold is the one that parts the sampled rows best by probabilities of
    models that had not seen them.
    """
    names = list(categories)
    chain, chosen = train(docs, labels, categories, size)
    scored = score(docs, chain, names)
    return scored.withColumn("toxic", F.col(f"p_{verdict}") >= (chosen[verdict] if threshold is None else threshold))


def given_categories() -> dict[str, Column]:
    """What the labels table can teach, in the order of the chain: poor writing, toxicity, and both at once."""
    poor, toxic = 1 - F.col("quality"), F.col("toxic")
    return {"poor": poor, "toxic": toxic, "crude": poor * toxic}
