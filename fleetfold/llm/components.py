"""Connected components of a graph given as an edge table, by alternating star contraction.

Large star: every node points its larger neighbours at its smallest neighbour. Small star: every node
points its smaller neighbours and itself at the smallest of them. Both are a combining aggregate and a
join; edges never multiply, and the rounds needed grow with the logarithm of the graph. Each round is
written to the shared work folder, so no lineage builds up and a lost executor repeats one round.

A round costs several shuffles however few its edges are, so a graph of at most ``FEW`` edges, which is a
fraction of what one task reads anyway, is not contracted but labelled in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import forget, stored

FEW = 250_000  # edges, of 16 bytes each


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node that each reaches: roots are hooked to smaller ones until no edge joins two."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (root[one] != root[other]).any():
        np.minimum.at(root, np.maximum(root[one], root[other]), np.minimum(root[one], root[other]))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _labelled(edges: DataFrame) -> DataFrame:
    """(node, root) of a graph of at most ``FEW`` edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(batch["a"].to_numpy(), batch["b"].to_numpy()) for batch in batches]
        if ends:
            found = least_reachable(*(np.concatenate(side) for side in zip(*ends)))
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in found], names=["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node LONG, root LONG")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b, long); root is the smallest node reachable."""
    current = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    seen = _mark(current)
    while seen[0] > FEW:
        both = current.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("a", "_m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        large = stored(large, "edges")
        smallest = large.groupBy("a").agg(F.min("b").alias("_m"))
        moved = large.join(smallest, "a").filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        before, current = current, stored(moved.unionByName(smallest.withColumnRenamed("_m", "b")).distinct(), "edges")
        forget(before, large)
        mark = _mark(current)
        if mark == seen:
            roots = current.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        seen = mark
    return _labelled(current)
