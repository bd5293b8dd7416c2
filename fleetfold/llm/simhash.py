"""SimHash near-duplicates by covering locality-sensitive hashing.

Masks: every bit position gets a point of the projective space of dimension r over a small field, and
each point v of that space is a table whose mask keeps the positions not orthogonal to v. Any r
positions are orthogonal to a common v, so two fingerprints that differ in r bits or fewer agree on
the kept bits of some table: no pair within the radius is missed, which random masks cannot promise.
Over two elements, 64 bits and r = 3 need 15 tables with keys of about 32 bits; a field of three gives
40 tables with keys of about 42 bits, for larger corpora.

Equal fingerprints are one row before anything is paired. A bucket of ``BUCKET`` fingerprints or fewer
gives the edges of a spanning forest, never its pairs. The fingerprints of a larger one differ only in
bits the mask leaves out, so the same construction over those bits splits it, again without losing a
pair: 64, 32, 16, 8 free bits, and 8 free bits hold 256 fingerprints at most.

Null, empty and blank texts have the fingerprint zero and are linked like any other. A component's id is
its smallest doc_id; null ids do not count, and a component with nothing else has a null id. Repeated
rows are all returned. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from fleetfold.llm.common import ascii_lower, first_rows, fixed, stored, text_key, words
from fleetfold.llm.components import components

BITS, RADIUS, SHINGLE, BUCKET = 64, 3, 3, 4096


def shingle_hashes(words_: Column, size: int = SHINGLE) -> Column:
    """XXH64 with seed 42 (which is what xxhash64 computes) of every shingle, repeats included."""
    several = F.transform(
        F.sequence(F.lit(0), F.size(words_) - size),
        lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(words_, i + k) for k in range(size)])),
    )
    whole = F.array(F.xxhash64(F.concat_ws(" ", words_)))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(words_) == 0, none).when(F.size(words_) < size, whole).otherwise(several)


def majority(hashes: pd.Series) -> pd.Series:
    """The bits that are set in more than half of the hashes."""

    def one(values) -> int:
        values = np.ascontiguousarray(values, dtype=np.int64)
        ones = np.zeros(BITS, dtype=np.int64)
        for at in range(0, len(values), 1 << 16):
            block = values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * ones > len(values), bitorder="little").view(np.int64)[0])

    return hashes.map(one).astype("int64")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp): a 64-bit fingerprint of each text."""
    rows = fixed(docs.select("doc_id", F.col(text).alias("_text")), _words=words(ascii_lower(F.col("_text")))).drop("_text")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.pandas_udf(majority, LongType())(shingle_hashes(F.col("_words"))).alias("fp"))


def masks(positions: list[int], radius: int = RADIUS, field: int = 2) -> list[int]:
    """One mask for each table over the given bit positions (see above); ``field`` is a prime."""
    space = [p for p in itertools.product(range(field), repeat=radius + 1) if next((x for x in p if x), 0) == 1]
    points = [space[i % len(space)] for i in range(len(positions))]
    kept = lambda v, p: sum(a * b for a, b in zip(v, p)) % field != 0
    return [sum(1 << bit for bit, p in zip(positions, points) if kept(v, p)) for v in space]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def forest(values: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the graph of values within the radius."""
    rest = np.unique(values)
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count((rest ^ at).view(np.uint64)) <= radius
            for other in rest[near]:
                yield int(at), int(other)
                front.append(other)
            rest = rest[~near]


def _forests(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [edge for values in batch["fps"] for edge in forest(np.asarray(values, dtype=np.int64), radius)]
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def links(fps: DataFrame, radius: int = RADIUS, field: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect exactly what pairs within the radius connect. ``fps``: distinct fp."""
    spark = fps.sparkSession
    level, found = fps.select(F.lit(0).alias("path"), "fp"), []
    kept = {0: 0}
    while True:
        below = {}
        rows = []
        for path, mask in kept.items():
            free = [i for i in range(BITS) if not mask >> i & 1]
            for sub in masks(free, radius, field):
                below[len(below)] = mask | sub
                rows.append((path, len(below) - 1, _signed(mask | sub)))
        # A few thousand rows at the most, whatever the data.
        tables = F.broadcast(spark.createDataFrame(rows, "path INT, next INT, mask LONG"))
        keyed = level.join(tables, "path").select(F.col("next").alias("path"), "fp", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        sizes = stored(keyed.groupBy("path", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
        # Once so few bits are free that a bucket cannot be large, none is split further.
        final = all(2 ** (BITS - mask.bit_count()) <= bucket for mask in below.values())
        small = sizes if final else sizes.filter(F.col("n") <= bucket)
        gathered = keyed.join(small.drop("n"), ["path", "key"]).groupBy("path", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        found.append(gathered.mapInPandas(lambda batches: _forests(batches, radius), "a LONG, b LONG").distinct())
        if final or sizes.filter(F.col("n") > bucket).isEmpty():
            return reduce(DataFrame.unionByName, found)
        heavy = sizes.filter(F.col("n") > bucket)
        level = stored(keyed.join(heavy.drop("n"), ["path", "key"]).select("path", "fp").distinct(), "level")
        large = {r[0] for r in heavy.select("path").distinct().collect()}
        kept = {path: mask for path, mask in below.items() if path in large}


def near_duplicates(docs: DataFrame, radius: int = RADIUS, field: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    prints = stored(fingerprints(docs), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), radius, field, bucket))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, radius: int = RADIUS, field: int = 2, bucket: int = BUCKET) -> DataFrame:
    """One row of each component: that with the smallest doc_id, nulls last, then the least text key.

    Every row is decided by its own text, whether it has an id or shares one.
    """
    texts = docs.groupBy(text_key(F.col("text")).alias("doc_id")).agg(F.min("text").alias("text"))
    prints = stored(fingerprints(texts), "fingerprints")
    roots = components(links(prints.select("fp").distinct(), radius, field, bucket)).withColumnRenamed("node", "fp")
    placed = prints.join(roots, "fp", "left")
    return first_rows(docs, placed.select(F.col("doc_id").alias("node"), F.coalesce("root", "fp").alias("root")))
