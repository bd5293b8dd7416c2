"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits, so punctuation and layout do not hide a passage. A
document and an item are compared only if they share seeds, runs of ``MATCH`` words: an item that is
covered to the threshold by tiles of at least that length must share a known least number of them, so
the seed join loses nothing. A pair that remains is tiled: the longest stretches of words common to
both that no tile holds yet become tiles, longest first, found by running Karp-Rabin (hashes of all
free stretches of one length at once, for shrinking lengths); the share of the item's words that lie in
tiles is its coverage. Order plays no part, so reordered passages are caught.

The seed join is the same plan at any size: item seeds are copied to the executors if their counted
number is within ``BROADCAST_SEEDS`` and shuffled otherwise; a seed that very many documents share meets one
row per item that has it. Pairs are counted per document and item with map-side combining.

Null, empty and wordless texts match nothing; items of fewer than ``MATCH`` words cannot be tested and
match nothing. Null ids of documents and items are compared like any other. Rows that share an id but not the
text are documents and items of their own until the end; repeated rows give one result per id and item, with
the largest coverage, and ``decontaminated`` decides every row by its own text. Other columns are ignored, or
passed through; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import fixed, stored

MATCH, COVERAGE = 5, 0.8
ROW = ["doc_id", "digest"]  # what tells texts apart
BROADCAST_SEEDS = 2_000_000
WORDS = re.compile(r"[^\W_]+")
TILED = "doc_id BIGINT, digest BIGINT, item_id BIGINT, coverage DOUBLE, n_tiles INT, longest_tile INT"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def _words(text: Column) -> Column:
    # The same words as ``tokens`` for all text whose letters lower-case one to one.
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    trimmed = F.trim(bare)
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))


def seeds(rows: DataFrame, keys: list[str], match: int = MATCH) -> DataFrame:
    """(keys, seed, n_words): every distinct run of ``match`` words of a text, as a hash."""
    worded = fixed(rows.select(*keys, F.col("text").alias("_text")), _w=_words(F.col("_text"))).drop("_text")
    runs = F.transform(F.sequence(F.lit(0), F.size("_w") - match), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(match)]))
    some = worded.filter(F.size("_w") >= match)
    return some.select(*keys, F.size("_w").alias("n_words"), F.explode(F.array_distinct(runs)).alias("seed"))


def candidates(docs: DataFrame, items: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """Pairs (doc_id, digest, item) that share as many seeds as coverage needs.

    ``docs``: doc_id, digest, text; the first two tell texts apart. ``items``: item, text; item is unique.

    A tile of L >= m words starts L - m + 1 runs of m words, which is at least L / m, so tiles that
    cover c words start at least c / m. Runs that the item repeats are one seed, so as many as it
    repeats are taken off.
    """
    known = seeds(items, ["item"], match)
    spread = known.groupBy("item").agg(F.max("n_words").alias("n_words"), F.count("*").alias("n_seeds"))
    least = F.ceil(F.col("n_words") * F.lit(coverage) / match) - (F.col("n_words") - (match - 1) - F.col("n_seeds"))
    needed = spread.select("item", F.greatest(least, F.lit(1)).cast("long").alias("_least"))
    table = stored(known.join(needed, "item").select("seed", "item", "_least"), "seeds")
    if table.count() <= BROADCAST_SEEDS:
        table = F.broadcast(table)
    hits = seeds(docs, ROW, match).select(*ROW, "seed").join(table, "seed")
    shared = hits.groupBy(*ROW, "item").agg(F.count("*").alias("_n"), F.first("_least").alias("_least"))
    return shared.filter(F.col("_n") >= F.col("_least")).select(*ROW, "item")


def _numbers(words: list[str], known: dict[str, int]) -> np.ndarray:
    return np.array([known.get(w, 0) for w in words], dtype=np.uint64)


def _free_runs(numbers: np.ndarray, marked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all stretches of ``size`` words that no tile touches."""
    if len(numbers) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        hashes = np.zeros(len(numbers) - size + 1, dtype=np.uint64)
        for k in range(size):
            hashes = hashes * _BASE + numbers[k : len(numbers) - size + 1 + k]
    taken = np.concatenate([[0], np.cumsum(marked)])
    starts = np.flatnonzero(taken[size:] == taken[:-size])
    return starts, hashes[starts]


def _longest(item: np.ndarray, doc: np.ndarray, a: int, b: int, free_a: np.ndarray, free_b: np.ndarray) -> int:
    n = min(len(item) - a, len(doc) - b)
    same = (item[a : a + n] == doc[b : b + n]) & ~free_a[a : a + n] & ~free_b[b : b + n]
    stop = np.flatnonzero(~same)
    return int(stop[0]) if len(stop) else n


def tile(item: np.ndarray, doc: np.ndarray, match: int = MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of word numbers (0: a word the item lacks): (item start, doc start, length).

    A search finds every common stretch of ``size`` free words or more. They become tiles in order of
    length until one meets a tile; what that leaves of it may still be longer than the next, so the
    search is made again. When nothing is left, a smaller size is searched.
    """
    in_item, in_doc, tiles = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    size = max(match, len(item))
    while True:
        starts, hashes = _free_runs(item, in_item, size)
        others, theirs = _free_runs(doc, in_doc, size)
        wanted = np.isin(theirs, hashes)
        places: dict[int, list[int]] = {}
        for a, h in zip(starts.tolist(), hashes.tolist()):
            places.setdefault(h, []).append(a)
        found = []
        for b, h in zip(others[wanted].tolist(), theirs[wanted].tolist()):
            for a in places[h]:
                length = _longest(item, doc, a, b, in_item, in_doc)
                if length >= size:
                    found.append((-length, a, b))
        clear = True
        for length, a, b in sorted(found):
            clear = not in_item[a : a - length].any() and not in_doc[b : b - length].any()
            if not clear:
                break
            in_item[a : a - length] = True
            in_doc[b : b - length] = True
            tiles.append((a, b, -length))
        if clear and size == match:
            return tiles
        if clear:
            size = max(match, size // 2 if size > 2 * match else size - 1)


def tiled(docs: DataFrame, items: DataFrame, pairs: DataFrame, match: int = MATCH) -> DataFrame:
    """Tile every pair (doc_id, digest, item): one row (``TILED``) per pair. ``items``: item, item_id, text."""
    wanted = items.select("item", "item_id", F.col("text").alias("_text"))
    texts = pairs.join(wanted, "item").select(F.col("doc_id").alias("_pair"), F.col("digest").alias("_digest"), "item_id", F.col("_text").alias("item"))
    same = F.col("_pair").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest"))
    both = texts.join(docs.select(*ROW, "text"), same).select(*ROW, "item_id", "item", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, digest, item_id, item, text in zip(*[c.to_pylist() for c in batch.columns]):
                words = tokens(item or "")
                known = {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}
                tiles = tile(_numbers(words, known), _numbers(tokens(text or ""), known), match)
                lengths = [t[2] for t in tiles]
                rows.append((doc_id, digest, item_id, sum(lengths) / max(1, len(words)), len(tiles), max(lengths, default=0)))
            yield pa.RecordBatch.from_pylist([dict(zip(_ROW.names, r)) for r in rows], schema=_ROW)

    return both.mapInArrow(run, TILED)


_ROW = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("longest_tile", pa.int32())])


def _digest() -> Column:
    return F.xxhash64("text")


def found(docs: DataFrame, items: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """``TILED`` rows of documents and items whose words they cover to the threshold, text by text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    # Numbered once and stored, so the numbers stay when a task is repeated.
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "items")
    pairs = stored(candidates(docs, items, match, coverage), "candidates")
    return tiled(docs, items, pairs, match).filter(F.col("coverage") >= coverage)


def contaminated(docs: DataFrame, items: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a document and an item whose words it covers to the threshold, with the coverage."""
    best = F.max(F.struct("coverage", F.negative("n_tiles").alias("fewest"), "longest_tile")).alias("best")
    one = found(docs, items, match, coverage).groupBy("doc_id", "item_id").agg(best)
    return one.select("doc_id", "item_id", F.col("best.coverage").alias("coverage"), (-F.col("best.fewest")).alias("n_tiles"), F.col("best.longest_tile").alias("longest_tile"))


def decontaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """Documents that no item is found in, decided row by row, whatever other rows share an id."""
    bad = stored(found(docs, items, **how).select(F.col("doc_id").alias("_bad"), F.col("digest").alias("_digest")).distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_id"), _digest().alias("_own"))
    return rows.join(bad, F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("_own") == F.col("_digest")), "left_anti").select("_doc.*")
