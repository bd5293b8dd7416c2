"""Runs of periodic text, found with a suffix automaton and link-cut access.

A run is a stretch of consecutive words with smallest period q, at least ``FEWEST`` words and ``TIMES`` q
long, that no neighbouring word continues. The suffix automaton of a text has a state for every class of
substrings that end at the same places; the link of a state leads to the longest suffix that ends at more.
Reading the text once more, the word at i recolours the path of links from its prefix to the root: every
substring on it now ended last at i. That is the access operation of a link-cut tree. The links do not change,
so its preferred paths are kept on heavy chains, each a stack of segments of one colour, rather than in
splay trees; a path is cut into few segments, and recolouring costs what it removes. Where a segment
is recoloured, its longest substring, of length L, ended at i and before that at e: if i - e <= L, the words
before i repeat with period i - e at least twice, which is a square. Every run holds a square of its period and
is met at the end of the first one; comparing words at that distance extends it to both sides, once per run.

A run with TIMES >= 4 needs 3 q words in a row whose previous equal word is at most q back. Stretches
without that, which is most text, are ruled out before an automaton is built (``stretches``); nothing is
lost, and runs are extended over the whole text.

Every text is handled in one task as a whole. Null, empty and blank texts have no words and no runs. Rows are
told apart by nothing, so repeated ids and rows give a row each. Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import GAPS, wide_enough

FEWEST, TIMES = 6, 4
Run = tuple[int, int, int]  # first word, words, period


def split(text: str | None) -> list[str]:
    text = text or ""
    for blank in GAPS[1:]:
        if blank in text:
            text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def numbered(words: list[str]) -> list[int]:
    known: dict[str, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


def stretches(ids: list[int], fewest: int = FEWEST, times: int = TIMES) -> list[tuple[int, int]]:
    """[from, to) of the parts of a text that hold all its runs. ``times`` is 2 or more.

    In a run of period q every word but the first q has an equal word at most q before it, and there are
    (times - 1) q of those. So a stretch of m words in which no equal word is farther back than
    m / (times - 1) is kept, with that many words before it; others are cut where one is farther.
    """
    n = len(ids)
    values = np.array(ids, dtype=np.int64)
    order = np.argsort(values, kind="stable")
    again = np.flatnonzero(values[order[1:]] == values[order[:-1]])
    back = np.full(n, n + 1, dtype=np.int64)
    back[order[again + 1]] = order[again + 1] - order[again]
    open_, kept = [(0, n)], []
    while open_:
        low, high = open_.pop()
        reach = (high - low) // (times - 1)
        far = np.flatnonzero(back[low:high] > reach)
        if not len(far):
            kept.append((max(0, low - reach), high))
            continue
        cuts = np.concatenate([[-1], far, [high - low]])
        wide = np.flatnonzero(np.diff(cuts) - 1 >= max(1, times - 1))
        open_ += [(low + int(cuts[k]) + 1, low + int(cuts[k + 1])) for k in wide]
    merged: list[list[int]] = []
    for low, high in sorted(kept):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return [(low, high) for low, high in merged if high - low >= fewest]


class Automaton:
    """Suffix automaton of a sequence: ``length`` and ``link`` of every state, and ``ends``, the state of each prefix."""

    def __init__(self, sequence: list[int]):
        moves: list[dict[int, int]] = [{}]
        link, length, ends, last = [-1], [0], [], 0
        for symbol in sequence:
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and symbol not in moves[at]:
                moves[at][symbol] = new
                at = link[at]
            if at >= 0:
                to = moves[at][symbol]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    part = len(moves)
                    moves.append(dict(moves[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    link[to] = link[new] = part
                    while at >= 0 and moves[at].get(symbol) == to:
                        moves[at][symbol] = part
                        at = link[at]
            last = new
            ends.append(new)
        self.length, self.link, self.ends = length, link, ends

    def chains(self) -> list[int]:
        """Top state of the heavy chain of links that each state lies on; the root is left out."""
        link, states = self.link, len(self.link)
        deep = sorted(range(1, states), key=self.length.__getitem__, reverse=True)
        size, heavy = [1] * states, [0] * states
        for v in deep:
            size[link[v]] += size[v]
        for v in deep:
            above = link[v]
            if not heavy[above] or size[v] > size[heavy[above]]:
                heavy[above] = v
        top = list(range(states))
        for v in reversed(deep):
            above = link[v]
            if above and heavy[above] == v:
                top[v] = top[above]
        return top


def squares(sequence: list[int]) -> Iterator[tuple[int, int, int]]:
    """(end, period, length): the last ``length`` words up to ``end`` also end a period before; length >= period."""
    automaton = Automaton(sequence)
    length, link, top = automaton.length, automaton.link, automaton.chains()
    # Per chain: (length of the segment's longest substring, where it ended last); the segment next to the root is last.
    colours: list[list[tuple[int, int]] | None] = [None] * len(link)
    for i, v in enumerate(automaton.ends):
        while v > 0:
            head, depth = top[v], length[v]
            stack = colours[head]
            if stack is None:
                colours[head] = [(depth, i)]
            else:
                while stack:
                    longest, end = stack[-1]
                    if i - end <= (longest if longest < depth else depth):
                        yield i, i - end, min(longest, depth)
                    if longest > depth:
                        break
                    stack.pop()
                stack.append((depth, i))
            v = link[head]


def runs(ids: list[int], fewest: int = FEWEST, times: int = TIMES) -> list[Run]:
    """All runs of a sequence, by start, then period."""
    n = len(ids)
    found: dict[tuple[int, int], int] = {}
    for low, high in stretches(ids, fewest, times):
        reach: dict[int, int] = {}
        for end, period, length in squares(ids[low:high]):
            end += low
            if reach.get(period, -1) >= end:
                continue
            first, last = end - period - length + 1, end + 1
            while last < n and ids[last] == ids[last - period]:
                last += 1
            while first > 0 and ids[first - 1] == ids[first - 1 + period]:
                first -= 1
            reach[period] = last - 1
            if last - first >= max(fewest, times * period):
                found[first, last] = min(period, found.get((first, last), period))
    return sorted((first, last - first, period) for (first, last), period in found.items())


def collapsed(words: list[str], found: list[Run]) -> list[str]:
    """Words that are left when every run keeps its first period only."""
    if not found:
        return words
    dropped = bytearray(len(words))
    for first, length, period in found:
        dropped[first + period : first + length] = b"\1" * (length - period)
    return [w for w, d in zip(words, dropped) if not d]


def summary(words: list[str]) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of one text."""
    found = runs(numbered(words)) if len(words) >= FEWEST else []
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    text = " ".join(collapsed(words, found))
    given = (None, None, None, None) if best is None else (*best, 1000 * best[1] // best[2])
    return len(found), *given, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words with the period that a document's id plants in every tenth one, or as they are."""
    if doc_id is None or not words:
        return words
    mark = zlib.crc32(str(doc_id).encode())
    if mark % 10:
        return words
    n, g = len(words), mark // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return words[:start] + [words[start + (i - start) % period] for i in range(start, n)]


FIELDS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
SCHEMA = "doc_id BIGINT, n_runs BIGINT, start BIGINT, length BIGINT, period BIGINT, exponent_milli BIGINT, runs_sha256 STRING, collapsed_sha256 STRING"
_ARROW = pa.schema([("doc_id", pa.int64()), *((name, pa.int64()) for name in FIELDS[:5]), *((name, pa.string()) for name in FIELDS[5:])])


def summaries(docs: DataFrame, change=None) -> DataFrame:
    """One row per document (``SCHEMA``). ``change(words, doc_id)`` may give other words for a text's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for doc_id, text in zip(ids, batch.column(1)):
                words = split(text.as_py())
                rows.append(summary(words if change is None else change(words, doc_id)))
            columns = [pa.array([r[k] for r in rows], _ARROW.field(k + 1).type) for k in range(len(FIELDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=_ARROW)

    return wide_enough(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, SCHEMA)


def runs_of(docs: DataFrame, fewest: int = FEWEST, times: int = TIMES) -> DataFrame:
    """(doc_id, start, length, period): one row per run of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for r in runs(numbered(split(t.as_py())), fewest, times)]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "period"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return wide_enough(texts).mapInArrow(run, "doc_id BIGINT, start BIGINT, length BIGINT, period BIGINT")


def without_runs(docs: DataFrame) -> DataFrame:
    """The documents with every run reduced to its first period; texts without a run keep their layout."""

    @F.pandas_udf("string")
    def reduced(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> str | None:
            words = split(text)
            found = runs(numbered(words)) if len(words) >= FEWEST else []
            return " ".join(collapsed(words, found)) if found else text

        for series in texts:
            yield series.map(one, na_action="ignore")

    return wide_enough(docs).withColumn("text", reduced("text")).select(*docs.columns)
