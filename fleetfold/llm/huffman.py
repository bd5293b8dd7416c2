"""Canonical length-limited Huffman codes over token ids, packed and unpacked by whole arrays."""

from __future__ import annotations

import numpy as np

LIMIT = 20  # room for a vocabulary of rare ids beside short codes; the decoding table has 2**LIMIT rows
STEP = 256  # ids between two checkpoints


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, 0 for ids that do not occur (package-merge).

    At each level pairs of the cheapest packages become packages of the next; a symbol's length is the
    number of levels at which it is among the 2n - 2 cheapest. Ties go to the smaller id.
    """
    symbols = np.flatnonzero(counts)
    n = len(symbols)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if n < 2:
        lengths[symbols] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    weights = counts[order].astype(np.int64)
    # For every level, which entries of the sorted list are single symbols.
    levels, packages = [], np.empty(0, dtype=np.int64)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    take = 2 * n - 2
    for single in reversed(levels):
        chosen = single[:take]
        used = int(chosen.sum())
        lengths[order[:used]] += 1
        take = 2 * (len(chosen) - used)
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: shorter first, then by id."""
    out = np.zeros(len(lengths), dtype=np.uint32)
    code, last = 0, 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == bits)
        code <<= bits - last
        last = bits
        out[ids] = code + np.arange(len(ids), dtype=np.uint32)
        code += len(ids)
    return out


def table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For the next ``limit`` bits: the id they start with and the bits it takes."""
    ids, bits = np.zeros(1 << limit, dtype=np.uint32), np.ones(1 << limit, dtype=np.uint8)
    known = codes(lengths)
    for length in range(1, limit + 1):
        these = np.flatnonzero(lengths == length)
        if len(these):
            begin = int(known[these[0]]) << (limit - length)
            span = 1 << (limit - length)
            ids[begin : begin + span * len(these)] = np.repeat(these, span)
            bits[begin : begin + span * len(these)] = length
    return ids, bits


def pack(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, known: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Code runs of ids, each from a byte border: the bytes, each run's first byte (and the end), and
    for every ``step`` ids of a run the bit at which they start, counted from the run's first."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    total = np.concatenate([[0], end])
    bits = total[first[1:]] - total[first[:-1]]
    begin = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    run = np.repeat(np.arange(len(counts)), counts)
    at = total[:-1] - total[first[:-1]][run] + begin[:-1][run] * 8
    value = known[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    word = at >> 5
    n = int((begin[-1] + 3) // 4 + 2)
    # The bits of different ids never overlap, so sums below 2**32 are exact in a double.
    packed = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    marks = np.arange(len(ids)) - first[:-1][run]
    chosen = np.flatnonzero(marks % step == 0)
    return packed.astype(">u4").tobytes(), begin, at[chosen] - begin[:-1][run[chosen]] * 8


def unpack(data: bytes, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, bits: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Ids of segments that start at the given bits, ``sizes`` ids each, all segments side by side."""
    raw = np.frombuffer(data + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.empty(int(sizes.sum()), dtype=np.uint32)
    order = np.argsort(-sizes, kind="stable")
    at, target = starts[order].copy(), (np.cumsum(sizes) - sizes)[order]
    descending = -sizes[order]
    for k in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(descending, -k, side="left"))
        at, target = at[:live], target[:live]
        key = (window[at >> 3] >> (32 - limit - (at & 7)).astype(np.uint32)) & ((1 << limit) - 1)
        out[target + k] = ids[key]
        at = at + bits[key]
    return out
