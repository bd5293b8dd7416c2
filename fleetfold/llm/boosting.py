"""Gradient-boosted trees for a yes/no target, grown level by level over binned features."""

from __future__ import annotations

import numpy as np

BINS = 32


def edges(x: np.ndarray) -> np.ndarray:
    """Bin borders of every feature (features x BINS - 1)."""
    return np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()


def binned(x: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(b, c, side="left") for b, c in zip(borders, x.T)], axis=1).astype(np.int64)


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 5, rate: float = 0.25, penalty: float = 1.0) -> dict:
    """{"features", "cuts", "leaves"}: complete trees; a row goes right where its value is above the cut."""
    borders = edges(x)
    b = binned(x, borders)
    n, width = b.shape
    total = np.zeros(n)
    out = {"features": np.zeros((trees, 2**depth - 1), np.int64), "cuts": np.full((trees, 2**depth - 1), np.inf), "leaves": np.zeros((trees, 2**depth))}
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            count, first = 2**level, 2**level - 1
            best = np.full(count, 1e-6)
            for f in range(width):
                key = node * BINS + b[:, f]
                sg = np.cumsum(np.bincount(key, g, count * BINS).reshape(count, BINS), axis=1)
                sh = np.cumsum(np.bincount(key, h, count * BINS).reshape(count, BINS), axis=1)
                left, right = sg[:, :-1], sg[:, -1:] - sg[:, :-1]
                lh, rh = sh[:, :-1], sh[:, -1:] - sh[:, :-1]
                gain = left**2 / (lh + penalty) + right**2 / (rh + penalty) - sg[:, -1:] ** 2 / (sh[:, -1:] + penalty)
                cut = gain.argmax(axis=1)
                top = gain[np.arange(count), cut]
                for k in np.flatnonzero(top > best):
                    best[k] = top[k]
                    out["features"][t, first + k] = f
                    out["cuts"][t, first + k] = borders[f, cut[k]]
            node = 2 * node + (x[np.arange(n), out["features"][t, first + node]] > out["cuts"][t, first + node])
        sums, weights = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
        out["leaves"][t] = rate * sums / (weights + penalty)
        total += out["leaves"][t][node]
    return out


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    total, rows = np.zeros(len(x)), np.arange(len(x))
    depth = model["leaves"].shape[1].bit_length() - 1
    for features, cuts, leaves in zip(model["features"], model["cuts"], model["leaves"]):
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            at = 2**level - 1 + node
            node = 2 * node + (x[rows, features[at]] > cuts[at])
        total += leaves[node]
    return total
