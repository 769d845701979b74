"""Histogram gradient-boosted trees for two classes, flattened into arrays for vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Options:
    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    least: float = 5.0
    ridge: float = 1.0


class Boosted:
    """Complete trees of one depth. feature and limit: (trees, inner nodes); value: (trees, leaves)."""

    def __init__(self, base: float, feature: np.ndarray, limit: np.ndarray, value: np.ndarray) -> None:
        self.base, self.feature, self.limit, self.value = base, feature, limit, value

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row; all rows go down a tree at once."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            total += value[at - (len(value) - 1)]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, options: Options = Options()) -> Boosted:
    """Logistic loss, second order. One class or no rows: a constant."""
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(rate / (1 - rate)))
    inner, leaves = 2**options.depth - 1, 2**options.depth
    if len(y) == 0 or y.min() == y.max():
        return Boosted(base, np.empty((0, inner), np.int64), np.empty((0, inner)), np.empty((0, leaves)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, options.bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)])
    total = np.full(len(y), base)
    features, limits, values = [], [], []
    for _ in range(options.trees):
        p = 1.0 / (1.0 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(options.depth):
            first, count = 2**level - 1, 2**level
            node = at - first
            best = np.zeros(count)
            cut = np.full(count, -1)
            split = np.zeros(count, np.int64)
            for f in range(len(binned)):
                slots = node * options.bins + binned[f]
                g = np.bincount(slots, grad, count * options.bins).reshape(count, -1).cumsum(axis=1)
                h = np.bincount(slots, hess, count * options.bins).reshape(count, -1).cumsum(axis=1)
                gain = g**2 / (h + options.ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + options.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + options.ridge)
                gain[(h < options.least / 4) | (h[:, -1:] - h < options.least / 4)] = 0
                gain[:, len(edges[f]) :] = 0
                at_bin = gain.argmax(axis=1)
                better = gain[np.arange(count), at_bin] > best + 1e-9
                best[better], cut[better], split[better] = gain[np.arange(count), at_bin][better], at_bin[better], f
            right = np.zeros(len(y), bool)
            for k in np.flatnonzero(cut >= 0):
                feature[first + k], limit[first + k] = split[k], edges[split[k]][cut[k]]
                own = node == k
                right[own] = binned[split[k]][own] > cut[k]
            at = 2 * at + 1 + right
        leaf = at - inner
        value = -options.rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + options.ridge)
        total += value[leaf]
        features.append(feature)
        limits.append(limit)
        values.append(value)
    return Boosted(base, np.array(features), np.array(limits), np.array(values))
