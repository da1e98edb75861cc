"""Gradient-boosted trees for a yes-or-no label, on histograms."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of one depth: split features and thresholds by node, values by leaf."""

    def __init__(self, base: float, features: np.ndarray, thresholds: np.ndarray, values: np.ndarray):
        self.base, self.features, self.thresholds, self.values = base, features, thresholds, values

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of features."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.values.shape[1]))
        for f, t, v in zip(self.features, self.thresholds, self.values):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (len(v) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> BoostedTrees:
    """Fit to rows x and labels y (0 or 1)."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)
    rate_of_ones = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    score = np.full(n, base)
    inner = (1 << depth) - 1
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = node - first
            best = np.full(width, 1e-6)
            total_g, total_h = np.bincount(local, g, width), np.bincount(local, h, width)
            whole = total_g**2 / (total_h + ridge)
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                size = len(c) + 1
                at = local * size + binned[:, k]
                left_g = np.bincount(at, g, width * size).reshape(width, size).cumsum(1)[:, :-1]
                left_h = np.bincount(at, h, width * size).reshape(width, size).cumsum(1)[:, :-1]
                gain = left_g**2 / (left_h + ridge) + (total_g[:, None] - left_g) ** 2 / (total_h[:, None] - left_h + ridge) - whole[:, None]
                pick = gain.argmax(1)
                better = gain[np.arange(width), pick] > best
                best[better] = gain[better, pick[better]]
                features[t, first : first + width][better] = k
                thresholds[t, first : first + width][better] = c[pick[better]]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        values[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        score += values[t, leaf]
    return BoostedTrees(base, features, thresholds, values)
