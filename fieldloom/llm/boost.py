"""Gradient-boosted trees for two classes, on binned features, with NumPy alone.

Small and deterministic: trees of a fixed depth, logistic loss, second-order gains.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """``feature`` and ``threshold`` have a row for each tree and its inner nodes, ``value`` its leaves."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base
        self.depth = int(np.log2(value.shape[1])) if len(value) else 0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, smooth: float = 1.0) -> "BoostedTrees":
        weight = np.ones(len(y)) if weight is None else weight
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), base)
        features, thresholds, values = [], [], []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-9)
            node = np.zeros(len(y), np.int64)
            feature, threshold = np.zeros((1 << depth) - 1, np.int32), np.full((1 << depth) - 1, np.inf)
            for level in range(depth):
                n = 1 << level
                best, pick = np.full(n, 1e-6), [(0, np.inf, bins)] * n
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue
                    key, width = node * bins + binned[:, f], n * bins
                    gs = np.cumsum(np.bincount(key, g, width).reshape(n, bins), 1)
                    hs = np.cumsum(np.bincount(key, h, width).reshape(n, bins), 1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + smooth) + (gt - gs) ** 2 / (ht - hs + smooth) - gt**2 / (ht + smooth)
                    at = gain[:, : len(cuts[f])].argmax(1)
                    top = gain[np.arange(n), at]
                    for i in np.flatnonzero(top > best):
                        best[i], pick[i] = top[i], (f, cuts[f][at[i]], at[i])
                for i, (f, t, _) in enumerate(pick):
                    feature[n - 1 + i], threshold[n - 1 + i] = f, t
                split = np.array([(f, b) for f, _, b in pick])
                node = node * 2 + (binned[np.arange(len(y)), split[node, 0]] > split[node, 1])
            leaf = -rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + smooth)
            margin += leaf[node]
            features.append(feature)
            thresholds.append(threshold)
            values.append(leaf)
        return cls(np.array(features), np.array(thresholds), np.array(values), base)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (len(value) - 1)]
        return out
