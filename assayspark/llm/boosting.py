"""Histogram gradient-boosted trees for two classes, kept as flat arrays.

Training takes a bounded matrix; prediction walks all rows of a block through a tree at once.
Trees are complete: node i has children 2i + 1 and 2i + 2, and a node that is not split sends
every row to the left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Arrays of shape (trees, nodes): feature and threshold of the inner nodes, value of the leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def cut_points(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each feature up to ``bins - 1`` different quantiles."""
    want = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, j], want, method="lower")) if len(x) else np.zeros(0) for j in range(x.shape[1])]


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 5.0, least: float = 5.0,
) -> Forest:
    """Boosting on the logistic loss. One class only, or no rows, gives a constant score."""
    n, width = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = float(np.clip(y.mean() if n else 0.5, 1e-4, 1 - 1e-4))
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    cuts = cut_points(x, bins)
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.int64)
    offset = np.arange(width) * bins
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            slot = ((node - first)[:, None] * (width * bins) + offset + binned).ravel()
            gs = np.bincount(slot, np.repeat(g, width), count * width * bins).reshape(count, width, bins).cumsum(axis=2)
            hs = np.bincount(slot, np.repeat(h, width), count * width * bins).reshape(count, width, bins).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + smooth) + (gt - gs) ** 2 / (ht - hs + smooth) - gt**2 / (ht + smooth)
            gain[(hs < least / 4) | (ht - hs < least / 4)] = 0
            for k in range(count):
                j, b = np.unravel_index(np.argmax(gain[k]), (width, bins))
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + smooth)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), base)
