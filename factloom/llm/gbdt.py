"""Histogram gradient-boosted trees for two classes, in numpy, flattened into arrays.

fit() bins each feature by quantiles, and grows trees of one fixed depth level by
level from per-node histograms of gradients. A tree is a row of the arrays
``feature``, ``threshold`` (inner nodes, heap order) and ``leaf``; predict()
steps all rows through all trees together, a level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    base: float
    feature: np.ndarray  # int, trees x inner nodes
    threshold: np.ndarray  # float, trees x inner nodes; go right if x > threshold
    leaf: np.ndarray  # float, trees x leaves

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        turn, rows = np.arange(trees), np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (x[rows, self.feature[turn, at]] > self.threshold[turn, at])
        raw = self.base + self.leaf[turn, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 5) -> Trees:
    """Without rows, or with one class, the trees are empty and the base is the smoothed share of class 1."""
    n, width = x.shape
    share = (float(y.sum()) + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if n == 0 or y.min() == y.max():
        return Trees(base, feature, threshold, leaf)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    cell = binned + np.arange(width) * bins
    raw = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            flat = ((at - first)[:, None] * (width * bins) + cell).ravel()
            shape = (nodes, width, bins)
            gs, hs, cs = (np.bincount(flat, np.repeat(v, width), nodes * width * bins).reshape(shape).cumsum(axis=2) for v in (g, h, np.ones(n)))
            left_g, left_h, left_c = gs[..., :-1], hs[..., :-1], cs[..., :-1]
            all_g, all_h, all_c = gs[..., -1:], hs[..., -1:], cs[..., -1:]
            gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
            gain = np.where((left_c >= least) & (all_c - left_c >= least), gain, 0).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            for node in range(nodes):
                f, b = divmod(int(best[node]), bins - 1)
                if gain[node, best[node]] > 1e-9 and b < len(edges[f]):
                    feature[t, first + node], threshold[t, first + node] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        at -= inner
        leaf[t] = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        raw += leaf[t, at]
    return Trees(base, feature, threshold, leaf)
