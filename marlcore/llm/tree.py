"""A small decision tree (Gini impurity) for tables that fit in memory."""

from __future__ import annotations

import numpy as np


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 6, leaf: int = 1) -> tuple:
    """Nested (feature, threshold, left, right); a leaf is (share of label 1,).  Ties go to the earlier feature."""
    if depth == 0 or y.min() == y.max():
        return (float(y.mean()),)
    best = None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, ones = x[order, j], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
        cost = n * left * (1 - left) + (len(y) - n) * right * (1 - right)
        cost[(v[1:] == v[:-1]) | (n < leaf) | (len(y) - n < leaf)] = np.inf
        k = int(np.argmin(cost))
        if np.isfinite(cost[k]) and (best is None or cost[k] < best[0] - 1e-12):
            best = (cost[k], j, (v[k] + v[k + 1]) / 2)
    if best is None:
        return (float(y.mean()),)
    _, j, t = best
    low = x[:, j] <= t
    return (j, float(t), fit_tree(x[low], y[low], depth - 1, leaf), fit_tree(x[~low], y[~low], depth - 1, leaf))


def predict(tree: tuple, row) -> float:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]
