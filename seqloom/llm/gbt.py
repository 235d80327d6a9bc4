"""Gradient-boosted regression trees for two classes (logistic loss, histogram splits), in numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete trees of a fixed depth: feature and threshold per inner node, a value per leaf."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # code > k  <=>  x > edges[k]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        z = np.full(n, self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-z))
            g, h = y - q, q * (1 - q)
            at = np.zeros(n, np.int64)
            feature, cut = [], []
            for level in range(self.depth):
                k = 1 << level
                best = np.full(k, 1e-9)
                f, c = np.zeros(k, np.int64), np.full(k, np.inf)
                for j in range(m):
                    if not len(edges[j]):
                        continue
                    b = self.bins + 1
                    cell = at * b + code[:, j]
                    gl = np.bincount(cell, g, k * b).reshape(k, b).cumsum(1)
                    hl = np.bincount(cell, h, k * b).reshape(k, b).cumsum(1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain = gain[:, : len(edges[j])]
                    i = gain.argmax(1)
                    top = gain[np.arange(k), i]
                    better = top > best
                    best[better], f[better], c[better] = top[better], j, edges[j][i[better]]
                feature.append(f)
                cut.append(c)
                at = 2 * at + (x[np.arange(n), f[at]] > c[at])
            leaf = self.rate * np.bincount(at, g, 1 << self.depth) / (np.bincount(at, h, 1 << self.depth) + self.l2)
            z += leaf[at]
            self.trees.append((feature, cut, leaf))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        rows, z = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for f, c in zip(feature, cut):
                at = 2 * at + (x[rows, f[at]] > c[at])
            z += leaf[at]
        return z
