"""Gradient-boosted regression trees for yes/no labels, on numpy, with histogram splits."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, trees of fixed depth stored as heap-ordered arrays."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 16, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        margin, self.trees = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature = np.zeros(2**self.depth - 1, np.int64)
            cut = np.full(2**self.depth - 1, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    own = node == k
                    if (best := self._split(binned[own], g[own], h[own])) is not None:
                        feature[k], cut[k] = best[0], edges[best[0]][best[1]]
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            margin += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def _split(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        best, found = 1e-6, None
        if len(g) < 2:
            return None
        whole = g.sum() ** 2 / (h.sum() + self.l2)
        for f in range(binned.shape[1]):
            n = int(binned[:, f].max()) + 1
            gl, hl = np.cumsum(np.bincount(binned[:, f], g, n)), np.cumsum(np.bincount(binned[:, f], h, n))
            gain = (gl**2 / (hl + self.l2) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + self.l2) - whole)[:-1]
            if len(gain) and gain.max() > best:
                best, found = gain.max(), (f, int(gain.argmax()))
        return found

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of yes for each row."""
        margin, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            margin += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-margin))
