"""Gradient-boosted trees for a two-class log loss, in numpy; small enough for the driver."""

from __future__ import annotations

import numpy as np


class Trees:
    """Depth-limited trees on binned features; :meth:`predict` gives probabilities."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[list[tuple[int, int, float]]] = []

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins)[1:-1])) for f in range(x.shape[1])]
        b = self._bin(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node, tree = np.zeros(len(y), int), [(-1, 0, 0.0)] * (2 ** (self.depth + 1) - 1)
            for level in range(self.depth + 1):
                for n in range(2**level - 1, 2 ** (level + 1) - 1):
                    at = np.flatnonzero(node == n)
                    if not len(at):
                        continue
                    total_g, total_h = g[at].sum(), h[at].sum()
                    tree[n] = (-1, 0, self.rate * total_g / (total_h + self.ridge))
                    if level == self.depth or len(at) < 2 * self.least:
                        continue
                    best = (1e-6, -1, 0)
                    for f in range(x.shape[1]):
                        k = len(self.edges[f]) + 1
                        sg, sh, sn = (np.cumsum(np.bincount(b[at, f], w, k))[:-1] for w in (g[at], h[at], None))
                        gain = sg**2 / (sh + self.ridge) + (total_g - sg) ** 2 / (total_h - sh + self.ridge) - total_g**2 / (total_h + self.ridge)
                        gain[(sn < self.least) | (len(at) - sn < self.least)] = 0
                        if len(gain) and gain.max() > best[0]:
                            best = (gain.max(), f, int(gain.argmax()))
                    if best[1] >= 0:
                        tree[n] = (best[1], best[2], tree[n][2])
                        node[at] = 2 * n + 1 + (b[at, best[1]] > best[2])
            self.trees.append(tree)
            score += self._one(tree, b)
        return self

    def _one(self, tree: list[tuple[int, int, float]], b: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(c) for c in zip(*tree))
        node = np.zeros(len(b), int)
        for _ in range(self.depth):
            f = feature[node]
            inner = f >= 0
            node = np.where(inner, 2 * node + 1 + (b[np.arange(len(b)), np.maximum(f, 0)] > cut[node]), node)
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self._bin(x)
        return 1 / (1 + np.exp(-(self.base + sum(self._one(t, b) for t in self.trees))))
