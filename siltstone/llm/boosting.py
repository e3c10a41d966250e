"""Gradient-boosted trees with histograms, and isotonic regression, for bounded samples on the driver."""

from __future__ import annotations

import numpy as np

from siltstone.llm.common import sigmoid


class Trees:
    """Logistic boosting: complete trees of `depth` levels over quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1) if n else np.zeros((0, width), dtype=int)
        share = float(np.clip(y.mean() if n else 0.5, 1e-4, 1 - 1e-4))
        self.base = float(np.log(share / (1 - share)))
        if not n or y.min() == y.max():
            return self
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = sigmoid(score)
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node, feature, cut = np.zeros(n, dtype=int), [], []
            for level in range(self.depth):
                count = 1 << level
                best, at = np.full(count, 1e-9), np.full((count, 2), -1)
                for f, e in enumerate(self.edges):
                    slots = len(e) + 1
                    key = node * slots + binned[:, f]
                    gs = np.bincount(key, g, count * slots).reshape(count, slots).cumsum(1)
                    hs = np.bincount(key, h, count * slots).reshape(count, slots).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    if not gl.size:
                        continue
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hl < self.least / 10) | (ht - hl < self.least / 10)] = 0
                    top = gain.argmax(1)
                    value = gain[np.arange(count), top]
                    for k in np.flatnonzero(value > best):
                        best[k], at[k] = value[k], (f, top[k])
                feature.append([int(a[0]) for a in at])
                cut.append([float(self.edges[a[0]][a[1]]) if a[0] >= 0 else np.inf for a in at])
                right = np.zeros(n, dtype=int)
                for k, (f, c) in enumerate(at):
                    if f >= 0:
                        mine = node == k
                        right[mine] = binned[mine, f] > c
                node = 2 * node + right
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.l2)
            score += value[node]
            self.trees.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=int)
            for f, c in zip(feature, cut):
                node = 2 * node + (x[np.arange(len(x)), np.maximum(np.array(f)[node], 0)] > np.array(c)[node])
            score += value[node]
        return sigmoid(score)


class Isotonic:
    """Pool adjacent violators; predictions are interpolated between the pools."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []  # sum of y, weight, first x, last x
        for a, b in zip(x[order], y[order]):
            pools.append([float(b), 1.0, float(a), float(a)])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                s, w, _, last = pools.pop()
                pools[-1] = [pools[-1][0] + s, pools[-1][1] + w, pools[-1][2], last]
        self.x = np.array([v for p in pools for v in p[2:]]) if pools else np.array([0.0, 1.0])
        self.y = np.array([p[0] / p[1] for p in pools for _ in range(2)]) if pools else np.array([0.0, 1.0])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(x, self.x, self.y), 0.0, 1.0)
