"""Gradient-boosted trees for a yes-or-no target, in numpy: logistic loss, depth-limited trees
grown on binned features, Newton leaf values, and a threshold calibrated on held-out rows."""

from __future__ import annotations

import numpy as np


class Boosted:
    """An ensemble of complete binary trees: per tree a feature and cut per inner node and a value per leaf."""

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.25, l2: float = 1.0) -> None:
        self.depth, self.rounds, self.rate, self.l2 = depth, rounds, rate, l2
        self.base, self.threshold = 0.0, 0.5
        self.feature = np.zeros((0, 0), np.int64)
        self.cut = np.zeros((0, 0))
        self.value = np.zeros((0, 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature, self.cut, self.value = np.zeros((self.rounds, inner), np.int64), np.full((self.rounds, inner), np.inf), np.zeros((self.rounds, leaves))
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.base)
        grid = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)))[:-1] for j in range(m)]
        # bins of all features laid end to end; a value is at most cut k of its feature if its bin is at most k
        first = np.cumsum([0, *(len(c) + 1 for c in grid)])
        bins = np.stack([np.searchsorted(c, x[:, j], "left") + first[j] for j, c in enumerate(grid)], axis=1)
        feature_of = np.repeat(np.arange(m), np.diff(first))
        is_cut = np.ones(first[-1], bool)
        is_cut[first[1:] - 1] = False
        cuts = np.concatenate([np.r_[c, np.inf] for c in grid])
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                for k in range(2**level):
                    at = np.flatnonzero(node == k)
                    spot = 2**level - 1 + k
                    if len(at) < 8:
                        continue
                    gs, hs = g[at].sum(), h[at].sum()
                    flat = bins[at].ravel()
                    gl, hl = (np.cumsum(np.bincount(flat, np.repeat(v[at], m), first[-1])) for v in (g, h))
                    gl, hl = (v - np.r_[0.0, v][first[:-1]][feature_of] for v in (gl, hl))
                    gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                    gain = np.where(is_cut & (hl >= 0.2) & (hs - hl >= 0.2), np.round(gain, 9), -np.inf)
                    k_best = int(np.argmax(gain))
                    if gain[k_best] > 1e-6:
                        self.feature[t, spot], self.cut[t, spot] = feature_of[k_best], cuts[k_best]
                spots = 2**level - 1 + node
                node = node * 2 + (x[np.arange(n), self.feature[t, spots]] > self.cut[t, spots])
            for leaf in range(leaves):
                at = node == leaf
                if at.any():
                    self.value[t, leaf] = self.rate * g[at].sum() / (h[at].sum() + self.l2)
            score += self.value[t, node]
        return self

    def chance(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.value)):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                spots = 2**level - 1 + node
                node = node * 2 + (x[rows, self.feature[t, spots]] > self.cut[t, spots])
            score += self.value[t, node]
        return 1 / (1 + np.exp(-score))

    def calibrate(self, x: np.ndarray, y: np.ndarray, rare: float = 1.0) -> Boosted:
        """The threshold of the greatest F1 on held-out rows, in the middle of the best range; a
        positive is taken to be `rare` times as rare among the negatives as it is in these rows."""
        p = self.chance(x)
        best = -1.0
        runs: list[float] = []
        for c in np.linspace(0.02, 0.98, 97):
            hit = (p >= c) & (y > 0)
            f1 = 2 * hit.sum() / max(1, hit.sum() + rare * ((p >= c) & (y <= 0)).sum() + (y > 0).sum())
            if f1 > best + 1e-9:
                best, runs = f1, [float(c)]
            elif abs(f1 - best) <= 1e-9:
                runs.append(float(c))
        self.threshold = runs[len(runs) // 2]
        return self
