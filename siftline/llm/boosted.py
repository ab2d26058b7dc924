"""Gradient-boosted trees for two classes, in numpy, with held-out calibration."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth over quantile bins, fitted to the logistic loss by second-order steps."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.25, cuts: int = 16, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.cuts, self.ridge = rounds, depth, rate, cuts, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = np.linspace(0, 1, self.cuts + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], edges)) for j in range(x.shape[1])]
        binned = self._bins(x)
        rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(rate / (1 - rate)))
        score, self.trees = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.cuts, np.int64)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                for k in range(2**level):
                    at = np.flatnonzero(node == k)
                    if len(at) < 2:
                        continue
                    best = 0.0
                    whole = g[at].sum() ** 2 / (h[at].sum() + self.ridge)
                    for j in range(x.shape[1]):
                        gs = np.cumsum(np.bincount(binned[at, j], g[at], self.cuts + 1))
                        hs = np.cumsum(np.bincount(binned[at, j], h[at], self.cuts + 1))
                        gain = gs**2 / (hs + self.ridge) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + self.ridge) - whole
                        if gain[:-1].max() > best + 1e-9:
                            best, feature[2**level - 1 + k], cut[2**level - 1 + k] = gain[:-1].max(), j, int(gain[:-1].argmax())
                slot = 2**level - 1 + node
                node = 2 * node + (binned[np.arange(len(y)), feature[slot]] > cut[slot])
            leaf = -np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.ridge) * self.rate
            score += leaf[node]
            self.trees.append((feature, cut, leaf))
        return self

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        binned, total, row = self._bins(x), np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                slot = 2**level - 1 + node
                node = 2 * node + (binned[row, feature[slot]] > cut[slot])
            total += leaf[node]
        return total


def calibrate(score: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift that turn held-out scores into probabilities (Platt's method)."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * score + b)))
        g = np.array([((p - y) * score).sum() + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * b])
        w = p * (1 - p)
        hess = np.array([[(w * score**2).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(hess + 1e-6 * np.eye(2), g)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(a), float(b)


def threshold_for(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability from which on held-out precision is high enough; 1.01 (nothing passes) if none is."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    ok = hits / np.arange(1, len(y) + 1) >= precision
    last = np.flatnonzero(ok & np.append(p[order][1:] < p[order][:-1], True))
    return float(p[order][last[-1]]) if len(last) else 1.01
