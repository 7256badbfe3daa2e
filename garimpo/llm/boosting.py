"""Gradient boosted trees for small feature tables, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic gradient boosting with depth-limited trees over quantile bins.

    After the fit the margins are calibrated (Platt) on held-out rows and the decision
    threshold is the one with the best F1 there.
    """

    def __init__(self, trees: int = 40, depth: int = 2, rate: float = 0.2, bins: int = 32, least: float = 1.0, pull: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.pull = trees, depth, rate, bins, least, pull
        self.edges: list[np.ndarray] = []
        self.nodes: list[list[tuple]] = []
        self.base, self.scale, self.shift, self.threshold = 0.0, 1.0, 0.0, 0.5

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> tuple:
        leaf = ("leaf", float(g[rows].sum() / (h[rows].sum() + self.pull)) * self.rate)
        if depth == 0 or h[rows].sum() < 2 * self.least:
            return leaf
        best = (1e-6, None, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f in range(binned.shape[1]):
            n = len(self.edges[f]) + 1
            gg = np.cumsum(np.bincount(binned[rows, f], g[rows], n))[:-1]
            hh = np.cumsum(np.bincount(binned[rows, f], h[rows], n))[:-1]
            k = self.pull
            gain = gg**2 / (hh + k) + (total_g - gg) ** 2 / (total_h - hh + k) - total_g**2 / (total_h + k)
            gain[(hh < self.least) | (total_h - hh < self.least)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
        if best[1] is None:
            return leaf
        left = binned[rows, best[1]] <= best[2]
        return ("split", best[1], best[2], self._grow(binned, g, h, rows[left], depth - 1), self._grow(binned, g, h, rows[~left], depth - 1))

    @staticmethod
    def _walk(node: tuple, binned: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if node[0] == "leaf":
            out[rows] += node[1]
            return
        left = binned[rows, node[1]] <= node[2]
        BoostedTrees._walk(node[3], binned, rows[left], out)
        BoostedTrees._walk(node[4], binned, rows[~left], out)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if len(x) and self.edges:
            binned = self._binned(x)
            rows = np.arange(len(x))
            for tree in self.nodes:
                self._walk(tree, binned, rows, out)
        return out

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.margin(x) + self.shift)))

    def fit(self, x: np.ndarray, y: np.ndarray, held_out: np.ndarray) -> BoostedTrees:
        """x: features, y: 0 or 1, held_out: mask of the rows kept for calibration."""
        if len(y) == 0 or y.min() == y.max():
            self.base = 4.0 if len(y) and y.max() == 1 else -4.0
            return self
        xt, yt = x[~held_out], y[~held_out].astype(float)
        if not len(yt) or yt.min() == yt.max():
            xt, yt = x, y.astype(float)
        self.edges = [np.unique(np.quantile(np.unique(xt[:, f]), np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(xt.shape[1])]
        binned, rows = self._binned(xt), np.arange(len(yt))
        rate = np.clip(yt.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(yt), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, yt - p, p * (1 - p), rows, self.depth)
            self.nodes.append(tree)
            self._walk(tree, binned, rows, score)
        self._calibrate(self.margin(x[held_out]), y[held_out].astype(float))
        return self

    def _calibrate(self, margin: np.ndarray, y: np.ndarray) -> None:
        if len(y) < 20 or y.min() == y.max():
            return
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps, with one smoothed case of either kind
            p = 1 / (1 + np.exp(-(a * margin + b)))
            target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
            w = p * (1 - p) + 1e-9
            grad = np.array([((p - target) * margin).sum(), (p - target).sum()])
            hess = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.scale, self.shift = float(max(a, 1e-3)), float(b)
        p = 1 / (1 + np.exp(-(self.scale * margin + self.shift)))
        cuts = np.unique(np.round(np.concatenate([p, [0.5]]), 3))
        f1 = [2 * ((p >= c) & (y == 1)).sum() / max(1, (p >= c).sum() + y.sum()) for c in cuts]
        best = np.flatnonzero(np.isclose(f1, max(f1)))
        self.threshold = float(np.clip((cuts[best[0]] + cuts[best[-1]]) / 2, 0.05, 0.95))
