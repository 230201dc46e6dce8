"""Gradient-boosted trees and isotonic calibration in numpy, for models of a few thousand rows."""

from __future__ import annotations

import numpy as np


class Trees:
    """Binary logistic boosting over histograms; trees are full, of fixed depth."""

    def __init__(self, cuts: list[np.ndarray], feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, base: float):
        self.cuts, self.feature, self.cut, self.leaf, self.base = cuts, feature, cut, leaf, base

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> Trees:
        n, width = x.shape
        share = (y.sum() + 1) / (n + 2)
        base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        code = np.column_stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)])
        margin = np.full(n, base)
        inner = (1 << depth) - 1
        feature, cut, leaf = np.zeros((rounds, inner), int), np.full((rounds, inner), bins, int), np.zeros((rounds, 1 << depth))
        for r in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, int)
            for level in range(depth):
                count, first = 1 << level, (1 << level) - 1
                best = np.full(count, 1e-6)
                for f in range(width):
                    at = node * (bins + 1) + code[:, f]
                    gs = np.bincount(at, g, count * (bins + 1)).reshape(count, -1).cumsum(1)
                    hs = np.bincount(at, h, count * (bins + 1)).reshape(count, -1).cumsum(1)
                    gain = gs**2 / (hs + ridge) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                    k = gain.argmax(1)
                    top = gain[np.arange(count), k]
                    for i in np.flatnonzero(top > best + 1e-9).tolist():
                        best[i], feature[r, first + i], cut[r, first + i] = top[i], f, k[i]
                node = 2 * node + (code[np.arange(n), feature[r, first + node]] > cut[r, first + node])
            leaf[r] = -rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + ridge)
            margin += leaf[r][node]
        return cls(cuts, feature, cut, leaf, base)

    def margin(self, x: np.ndarray) -> np.ndarray:
        code = np.column_stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)]) if len(x) else np.zeros((0, len(self.cuts)), int)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            while (node < len(feature)).all() and len(x):
                node = 2 * node + 1 + (code[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)] if len(x) else 0
        return out


class Isotonic:
    """The best rising step function from margins to probabilities, between its steps linear."""

    def __init__(self, at: np.ndarray, value: np.ndarray):
        self.at, self.value = at, value

    @classmethod
    def fit(cls, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []  # sum of y, weight, least and greatest margin
        for m, t in zip(margin[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([t, 1.0, m, m])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                top = blocks.pop()
                blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], blocks[-1][2], top[3]]
        at = np.array([m for b in blocks for m in b[2:]])
        value = np.array([b[0] / b[1] for b in blocks for _ in range(2)])
        return cls(at, value)

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.full(len(margin), 0.5)
        # A little of the margin keeps the order of scores within a step.
        return 0.98 * np.interp(margin, self.at, self.value) + 0.02 / (1 + np.exp(-np.clip(margin, -500, 500)))
