"""Gradient-boosted regression trees for a yes/no target, in numpy, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, BINS, RATE, LEAST, L2 = 80, 4, 32, 0.2, 4.0, 1.0


@dataclass
class Trees:
    edges: list[np.ndarray]
    feature: np.ndarray  # of each tree's inner nodes, in heap order
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(self.edges)), dtype=np.uint8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        bins, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (bins[rows, f[at]] > c[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    inner = 2**DEPTH - 1
    model = Trees(edges, np.zeros((TREES, inner), dtype=np.int64), np.full((TREES, inner), 255), np.zeros((TREES, inner + 1)), base)
    bins = model.binned(x)
    score = np.full(len(x), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(len(x), dtype=np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            g0, h0 = (np.bincount(at - first, v, width) for v in (grad, hess))
            for j in range(x.shape[1]):
                key = (at - first) * BINS + bins[:, j]
                g, h = (np.bincount(key, v, width * BINS).reshape(width, BINS).cumsum(axis=1)[:, :-1] for v in (grad, hess))
                gr, hr = g0[:, None] - g, h0[:, None] - h
                gain = g**2 / (h + L2) + gr**2 / (hr + L2) - (g0**2 / (h0 + L2))[:, None]
                gain[(h < LEAST / 4) | (hr < LEAST / 4)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                model.feature[t, first : first + width][better] = j
                model.cut[t, first : first + width][better] = top[better]
            at = 2 * at + 1 + (bins[np.arange(len(x)), model.feature[t, at]] > model.cut[t, at])
        end = at - inner
        model.leaf[t] = RATE * np.bincount(end, grad, inner + 1) / (np.bincount(end, hess, inner + 1) + L2)
        score += model.leaf[t][end]
    return model
