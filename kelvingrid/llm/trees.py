"""Gradient-boosted trees on a bounded sample of dense rows, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Boosted:
    """Trees of one depth as complete arrays: a row goes right where its value is above the threshold."""

    start: float = 0.0
    columns: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for column, threshold, leaf in zip(self.columns, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(x) and node[0] < len(column):  # all rows are on one level
                node = 2 * node + 1 + (x[rows, column[node]] > threshold[node])
            out += leaf[node - len(column)] if len(x) else 0.0
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Boosted:
    """Newton boosting for the logistic loss, splits found on histograms of the columns' quantiles."""
    n, m = x.shape
    rate_of_ones = np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3)
    model = Boosted(start=float(np.log(rate_of_ones / (1 - rate_of_ones))))
    if not n or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(n, model.start)
    inner = (1 << depth) - 1
    for _ in range(rounds):
        p = sigmoid(raw)
        g, h = y - p, p * (1 - p)
        column, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            base, width = (1 << level) - 1, 1 << level
            best = np.zeros(width)
            cut = np.zeros(width, dtype=np.int64)
            for j in range(m):
                key = (node - base) * BINS + binned[:, j]
                gs = np.cumsum(np.bincount(key, g, width * BINS).reshape(width, BINS), axis=1)
                hs = np.cumsum(np.bincount(key, h, width * BINS).reshape(width, BINS), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                gain[:, len(edges[j]) :] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best + 1e-9
                best[better] = gain[np.arange(width), top][better]
                column[base : base + width][better] = j
                cut[better] = top[better]
                threshold[base : base + width][better] = edges[j][top[better]] if better.any() and len(edges[j]) else np.inf
            at = node
            right = x[np.arange(n), column[at]] > threshold[at]
            node = 2 * node + 1 + right
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        raw += value[leaf]
        model.columns.append(column)
        model.thresholds.append(threshold)
        model.leaves.append(value)
    return model


@dataclass
class Isotonic:
    """A rising step function through the pooled means, linear between their middles."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value)


def isotonic(x: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; each pool's mean is drawn to 1/2 by one row, so that no score is quite 0 or 1."""
    if not len(x):
        return Isotonic(np.array([-1.0, 1.0]), sigmoid(np.array([-1.0, 1.0])))
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1.0, a, a])
        while len(pools) > 1 and (pools[-2][3] == pools[-1][2] or pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]):
            s, n, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], hi]
    value = np.array([(s + 0.5) / (n + 1) for s, n, _, _ in pools])
    return Isotonic(np.array([(lo + hi) / 2 for _, _, lo, hi in pools]), np.maximum.accumulate(value))
