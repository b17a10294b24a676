"""Gradient-boosted trees for a binary label over a small dense matrix, and isotonic calibration; plain numpy.

Used to fit on a bounded sample; prediction is vectorised and carried to the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: inner nodes in heap order, then leaves."""

    depth: int
    base: float
    features: list[np.ndarray] = field(default_factory=list)
    limits: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.features, self.limits, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, ridge: float = 1.0, least: float = 1.0, bins: int = 32) -> Trees:
    """Second-order boosting of the logistic loss on quantile histograms."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    # few values stand out in sparse columns; the cut at zero is always there
    cuts = [np.unique(np.append(c, [0.0, *np.quantile(v, (0.1, 0.5, 0.9))])) if len(v := x[x[:, f] > 0, f]) else np.array([0.0]) for f, c in enumerate(cuts)]
    size = max(len(c) for c in cuts) + 1
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1) if width else np.zeros((n, 0), np.int64)
    p = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    model = Trees(depth, float(np.log(p / (1 - p))))
    margin = np.full(n, model.base)
    column = np.arange(width) * size
    for _ in range(rounds):
        prob = sigmoid(margin)
        grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        feature, limit, at = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                if len(rows) < 2:
                    continue
                flat = (binned[rows] + column).ravel()
                g = np.bincount(flat, np.repeat(grad[rows], width), width * size).reshape(width, size).cumsum(1)
                h = np.bincount(flat, np.repeat(hess[rows], width), width * size).reshape(width, size).cumsum(1)
                all_g, all_h = grad[rows].sum(), hess[rows].sum()
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                gain[(h < least) | (all_h - h < least)] = 0
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] > 1e-6 and b < len(cuts[f]):
                    feature[node], limit[node] = f, cuts[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > limit[at])
        own = at - (2**depth - 1)
        leaf = -rate * np.bincount(own, grad, 2**depth) / (np.bincount(own, hess, 2**depth) + ridge)
        model.features.append(feature)
        model.limits.append(limit)
        model.leaves.append(leaf)
        margin += leaf[own]
    return model


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (score, probability), both rising; between knots one interpolates."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # weight, mean of y, sum of scores
    for s, label in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([1.0, float(label), s])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w, m, t = pools.pop()
            v = pools[-1]
            v[1] = (v[0] * v[1] + w * m) / (v[0] + w)
            v[0] += w
            v[2] += t
    return np.array([t / w for w, _, t in pools]), np.array([(w * m + 0.5 * 0.1) / (w + 0.1) for w, m, _ in pools])


def out_of_fold(x: np.ndarray, y: np.ndarray, folds: int, **how) -> np.ndarray:
    """Margins of every row from trees that did not see it."""
    out, own = np.zeros(len(y)), np.arange(len(y)) % folds
    for k in range(folds):
        rest = own != k
        out[~rest] = fit_trees(x[rest], y[rest], **how).margin(x[~rest])
    return out
