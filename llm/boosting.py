"""Gradient-boosted trees on a bounded sample, with monotonic constraints, flattened into node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Forest:
    """Node k sends a row with x[feature[k]] <= threshold[k] to left[k], others to right[k]; leaves send to themselves."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The log odds of each row."""
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(self.depth):
                node = np.where(rows[every, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total


class _Trees:
    def __init__(self, depth: int, least: float, shrink: float, signs: np.ndarray):
        self.depth, self.least, self.shrink, self.signs = depth, least, shrink, signs
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def _node(self, value: float) -> int:
        at = len(self.value)
        for column, x in zip((self.feature, self.threshold, self.left, self.right, self.value), (0, np.inf, at, at, value), strict=True):
            column.append(x)
        return at

    def grow(self, bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rate: float) -> int:
        """One tree. bins: of each row and feature. A constrained feature splits only where the side that must not score less
        doesn't, and below such a split both sides stay on their side of the middle."""
        ridge = self.shrink
        weight = lambda g, h, low, high: np.clip(-g / (h + ridge), low, high)

        def gain(g, h, w):
            return -(g * w + 0.5 * (h + ridge) * w * w)

        def build(rows: np.ndarray, depth: int, low: float, high: float) -> int:
            g, h = gradient[rows].sum(), hessian[rows].sum()
            own = float(weight(g, h, low, high))
            at = self._node(rate * own)
            if depth == self.depth or len(rows) < 2:
                return at
            best = (1e-6, None, None, 0.0, 0.0)
            for f in range(bins.shape[1]):
                size = len(edges[f]) + 1
                if size < 2:
                    continue
                gl = np.cumsum(np.bincount(bins[rows, f], gradient[rows], size))[:-1]
                hl = np.cumsum(np.bincount(bins[rows, f], hessian[rows], size))[:-1]
                wl, wr = weight(gl, hl, low, high), weight(g - gl, h - hl, low, high)
                got = gain(gl, hl, wl) + gain(g - gl, h - hl, wr) - gain(g, h, own)
                got[(hl < self.least) | (h - hl < self.least) | (self.signs[f] * (wr - wl) < 0)] = -np.inf
                k = int(np.argmax(got))
                if got[k] > best[0]:
                    best = (float(got[k]), f, k, float(wl[k]), float(wr[k]))
            _, f, k, wl, wr = best
            if f is None:
                return at
            middle = (wl + wr) / 2
            bounds = [(low, high), (low, high)]
            if self.signs[f]:
                rising = self.signs[f] > 0
                bounds = [(low, middle), (middle, high)] if rising else [(middle, high), (low, middle)]
            goes_left = bins[rows, f] <= k
            self.feature[at], self.threshold[at] = f, float(edges[f][k])
            self.left[at] = build(rows[goes_left], depth + 1, *bounds[0])
            self.right[at] = build(rows[~goes_left], depth + 1, *bounds[1])
            return at

        return build(np.arange(len(bins)), 0, -np.inf, np.inf)


def _edges(values: np.ndarray) -> np.ndarray:
    """At most BINS - 1 thresholds, each halfway between two values that occur."""
    distinct = np.unique(values)
    low = np.unique(np.searchsorted(distinct, np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")))
    low = low[low < len(distinct) - 1]
    return (distinct[low] + distinct[low + 1]) / 2


def fit(rows: np.ndarray, labels: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, least: float = 1.0, shrink: float = 1.0) -> Forest:
    """labels: 0 or 1. signs: for each feature 1 if the score must not fall with it, -1 if it must not rise, 0 if either may
    be. With labels of one kind only, or none, the forest has no trees and an even or one-sided base."""
    labels = labels.astype(float)
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    made, roots = _Trees(depth, least, shrink, np.array(signs)), []
    if len(labels) and 0 < labels.mean() < 1:
        edges = [_edges(rows[:, f]) for f in range(rows.shape[1])]
        bins = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        score = np.full(len(labels), base)
        for _ in range(trees):
            chance = 1 / (1 + np.exp(-score))
            roots.append(made.grow(bins, edges, chance - labels, chance * (1 - chance), rate))
            score = Forest(0.0, np.array(roots[-1:]), *map(np.array, (made.feature, made.threshold, made.left, made.right, made.value)), depth).score(rows) + score
    return Forest(base, np.array(roots, np.int64), np.array(made.feature, np.int64), np.array(made.threshold, float), np.array(made.left, np.int64), np.array(made.right, np.int64), np.array(made.value, float), depth)
