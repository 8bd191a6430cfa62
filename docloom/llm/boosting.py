"""Gradient-boosted trees over small whole-number features: fitted on the driver, applied as one Spark expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAF = 4  # fewest examples in a leaf


@dataclass
class Tree:
    """A split (feature <= cut goes left) or a leaf."""

    value: float = 0.0
    feature: int = -1
    cut: int = 0
    left: Tree | None = None
    right: Tree | None = None

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        goes = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[goes], out[~goes] = self.left.apply(x[goes]), self.right.apply(x[~goes])
        return out

    def column(self, features: list[Column]) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(features[self.feature] <= self.cut, self.left.column(features)).otherwise(self.right.column(features))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> Tree:
    """Second-order gains; ties go to the first feature and the least cut."""
    best, at = 1e-6, None
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, f])[:-1]:
            goes = x[:, f] <= cut
            if LEAF <= goes.sum() <= len(x) - LEAF:
                gain = g[goes].sum() ** 2 / (h[goes].sum() + 1) + g[~goes].sum() ** 2 / (h[~goes].sum() + 1) - whole
                if gain > best + 1e-9:
                    best, at = gain, (f, int(cut), goes)
    if at is None:
        return Tree(value=round(float(-rate * g.sum() / (h.sum() + 1)), 9))
    f, cut, goes = at
    return Tree(0.0, f, cut, _grow(x[goes], g[goes], h[goes], depth - 1, rate), _grow(x[~goes], g[~goes], h[~goes], depth - 1, rate))


@dataclass
class Boosted:
    """Log-odds a + b * sum of the trees; `threshold` is the least probability that is selected."""

    trees: list[Tree]
    a: float
    b: float
    threshold: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum((t.apply(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a + self.b * self.margin(x))))

    def column(self, features: list[Column]) -> Column:
        margin = sum((t.column(features) for t in self.trees), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.a) + F.lit(self.b) * margin)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, precision: float = 0.98) -> Boosted:
    """Trees on two thirds of the examples; the rest calibrates them (Platt) and sets the threshold.

    The threshold is the least probability from which on at least `precision` of the calibration examples are right.
    """
    held = np.arange(len(y)) % 3 == 2
    tx, ty, trees, margin = x[~held], y[~held], [], np.zeros((~held).sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(tx, p - ty, p * (1 - p), depth, rate)
        trees.append(tree)
        margin = margin + tree.apply(tx)
    own = Boosted(trees, 0.0, 1.0, 0.5)
    m, t = own.margin(x[held]), y[held]
    for _ in range(50):  # Newton steps for the two numbers of the logistic curve, slightly drawn to (0, 1)
        p = 1 / (1 + np.exp(-(own.a + own.b * m)))
        w = p * (1 - p) + 1e-9
        grad = np.array([(p - t).sum() + own.a, ((p - t) * m).sum() + own.b - 1])
        hess = np.array([[w.sum() + 1, (w * m).sum()], [(w * m).sum(), (w * m * m).sum() + 1]])
        own.a, own.b = np.array([own.a, own.b]) - np.linalg.solve(hess, grad)
    own.a, own.b = round(float(own.a), 9), round(float(own.b), 9)
    p = own.probability(x[held])
    good = [c for c in np.unique(p) if c >= 0.5 and t[p >= c].mean() >= precision]
    own.threshold = round(float(min(good, default=1.0)) - 1e-6, 9)
    return own
