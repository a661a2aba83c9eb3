"""Gradient-boosted trees on counted feature patterns, scored by plain column expressions.

The training table has one row per combination of feature values, label and fold, however many rows
of the corpus fall under it. So all of the corpus is learned from, and what reaches the driver is
bounded by the number of combinations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    """Feature ``at`` <= ``cut`` goes to ``low``, the rest to ``high``; both are splits or leaf values."""

    at: int
    cut: int
    low: Split | float
    high: Split | float

    def value(self, x: Sequence[int]) -> float:
        side = self.low if x[self.at] <= self.cut else self.high
        return side.value(x) if isinstance(side, Split) else side

    def column(self, x: list[Column]) -> Column:
        low, high = (s.column(x) if isinstance(s, Split) else F.lit(s) for s in (self.low, self.high))
        return F.when(x[self.at] <= self.cut, low).otherwise(high)


Row = tuple[tuple[int, ...], float, float]  # features, gradient, hessian


def grow(rows: list[Row], depth: int, penalty: float) -> Split | float:
    """Tree of Newton steps: the split with the largest gain, as deep as ``depth``."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf, best, found = g / (h + penalty), 1e-6, None
    if depth:
        for at in range(len(rows[0][0])):
            sums: dict[int, list[float]] = {}
            for x, a, b in rows:
                s = sums.setdefault(x[at], [0.0, 0.0])
                s[0] += a
                s[1] += b
            lg = lh = 0.0
            for cut in sorted(sums)[:-1]:
                lg, lh = lg + sums[cut][0], lh + sums[cut][1]
                gain = lg * lg / (lh + penalty) + (g - lg) ** 2 / (h - lh + penalty) - g * g / (h + penalty)
                if gain > best:
                    best, found = gain, (at, cut)
    if not found:
        return leaf
    at, cut = found
    return Split(at, cut, grow([r for r in rows if r[0][at] <= cut], depth - 1, penalty), grow([r for r in rows if r[0][at] > cut], depth - 1, penalty))


@dataclass(frozen=True)
class Boosted:
    start: float
    trees: tuple[Split | float, ...]
    rate: float
    threshold: float

    def score(self, x: Sequence[int]) -> float:
        return self.start + self.rate * sum(t.value(x) if isinstance(t, Split) else t for t in self.trees)

    def column(self, x: list[Column]) -> Column:
        out = F.lit(self.start)
        for t in self.trees:
            out = out + (t.column(x) if isinstance(t, Split) else F.lit(t)) * self.rate
        return out


def fit(train: list[tuple[tuple[int, ...], int, int]], held: list[tuple[tuple[int, ...], int, int]], precision: float, rounds: int = 20, depth: int = 3, rate: float = 0.3, penalty: float = 1.0) -> Boosted:
    """Log-loss boosting on (features, label, count); the threshold is calibrated on ``held``.

    It is the lowest score from which on the held-out share of positives is at least ``precision``
    in sum; without such a score nothing is selected.
    """
    positive = sum(n for _, y, n in train if y)
    total = sum(n for _, _, n in train)
    start = math.log((positive + 1) / (total - positive + 1))
    trees: list[Split | float] = []
    scores = {x: start for x, _, _ in train}
    for _ in range(rounds if 0 < positive < total else 0):
        rows = []
        for x, y, n in train:
            p = 1 / (1 + math.exp(-scores[x]))
            rows.append((x, n * (y - p), n * p * (1 - p)))
        tree = grow(rows, depth, penalty)
        trees.append(tree)
        for x in scores:
            scores[x] += rate * (tree.value(x) if isinstance(tree, Split) else tree)
    model = Boosted(start, tuple(trees), rate, math.inf)
    threshold, right, seen = math.inf, 0, 0
    by_score: dict[float, list[int]] = {}
    for x, y, n in held:
        s = by_score.setdefault(round(model.score(x), 9), [0, 0])
        s[0] += n * y
        s[1] += n
    for s in sorted(by_score, reverse=True):
        right, seen = right + by_score[s][0], seen + by_score[s][1]
        if right >= precision * seen:
            threshold = s - 1e-6
    return Boosted(start, tuple(trees), rate, threshold)
