"""Depth-1 trees: exact search over ALL split points, and ensembles of them merged for scoring.

The best split of a weighted table is the one with the least weighted Gini impurity of its two sides. What
decides are two running sums per feature, of the classes' weights in the order of its values. They are
narrowed like a histogram:

1. each feature's values are cut into at most ``BINS`` intervals, once; a pass adds up the weights per
   interval, a task in numpy, Spark the tasks. Edges of intervals are split points with an exact impurity;
2. impurity is concave in what stands left of a split, so inside an interval it is least where all of one
   class, and nothing of the other, stands left. Intervals for which even that isn't better than the best
   edge are settled; of a continuous feature a few are left;
3. these are read once more: value by value if they hold at most ``EXACT`` rows, else cut again.

So nothing is binned away and the driver holds a bounded number of sums, whatever the distinct values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
SAMPLE = 8192  # rows from which cut points are taken
EXACT = 50_000


@dataclass(frozen=True)
class Stump:
    """A depth-1 tree: class ``left`` where the feature is at most ``threshold`` (or one of ``values``)."""

    alpha: float
    left: float
    right: float
    feature: int = -1  # -1: a single leaf, class ``left``
    threshold: float | None = None
    values: tuple[float, ...] = ()

    def predicted(self, arr: str = "x") -> Column:
        if self.feature < 0:
            return F.lit(self.left)
        x = F.col(arr)[self.feature]
        return F.when(x.isin(*self.values) if self.threshold is None else x <= self.threshold, F.lit(self.left)).otherwise(F.lit(self.right))


def _impurity(one, zero):
    """Weighted Gini impurity of a side, times its weight."""
    total = one + zero
    return np.where(total > 0, 2 * one * zero / np.where(total > 0, total, 1), 0.0)


@dataclass
class Interval:
    """Rows with low <= x[feature] <= high; ``one`` and ``zero``: the classes' weights below it."""

    feature: int
    low: float
    high: float
    one: float
    zero: float
    rows: int
    cuts: np.ndarray


@dataclass
class Split:
    """The best split so far: feature < 0 as long as there is none."""

    impurity: float
    feature: int = -1
    threshold: float | None = None
    left: tuple[float, float] = (0.0, 0.0)  # weights of class 1 and 0 at most at the threshold


def between(a: float, b: float) -> float:
    """A threshold that has a on its left and b on its right."""
    middle = a / 2 + b / 2
    return middle if a <= middle < b else a


class StumpSearch:
    """Finds the best stump of a stored table (x array<double>, y 0/1) under any weights."""

    def __init__(self, table: DataFrame, bins: int = BINS, exact: int = EXACT, seed: int = 5) -> None:
        self.bins, self.exact, self.seed = bins, exact, seed
        rows = np.array([r[0] for r in table.select("x").orderBy(F.rand(seed)).limit(SAMPLE).collect()])
        if not len(rows):
            raise ValueError("no rows to fit on")
        if np.isnan(rows).any():
            raise ValueError("a feature is NaN")
        self.cuts = [self._cuts(rows[:, f]) for f in range(rows.shape[1])]
        self.whole = [Interval(f, -np.inf, np.inf, 0.0, 0.0, 1 << 62, c) for f, c in enumerate(self.cuts)]

    def _cuts(self, values: np.ndarray) -> np.ndarray:
        distinct = np.unique(values)
        at = np.unique(np.linspace(0, len(distinct) - 1, min(self.bins - 1, len(distinct))).astype(int))
        return distinct[at]

    def _sums(self, intervals: list[Interval], by_value: bool):
        def run(batches):
            held: dict[tuple[int, float], list] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                if np.isnan(x).any():
                    raise ValueError("a feature is NaN")
                w = b.column("w").to_numpy(zero_copy_only=False)
                one = w * (b.column("y").to_numpy(zero_copy_only=False) == 1)
                for i, t in enumerate(intervals):
                    v = x[:, t.feature]
                    inside = (v >= t.low) & (v <= t.high)
                    if not inside.all():
                        v, w1, wa = v[inside], one[inside], w[inside]
                    else:
                        w1, wa = one, w
                    if not len(v):
                        continue
                    if by_value:
                        keys, place = np.unique(v, return_inverse=True)
                        low = high = keys
                    else:
                        keys, place = np.unique(np.searchsorted(t.cuts, v, "left"), return_inverse=True)
                        low, high = np.full(len(keys), np.inf), np.full(len(keys), -np.inf)
                        np.minimum.at(low, place, v)
                        np.maximum.at(high, place, v)
                    for k, a, z, n, lo, hi in zip(keys.tolist(), np.bincount(place, w1), np.bincount(place, wa), np.bincount(place), low, high, strict=True):
                        h = held.get((i, k))
                        if h is None:
                            held[i, k] = [a, z - a, n, lo, hi]
                        else:
                            h[0] += a
                            h[1] += z - a
                            h[2] += n
                            h[3], h[4] = min(h[3], lo), max(h[4], hi)
            if held:
                cols = list(zip(*held.values(), strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array([i for i, _ in held], pa.int32()), pa.array([float(k) for _, k in held]), pa.array(cols[0], pa.float64()),
                    pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64())],
                    ["i", "k", "one", "zero", "n", "low", "high"])
        return run

    def _narrow(self, weighted: DataFrame, intervals: list[Interval], best: Split, total: tuple[float, float] | None,
                by_value: bool) -> tuple[Split, list[Interval], tuple[float, float]]:
        """One pass: the best split at the edges inside the intervals, and the parts that may still hold a better one."""
        found = weighted.mapInArrow(self._sums(intervals, by_value), "i int, k double, one double, zero double, n long, low double, high double").groupBy(
            "i", "k").agg(*[F.sum(c).alias(c) for c in ("one", "zero", "n")], F.min("low").alias("low"), F.max("high").alias("high")).collect()
        parts: dict[int, list] = {}
        for r in found:  # at most intervals × bins, or ``exact`` rows
            parts.setdefault(r["i"], []).append(r)
        if total is None:
            any_part = next(iter(parts.values()), [])
            total = sum(r["one"] for r in any_part), sum(r["zero"] for r in any_part)
            best = Split(float(_impurity(*total)))
        maybe = []
        for i, rows in sorted(parts.items()):
            t = intervals[i]
            rows.sort(key=lambda r: r["low"])
            one, zero = (np.array([r[c] for r in rows]) for c in ("one", "zero"))
            left1, left0 = t.one + np.cumsum(one), t.zero + np.cumsum(zero)
            at_edge = _impurity(left1, left0) + _impurity(total[0] - left1, total[1] - left0)
            for j in np.argsort(at_edge[:-1], kind="stable")[:1]:
                if at_edge[j] < best.impurity * (1 - 1e-12):
                    best = Split(float(at_edge[j]), t.feature, between(rows[j]["high"], rows[j + 1]["low"]), (float(left1[j]), float(left0[j])))
            before1, before0 = left1 - one, left0 - zero
            corner = [_impurity(a, b) + _impurity(total[0] - a, total[1] - b) for a, b in ((left1, before0), (before1, left0))]
            for j, bound in enumerate(np.minimum(*corner)):
                if rows[j]["low"] < rows[j]["high"]:
                    maybe.append((float(bound), Interval(t.feature, rows[j]["low"], rows[j]["high"], float(before1[j]), float(before0[j]), rows[j]["n"], t.cuts)))
        return best, [t for bound, t in maybe if bound < best.impurity * (1 - 1e-12)], total

    def best(self, weighted: DataFrame) -> tuple[Split, tuple[float, float]]:
        """(best split, weights of class 1 and 0) of the table with weights: x, y, w."""
        weighted = weighted.select("x", "y", "w")
        best, left, total = self._narrow(weighted, self.whole, Split(np.inf), None, False)
        while left:
            by_value = sum(t.rows for t in left) <= self.exact
            if not by_value:
                left = self._cut_again(weighted, left)
            best, left, _ = self._narrow(weighted, left, best, total, by_value)
        return best, total

    def _cut_again(self, weighted: DataFrame, intervals: list[Interval]) -> list[Interval]:
        inside = F.lit(False)
        for t in intervals:
            inside = inside | F.col("x")[t.feature].between(t.low, t.high)
        rows = np.array([r[0] for r in weighted.where(inside).select("x").orderBy(F.rand(self.seed)).limit(SAMPLE).collect()])
        out = []
        for t in intervals:
            v = rows[:, t.feature]
            inside = np.unique(np.append(v[(v >= t.low) & (v < t.high)], t.low))
            if len(inside) >= self.bins:
                inside = inside[np.linspace(0, len(inside) - 1, self.bins + 1).astype(int)[1:-1]]
            out.append(Interval(t.feature, t.low, t.high, t.one, t.zero, t.rows, inside))
        return out


def stump_of(split: Split, total: tuple[float, float], alpha: float) -> tuple[Stump, float]:
    """(stump, weight of the rows it gets wrong): each side takes its heavier class, 0 if they are equal."""
    one, zero = total
    if split.feature < 0:
        return Stump(alpha, float(one > zero), float(one > zero)), min(one, zero)
    a, b = split.left
    sides = (a, b), (one - a, zero - b)
    wrong = sum(max(0.0, min(s)) for s in sides)
    return Stump(alpha, *[float(s[0] > s[1]) for s in sides], split.feature, split.threshold), wrong


def _below(x: Column, thresholds: list[float]) -> Column:
    """How many of the sorted thresholds are less than x: binary search by halving steps."""
    table = F.lit(thresholds)
    steps = F.lit([1 << k for k in reversed(range(len(thresholds).bit_length()))])

    def step(at: Column, size: Column) -> Column:
        there = (at + size <= len(thresholds)) & (F.get(table, at + size - 1) < x)
        return F.when(there, at + size).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def votes(stumps: list[Stump], arr: str = "x") -> Column:
    """Σ alpha · (±1) over the stumps. Those of a feature are one sorted table of thresholds and summed votes:
    the expression grows with the features, not with the stumps."""
    fixed, out, steps = 0.0, None, {}
    for s in stumps:
        left, right = s.alpha * (2 * s.left - 1), s.alpha * (2 * s.right - 1)
        if s.feature < 0:
            fixed += left
        elif s.threshold is None:  # by values
            term = F.when(F.col(arr)[s.feature].isin(*s.values), left).otherwise(right)
            out = term if out is None else out + term
        else:
            here = steps.setdefault(s.feature, {})
            fixed += left
            here[s.threshold] = here.get(s.threshold, 0.0) + right - left
    total = F.lit(fixed) if out is None else out + F.lit(fixed)
    for feature in sorted(steps):
        thresholds = sorted(steps[feature])
        change = np.concatenate([[0.0], np.cumsum([steps[feature][t] for t in thresholds])]).tolist()
        total = total + F.get(F.lit(change), _below(F.col(arr)[feature], thresholds))
    return total
