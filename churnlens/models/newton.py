"""Ridge logistic regressions by Newton steps, all fits of a cross-validation at once.

The objective of a fit k is ½‖w‖² + Σ u_k · logloss over its rows, the intercept free: rows enter by their
weight ``u_k`` (0: not a training row of this fit). One step needs two sums per fit, the gradient and the
weighted cross-products of the features. A task adds both up for ALL fits in numpy while it reads its
rows once; Spark adds up the tasks' sums by (fit, place); the driver holds fits × (d + 1)² numbers and solves
fits small systems. The objective is strictly convex, so five to eight such passes give the optimum, whatever
the rows; a step that doesn't lower the objective is halved.

Fits may scale features on their own: column j of fit k is (x_j − mean) / scale, as a pipeline fitted on
the fit's own rows would make it, from one shared table of raw features.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_STEPS = 50
GRADIENT = 1e-11  # of the sum of weights: the largest component that a solution may leave


def _sums(weights: np.ndarray, means: np.ndarray, scales: np.ndarray):
    """Per fit [loss, gradient, cross-products] over a task's rows (x, y, u), as (fit, place, value) rows."""
    def run(batches):
        k, d = weights.shape
        out = np.zeros((k, 1 + d + d * d))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d - 1)
            u = b.column("u").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k)
            y = b.column("y").to_numpy(zero_copy_only=False)
            for i in range(k):
                own = u[:, i] > 0
                z = np.column_stack([np.ones(own.sum()), (x[own] - means[i]) / scales[i]])
                eta, v, t = z @ weights[i], u[own, i], y[own]
                p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                out[i, 0] += float(v @ (np.logaddexp(0, eta) - t * eta))
                out[i, 1:1 + d] += z.T @ (v * (p - t))
                out[i, 1 + d:] += (z.T @ (z * (v * p * (1 - p))[:, None])).ravel()
        width = out.shape[1]
        yield pa.RecordBatch.from_pydict({"fit": np.repeat(np.arange(k, dtype=np.int32), width),
                                          "place": np.tile(np.arange(width, dtype=np.int32), k), "value": out.ravel()})
    return run


def solve(rows: DataFrame, width: int, fits: int, means: np.ndarray | None = None, scales: np.ndarray | None = None) -> np.ndarray:
    """[fits, 1 + width] weights, intercept first. ``rows``: a stored table of x array<double>, y double and
    u array<double> (a weight per fit)."""
    means = np.zeros((fits, width)) if means is None else means
    scales = np.ones((fits, width)) if scales is None else scales
    d = 1 + width
    ridge = np.array([0.0] + [1.0] * width)

    def at(weights: np.ndarray):
        found = rows.select("x", "y", "u").mapInArrow(_sums(weights, means, scales), "fit int, place int, value double").groupBy("fit", "place").agg(
            F.sum("value").alias("value")).collect()  # fits × (1 + d + d²)
        out = np.zeros((fits, 1 + d + d * d))
        for r in found:
            out[r["fit"], r["place"]] = r["value"]
        return (out[:, 0] + 0.5 * (ridge * weights * weights).sum(axis=1), out[:, 1:1 + d] + ridge * weights,
                out[:, 1 + d:].reshape(fits, d, d) + np.diag(ridge))

    weights = np.zeros((fits, d))
    loss, gradient, hessian = at(weights)
    # at weight 0 a row's curvature is a quarter of its weight, which the intercept's entry adds up
    enough = GRADIENT * np.maximum(4 * hessian[:, 0, 0], 1)
    for _ in range(MOST_STEPS):
        open_fits = np.abs(gradient).max(axis=1) > enough
        if not open_fits.any():
            return weights
        step = np.zeros_like(weights)
        for i in np.flatnonzero(open_fits):
            step[i] = np.linalg.lstsq(hessian[i], gradient[i], rcond=None)[0]  # no rows of a class, or none at all: the least step
        size = np.ones(fits)
        for _ in range(30):
            moved = at(weights - size[:, None] * step)
            worse = open_fits & ~(moved[0] <= loss * (1 + 1e-12) + 1e-12)
            if not worse.any():
                break
            size[worse] /= 2
        weights = weights - size[:, None] * step
        loss, gradient, hessian = moved
    raise RuntimeError("the Newton steps didn't converge: are the features finite?")


def rows_of(df: DataFrame, label: str, features: str, weights: Sequence[Column]) -> DataFrame:
    """The table that ``solve`` reads; a null label or feature vector has no weight in any fit."""
    good = F.col(label).isNotNull() & F.col(features).isNotNull()
    return df.where(good).select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"),
                                 F.array(*[w.cast("double") for w in weights]).alias("u"))


@dataclass
class FittedLogistic:
    """A fitted model over a feature vector: its logit is one JVM expression."""

    intercept: float
    coefficients: list[float] = field(repr=False)
    features: str = "features"

    def _logit(self, arr: str) -> Column:
        # left to right, intercept first: equal rows get equal bits
        out = F.lit(self.intercept)
        for i, c in enumerate(self.coefficients):
            if c:
                out = out + F.lit(c) * F.col(arr)[i]
        return out

    def logit(self, df: DataFrame, out: str = "logit") -> DataFrame:
        return df.withColumn("_fa", vector_to_array(F.col(self.features))).withColumn(out, self._logit("_fa")).drop("_fa")

    def probability(self, arr: str) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self._logit(arr)))

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        return df.withColumn("_fa", vector_to_array(F.col(self.features))).withColumn(out, self.probability("_fa")).drop("_fa")
