"""Histograms, box plots and kernel densities of several numeric columns at once.

One aggregate gives all columns' ranges (and what else is needed per class) as scalars; a second one adds up
all bins, or all grid points, of all columns and classes while the rows are read once. No row is exploded,
repeated or shuffled: what is shuffled is one row of sums per class and task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from churnlens.operators.lookup import lookup
from churnlens.operators.ordered import stored
from churnlens.operators.stats import exact_quantiles

CLASSES = 256  # more classes than that make no chart
BLOCK = 4096  # distinct values whose kernels are added up together


def _doubles(cols: list[str]) -> list[Column]:
    return [F.col(c).cast("double").alias(c) for c in cols]


def ranges(df: DataFrame, cols: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Least and greatest value of every column, in one aggregate."""
    row = df.select(*_doubles(cols)).agg(*[f(c) for c in cols for f in (F.min, F.max)]).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(cols)}


def histograms(df: DataFrame, cols: list[str], bins: int = 30, by: str | None = None) -> DataFrame:
    """(column, [by], bin, left, right, n[, density]) of equal-width bins over each column's own
    range, the last one closed; bins without rows are left out. With ``by`` each class has its own density,
    which integrates to 1."""
    held = {c: r for c, r in ranges(df, cols).items() if r[0] is not None}
    if not held:
        fields = [StructField("column", StringType()), *([df.schema[by]] if by else []), *[StructField(n, t) for n, t in (
            ("bin", IntegerType()), ("left", DoubleType()), ("right", DoubleType()))]]
        out = df.sparkSession.createDataFrame([], StructType(fields)).withColumn("n", F.lit(0).cast("long"))
        return out.withColumn("density", F.lit(0.0)) if by else out
    place = {}
    for c, (lo, hi) in held.items():
        x = F.col(c).cast("double")
        at = F.lit(0) if lo == hi else F.least(F.lit(bins - 1), F.floor((x - lo) / ((hi - lo) / bins)).cast("int"))
        place[c] = F.when(x.isNotNull(), at).alias(f"_b_{c}")
    rows = df.select(*([by] if by else []), *place.values())
    counted = rows.groupBy(*([by] if by else [])).agg(*[
        F.array(*[F.count_if(F.col(f"_b_{c}") == b) for b in range(bins)]).alias(c) for c in held])
    parts = [F.struct(F.lit(c).alias("column"), F.lit(b).alias("bin"), F.lit(lo + b * (hi - lo) / bins).alias("left"),
                      F.lit(lo + (b + 1) * (hi - lo) / bins).alias("right"), F.col(c)[b].alias("n"),
                      F.aggregate(c, F.lit(0).cast("long"), lambda s, n: s + n).alias("_all"))
             for c, (lo, hi) in held.items() for b in range(bins)]
    out = counted.select(*([by] if by else []), F.inline(F.array(*parts))).where("n > 0")
    if by:
        out = out.withColumn("density", F.try_divide("n", F.col("_all") * (F.col("right") - F.col("left"))))
    return out.select("column", *([by] if by else []), "bin", "left", "right", "n", *(["density"] if by else []))


def box_table(df: DataFrame, cols: list[str], by: str, approx: bool = False) -> DataFrame:
    """(column, by, quartiles, 1.5·IQR whiskers (most extreme value inside the fence), outlier count). The
    columns are written once: quantiles and fences read them several times."""
    df = df if approx else stored(df.select(by, *cols), "numerics")
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols]))
    quartiles = exact_quantiles(df.select(by, each), "x", [0.25, 0.5, 0.75], by=["column", by], approx=approx)
    q = quartiles.groupBy("column", by).pivot("q", [0.25, 0.5, 0.75]).agg(F.first("value")).select(
        "column", by, F.col("`0.25`").alias("q1"), F.col("`0.5`").alias("median"), F.col("`0.75`").alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    per = q.select(by, F.struct("column", "q1", "median", "q3", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high")).alias("_f"))
    fences = per.groupBy(by).agg(F.collect_list("_f").alias("_fences"))  # one entry per column
    j = lookup(df.select(by, *_doubles(cols)), fences, [by])
    def fence(c: str) -> Column:
        return F.filter("_fences", lambda s: s["column"] == c)[0]

    aggs = []
    for c in cols:
        f = fence(c)
        inside = F.col(c).between(f["low"], f["high"])
        aggs += [F.min(F.when(inside, F.col(c))).alias(f"_lo_{c}"), F.max(F.when(inside, F.col(c))).alias(f"_hi_{c}"), F.count_if(~inside).alias(f"_out_{c}")]
    w = j.groupBy(by).agg(*aggs)
    ends = w.select(by, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_lo_{c}").alias("whisker_lo"), F.col(f"_hi_{c}").alias("whisker_hi"),
                                                    F.col(f"_out_{c}").alias("n_outliers")) for c in cols])))
    return q.join(ends, ["column", by]).select("column", by, "q1", "median", "q3", "whisker_lo", "whisker_hi", "n_outliers")


def _kernels(grids: np.ndarray, widths: np.ndarray):
    """Σ exp(−½((grid − x) / h)²) per (class, column, point) over a task's rows; equal values are counted first."""
    def run(batches):
        k, d, points = len(widths), *grids.shape
        out = np.zeros((k, d, points))
        for b in batches:
            group = b.column("g").to_numpy(zero_copy_only=False)
            for c in range(d):
                x = b.column(f"x{c}").to_numpy(zero_copy_only=False).astype(float)
                for g in range(k):
                    if not widths[g, c] > 0:
                        continue
                    values, n = np.unique(x[(group == g) & ~np.isnan(x)], return_counts=True)
                    for at in range(0, len(values), BLOCK):
                        z = (grids[c][:, None] - values[None, at:at + BLOCK]) / widths[g, c]
                        out[g, c] += np.exp(-0.5 * z * z) @ n[at:at + BLOCK]
        at = np.indices(out.shape).reshape(3, -1).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"g": at[0], "c": at[1], "point": at[2], "s": out.ravel()})
    return run


def kde_table(df: DataFrame, cols: list[str], by: str, points: int = 100) -> DataFrame:
    """(column, by, point, x, density): Gaussian kernel density per class on a common grid over each
    column's range, Scott bandwidth (sample std × n^(−1/5)). A class without spread has no density (null)."""
    spark = df.sparkSession
    rows = df.select(by, *_doubles(cols))
    stats = rows.groupBy(by).agg(*[F.struct(F.count(c), F.stddev_samp(c), F.min(c), F.max(c)) for c in cols]).limit(CLASSES + 1).collect()
    if len(stats) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes of {by}")
    per = np.array([[[np.nan if v is None else v for v in r[1 + i]] for i in range(len(cols))] for r in stats], float).reshape(len(stats), len(cols), 4)
    widths = np.nan_to_num(per[:, :, 1] * np.power(np.maximum(per[:, :, 0], 1), -0.2))
    low, high = (f(per[:, :, i], axis=0) if len(stats) else np.full(len(cols), np.nan) for f, i in ((np.fmin.reduce, 2), (np.fmax.reduce, 3)))
    grids = low[:, None] + (high - low)[:, None] * np.arange(points)[None, :] / (points - 1)
    number = F.lit(None).cast("int")
    for i, r in enumerate(stats):
        number = F.when(F.col(by).eqNullSafe(F.lit(r[0])), i).otherwise(number)
    coded = rows.select(number.alias("g"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(cols)])
    sums = coded.mapInArrow(_kernels(grids, widths), "g int, c int, point int, s double").groupBy("g", "c", "point").agg(F.sum("s").alias("s"))
    # classes × columns × points: what the chart has
    grid = [(g, i, p, c, r[0], float(grids[i, p]), float(per[g, i, 0] * widths[g, i])) for g, r in enumerate(stats)
            for i, c in enumerate(cols) if per[g, i, 0] > 0 for p in range(points)]
    fields = [*[StructField(n, IntegerType()) for n in ("g", "c", "point")], StructField("column", StringType()), df.schema[by],
              StructField("x", DoubleType()), StructField("_nh", DoubleType())]
    return spark.createDataFrame(grid, StructType(fields)).join(sums, ["g", "c", "point"], "left").select(
        "column", by, "point", "x", (F.try_divide("s", "_nh") / math.sqrt(2 * math.pi)).alias("density"))
