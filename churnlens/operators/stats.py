"""Exact quantiles with linear interpolation (numpy/pandas default), at any scale.

Spark's ``percentile`` keeps a value->count map per group in one task, so a
continuous column on a huge table would overload the final merge. Here
the order statistics are selected by narrowing histograms (``operators/cuts.py``): no row is
sorted, shuffled or written, and the driver holds a bounded number of keys. With more groups than
the driver is to hold, values are collapsed to (group, value, count), cumulative counts come from the
distributed ``ordered_prefix``, and the order statistic of 0-based rank r is ``min(value) where
cumcount > r``. ``approx=True`` switches to ``percentile_approx``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from churnlens.operators.cuts import Cuts, TooManyGroups
from churnlens.operators.lookup import lookup
from churnlens.operators.ordered import ordered_prefix, stored


def exact_quantiles(df: DataFrame, x: str, probs: Sequence[float], by: Sequence[str] = (),
                    approx: bool = False, accuracy: int = 100000) -> DataFrame:
    """Return (by..., q, value) with one row per group and probability."""
    by = list(by)
    probs = [float(p) for p in probs]
    vals = df.filter(F.col(x).isNotNull())
    if approx:
        agg = vals.groupBy(*by).agg(F.percentile_approx(x, probs, accuracy).alias("_v"))
        return agg.select(*by, F.posexplode("_v").alias("_i", "value")).select(
            *by, F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1).alias("q"), "value")

    try:
        cuts = Cuts(vals.select(*by, x), [(x, False)], by)
    except TooManyGroups:
        return _by_counts(vals, x, probs, by)
    places = {g: [q * (n - 1) for q in probs] for g, n in cuts.sizes.items()}
    ranks = {g: [r for pos in ps for r in (int(pos) + 1, min(int(pos) + 2, cuts.sizes[g]))] for g, ps in places.items()}
    rows = []
    for g, keys in cuts.at(ranks).items():
        for i, (q, pos) in enumerate(zip(probs, places[g], strict=True)):
            (a,), (b,) = keys[2 * i], keys[2 * i + 1]
            rows.append((*g, q, float(a) + float(b - a) * (pos - int(pos))))
    fields = [*[vals.schema[c] for c in by], StructField("q", DoubleType()), StructField("value", DoubleType())]
    return df.sparkSession.createDataFrame(rows, StructType(fields))


def _by_counts(vals: DataFrame, x: str, probs: list[float], by: list[str]) -> DataFrame:
    """The same, for any number of groups."""
    # collapsed and written once: sample, totals, ranks and group sizes are all taken from this table
    counts = stored(vals.groupBy(*by, x).agg(F.count(F.lit(1)).alias("_c")), "quantiles")
    cum = ordered_prefix(counts, [(x, False)], sums=["_c"], partition=by, rn="_rk", prefix="_cum", write=False)
    if by:
        cum = lookup(cum, counts.groupBy(*by).agg(F.sum("_c").alias("_n")), by)
    else:
        cum = cum.withColumn("_n", counts.agg(F.sum("_c")).scalar())
    aggs, outs = [], []
    for i, q in enumerate(probs):
        pos = F.lit(q) * (F.col("_n") - 1)
        r0 = F.floor(pos)
        r1 = F.least(r0 + 1, F.col("_n") - 1)
        aggs += [F.min(F.when(F.col("_cum_c") > r0, F.col(x))).alias(f"_a{i}"),
                 F.min(F.when(F.col("_cum_c") > r1, F.col(x))).alias(f"_b{i}"),
                 F.first(pos - r0).alias(f"_f{i}")]
        outs.append(F.struct(F.lit(q).alias("q"),
                             (F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).alias("value")))
    res = cum.groupBy(*by).agg(*aggs)
    return res.select(*by, F.explode(F.array(*outs)).alias("_o")).select(*by, "_o.q", "_o.value")
