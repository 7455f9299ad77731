"""Distributed total order: row numbers and running sums without a one-task window.

A window with no PARTITION BY (or partitioned by a key that holds a third of all rows) sorts
everything in ONE task. ``ordered_prefix`` has one plan for every size instead:

1. the input is written once (unless it is a narrow projection of a stored table), so that count,
   sample, totals and ranks read the same rows;
2. a sample of about ``SAMPLE_PER_BUCKET`` rows per bucket, ordered by Spark, gives the boundaries of
   the full composite order (partition keys, order keys, id tie-break): one giant tie is split by id.
   There are as many buckets as the session has shuffle partitions;
3. a row's bucket is found by binary search over the boundaries, which reach the tasks as one
   sorted array (a scalar subquery): a pure function of the row, so a task that is run again after an
   executor is lost puts it in the same bucket. Nulls and descending keys of any type follow Spark's
   order (nulls first when ascending, last when descending);
4. a window per bucket gives local row numbers and running sums;
5. per-(bucket, partition) totals (at most buckets + groups rows) become offsets by a window over
   that small table, and are joined back.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from churnlens.session import ensure_checkpoint_dir

SAMPLE_PER_BUCKET = 32


def stored(df: DataFrame, tag: str = "ordered") -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/churnlens/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _orders(order: Sequence[tuple[str, bool]], tiebreak: str | None) -> list[tuple[str, bool]]:
    out = list(order)
    if tiebreak and tiebreak not in [c for c, _ in out]:
        out.append((tiebreak, False))
    return out


def _sort_cols(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in keys]


def _precedes(bound: Column, keys: list[tuple[str, bool]]) -> Column:
    """The boundary (a struct f0, f1, ...) stands strictly before the row."""
    out = F.lit(False)
    for i, (c, desc) in reversed(list(enumerate(keys))):
        b, v = bound[f"f{i}"], F.col(c)
        # ascending: null is the least value; descending: the last
        first = (b.isNotNull() & (v.isNull() | (b > v))) if desc else (v.isNotNull() & (b.isNull() | (b < v)))
        out = F.coalesce(first, F.lit(False)) | (b.eqNullSafe(v) & out)
    return out


def _bucket(keys: list[tuple[str, bool]], bounds: str, n: int) -> Column:
    """Number of boundaries strictly before the row: binary search by halving steps."""
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    if not steps:
        return F.lit(0)

    def step(at: Column, size: Column) -> Column:
        there = (at + size <= n) & _precedes(F.get(F.col(bounds), at + size - 1), keys)
        return F.when(there, at + size).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def binned(df: DataFrame, column: str, splits: Sequence[float], desc: bool, out: str) -> DataFrame:
    """Add the place of a number among ``splits`` (-inf to inf, rising), negative if descending, so that it doesn't
    fall as the order goes on: ``Bucketizer`` finds it in compiled code. Null is at -1, NaN after the last split."""
    x, at = _unused(df, "_x"), _unused(df, "_bin")
    bins = Bucketizer(splits=list(splits), inputCol=x, outputCol=at, handleInvalid="keep").transform(
        df.withColumn(x, F.col(column).cast("double") + F.lit(0.0)))  # -0.0 is 0.0
    return bins.withColumn(out, F.coalesce(F.col(at).cast("int"), F.lit(-1)) * (-1 if desc else 1)).drop(x, at)


def _unused(df: DataFrame, name: str) -> str:
    """``name``, underscores before it as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _boundaries(df: DataFrame, keys: list[tuple[str, bool]], n: int, buckets: int, seed: int) -> list[tuple]:
    """At most ``buckets`` - 1 distinct rows of the order's keys, in order."""
    share = min(1.0, SAMPLE_PER_BUCKET * buckets / max(n, 1))
    rows = [tuple(r) for r in df.select(*[c for c, _ in keys]).sample(False, share, seed).orderBy(*_sort_cols(keys)).collect()]
    picks = sorted({j * len(rows) // buckets for j in range(1, buckets)}) if rows else []
    return list(dict.fromkeys(rows[p] for p in picks))


def ordered_prefix(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    sums: Sequence[str] = (),
    partition: Sequence[str] = (),
    tiebreak: str | None = None,
    n_buckets: int | None = None,
    rn: str = "rn",
    prefix: str = "cum_",
    seed: int = 7,
    n: int | None = None,
    write: bool = True,
    bucket: Column | None = None,
    nexts: Sequence[str] = (),
    apart: bool = False,
) -> DataFrame:
    """Add ``rn`` (1-based position inside ``partition`` under ``order`` + ``tiebreak`` asc)
    and inclusive running sums ``cum_<s>`` for every column in ``sums``.

    ``order`` is a list of (column, descending). The order plus ``tiebreak`` must be total (unique)
    for results to be deterministic. ``write=False``: the input is a narrow projection of a stored
    table, cheap to read again. ``n``: its row count, if known. ``bucket``: a column that doesn't fall
    as the order goes on (a hash's leading digits), in place of sampled boundaries.

    ``nexts``: columns whose value in the next row of the order is added as ``next_<c>`` (null in a
    partition's last row). Inside a bucket that is a lead over the window that numbers the rows; between
    buckets it comes with the offsets, from one edge row per bucket. All keys must have one direction.

    ``apart``: inside a partition hardly any rows are equal in the order's first column (distinct scores, say), so
    buckets need not split its ties. If it has doubles, a row's bucket is found from it alone, in compiled code.
    """
    partition = list(partition)
    own = _orders(order, tiebreak)
    keys = [(p, False) for p in partition] + own
    src = stored(df) if write else df
    if bucket is not None:
        b = src.withColumn("_bkt", bucket)
    elif apart and isinstance(src.schema[own[0][0]].dataType, DoubleType):
        b = _bucketed(src, own[:1], n_buckets, n, seed, apart=True)
    else:
        b = _bucketed(src, keys, n_buckets, n, seed)
    if nexts and len({d for _, d in own}) > 1:
        raise ValueError("the next row is given for orders of one direction")

    w = Window.partitionBy("_bkt", *partition).orderBy(*_sort_cols(own))
    out = b.withColumn(rn, F.row_number().over(w).cast("long"))
    for s in sums:
        out = out.withColumn(prefix + s, F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    wt = Window.partitionBy(*partition).orderBy("_bkt")
    edges, edge_cols = [], []
    if nexts:
        out = out.withColumn("_lead", F.lead(F.struct(*nexts)).over(w))
        first = (F.max_by if own[0][1] else F.min_by)(F.struct(*nexts), F.struct(*[c for c, _ in own]))
        edges, edge_cols = [first.alias("_first")], [F.lead("_first").over(wt).alias("_edge")]

    totals = b.groupBy("_bkt", *partition).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(s).alias(f"_t_{s}") for s in sums], *edges)
    wb = wt.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_bkt").alias("_ob"), *[F.col(p).alias(f"_o_{p}") for p in partition],
        F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_off_n"),
        *[F.coalesce(F.sum(f"_t_{s}").over(wb), F.lit(0)).alias(f"_off_{s}") for s in sums], *edge_cols,
    )
    # Without partition keys there is one row per bucket: a proven bound, so broadcast it. With them it
    # is left to AQE's size check at run time; the rows are hash-partitioned on these keys already.
    same = F.col("_bkt") == F.col("_ob")
    for p in partition:
        same = same & F.col(p).eqNullSafe(F.col(f"_o_{p}"))
    out = out.join(offsets if partition else F.broadcast(offsets), same)
    out = out.withColumn(rn, F.col(rn) + F.col("_off_n"))
    for s in sums:
        out = out.withColumn(prefix + s, F.col(prefix + s) + F.col(f"_off_{s}"))
    for c in nexts:
        out = out.withColumn(f"next_{c}", F.when(F.col("_lead").isNotNull(), F.col("_lead")[c]).otherwise(F.col("_edge")[c]))
    return out.drop("_bkt", "_ob", "_off_n", "_lead", "_edge", *[f"_o_{p}" for p in partition], *[f"_off_{s}" for s in sums])


def _bucketed(src: DataFrame, keys: list[tuple[str, bool]], n_buckets: int | None, n: int | None, seed: int, apart: bool = False) -> DataFrame:
    """``src`` with the number of its bucket, by binary search over sampled boundaries. ``apart``: the keys are
    one column of doubles."""
    buckets = n_buckets or int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _boundaries(src, keys, src.count() if n is None else n, buckets, seed)
    if apart:
        inner = {float(b) + 0.0 for b, in bounds if b is not None and b == b}
        return binned(src, keys[0][0], sorted({-math.inf, 0.0, math.inf} | inner), keys[0][1], "_bkt")

    fields = [StructField("i", IntegerType())] + [StructField(f"f{i}", src.schema[c].dataType) for i, (c, _) in enumerate(keys)]
    table = src.sparkSession.createDataFrame([(i, *b) for i, b in enumerate(bounds)], StructType(fields))
    held = table.agg(F.array_sort(F.collect_list(F.struct(*table.columns)))).scalar()
    return src.withColumn("_bounds", held).withColumn("_bkt", _bucket(keys, "_bounds", len(bounds))).drop("_bounds")
