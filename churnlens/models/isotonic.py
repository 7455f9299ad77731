"""Isotonic regression by pooling adjacent violators inside ordered buckets, then across their edges.

Pooling can begin anywhere: blocks pooled inside a bucket of neighbouring points stay pooled in the whole,
and pooling the blocks of neighbouring buckets gives what pooling their points would. So points are dealt
to range buckets and pooled there, one task each; then ``FAN`` neighbouring buckets' blocks are pooled
together, and so on until one bucket is left. Blocks shrink at once: m of them with means that rise need
about m ** 1.5 rows, so the last task holds n ** (2 / 3) blocks at worst, which are the fitted function itself.
Nothing goes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from churnlens.operators.ordered import stored

FAN = 16


def pooled(low: np.ndarray, high: np.ndarray, total: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Blocks in order of ``low``, adjacent ones joined until their means rise."""
    order = np.argsort(low, kind="stable")
    out: list[list[float]] = []
    for lo, hi, t, w in zip(*(a[order].tolist() for a in (low, high, total, weight)), strict=True):
        out.append([lo, hi, t, w])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, hi, t, w = out.pop()
            out[-1][1] = hi
            out[-1][2] += t
            out[-1][3] += w
    return list(np.array(out, float).reshape(-1, 4).T)


NAMES = ["low", "high", "total", "weight"]


def isotonic_blocks(df: DataFrame, x: str, y: str, by: Sequence[str] = (), weight: str | None = None, buckets: int | None = None) -> DataFrame:
    """(by..., low, high, mean, weight): the blocks of the isotonic regression of y on x in each group of ``by``.

    Points with equal x are one point with their mean; null and NaN x or y, and points without weight, are left out.
    """
    by = list(by)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    points = df.select(*by, F.col(x).cast("double").alias("low"), F.col(y).cast("double").alias("_y"), w.alias("_w")).where(
        F.col("low").isNotNull() & ~F.isnan("low") & F.col("_y").isNotNull() & ~F.isnan("_y") & (F.col("_w") > 0))
    held = points.groupBy(*by, "low").agg(F.sum(F.col("_y") * F.col("_w")).alias("total"), F.sum("_w").alias("weight"))
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_"))
    ranged = held.select(group.alias("g"), "low", F.col("low").alias("high"), "total", "weight").repartitionByRange(n, "g", "low")
    schema = StructType([*ranged.schema.fields, StructField("bucket", IntegerType())])

    def merged(table: pa.Table, bucket: int) -> pa.Table:
        """The rows of one group, pooled."""
        out = pooled(*(table.column(c).to_numpy() for c in NAMES))
        g = table.column("g").combine_chunks().take(pa.array([0] * len(out[0])))
        return pa.Table.from_arrays([g, *map(pa.array, out), pa.array([bucket] * len(out[0]), pa.int32())], ["g", *NAMES, "bucket"])

    def first(batches):
        if held := [b for b in batches if b.num_rows]:
            table, places = pa.Table.from_batches(held), {}
            for i, g in enumerate(table.column("g").to_pylist()):  # a bucket is a range of (group, x): few groups
                places.setdefault(tuple(g.values()), []).append(i)
            for at in places.values():
                yield from merged(table.take(pa.array(at)), TaskContext.get().partitionId()).to_batches()

    def again(table: pa.Table) -> pa.Table:
        return merged(table, table.column("bucket")[0].as_py() // FAN)

    blocks = stored(ranged.mapInArrow(first, schema), "isotonic")
    while n > 1:
        blocks = stored(blocks.groupBy("g", F.floor(F.col("bucket") / FAN)).applyInArrow(again, schema), "isotonic")
        n = -(-n // FAN)
    return blocks.select(*[F.col("g")[c].alias(c) for c in by], "low", "high", (F.col("total") / F.col("weight")).alias("mean"), "weight")
