"""Reproducible stratified hold-out and repeated stratified k-fold.

Rows have no order, so the shuffle is a hash order: within each class rows are
ranked by md5(seed|id) (id breaks hash ties). Class quotas are computed on the
driver from the class counts (one row per class) by largest remainder, exactly
like the stratified splitter's approximate mode. A split needs one key per class, the last of its
quota, found by narrowing histograms (``operators/cuts.py``): the split column is then a comparison,
without a shuffle of rows. Folds need ranks; they come from ``ordered_prefix``, so a class holding most
rows is still ranked in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.operators.cuts import Cuts, cuts_before, group_is
from churnlens.operators.ordered import ordered_prefix
from churnlens.sources.fixtures import uniform


def class_quotas(counts: dict, n_take: int) -> dict:
    """Largest-remainder allocation of ``n_take`` across classes, ties to the smaller label."""
    n = sum(counts.values())
    exact = {k: n_take * c / n for k, c in counts.items()}
    quota = {k: math.floor(v) for k, v in exact.items()}
    left = n_take - sum(quota.values())
    for k in sorted(counts, key=lambda k: (-(exact[k] - quota[k]), k))[:left]:
        quota[k] += 1
    return quota


def stratified_split(df: DataFrame, y: str = S.TARGET, test_size: float = 0.2, seed: int = 42,
                     key: str = S.ID) -> DataFrame:
    """Add column ``split`` ('train' | 'test'); n_test = ceil(test_size · n), class quotas
    by largest remainder (7,043 rows with 1,869 positives at 0.2 → test 1,409 with 374)."""
    d = df.withColumn("_h", uniform(f"split{seed}", F.col(key)))
    cuts = Cuts(d, [("_h", False), (key, False)], [y])
    sizes = {g[0]: n for g, n in cuts.sizes.items()}  # one row per class
    quota = class_quotas(sizes, math.ceil(test_size * sum(sizes.values())))
    last = cuts.at({(k,): [q] for k, q in quota.items() if q})
    test = F.lit(False)
    for group, keys in last.items():
        test = test | (group_is(cuts, group) & (cuts_before(cuts, keys) == 0))
    return d.withColumn("split", F.when(test, "test").otherwise("train")).drop("_h")


def stratified_folds(df: DataFrame, y: str = S.TARGET, n_splits: int = 5, n_repeats: int = 3, seed: int = 42,
                     key: str = S.ID, keep: Sequence[str] = ()) -> DataFrame:
    """Long table (key, y, *keep, repeat, fold): per repeat rows are ranked within class by a
    repeat-specific hash and dealt round-robin to folds, each class continuing where the
    previous class stopped so folds are balanced in size and in class mix. ``keep``: columns that
    come along, so that fold and row needn't be joined."""
    counts = sorted((r[0], r[1]) for r in df.groupBy(y).count().collect())
    offsets, acc = {}, 0
    for k, c in counts:
        offsets[k] = acc % n_splits
        acc += c
    off = F.create_map(*[x for k, v in offsets.items() for x in (F.lit(k), F.lit(v))])
    # all repeats ranked in ONE distributed pass: explode the repeat index, then rank within
    # (repeat, class) by the repeat's hash md5("fold<seed>|<repeat>|<id>")
    reps = df.select(key, y, *keep, F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("repeat"))
    tag = F.concat(F.lit(f"fold{seed}|"), F.col("repeat").cast("string"), F.lit("|"), F.col(key).cast("string"))
    reps = reps.withColumn("_h", F.conv(F.substring(F.md5(tag), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0))
    # the hash is even by itself: its leading part is the bucket, nothing has to be sampled
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = ordered_prefix(reps, [("_h", False)], partition=["repeat", y], tiebreak=key, rn="_rk", write=False,
                            bucket=F.floor(F.col("_h") * buckets).cast("int"))
    return ranked.select(key, y, *keep, F.col("repeat").cast("int").alias("repeat"),
                         F.pmod(F.col("_rk") - 1 + off[F.col(y)], F.lit(n_splits)).cast("int").alias("fold"))
