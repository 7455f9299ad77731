"""Risk deciles, lift table and contact queues.

Every queue is a total order ``(key, customerID)``: rows have no intrinsic
order in Spark, so "row order" tie-breaks become id order everywhere. Deciles need
their nine cut keys only (``operators/cuts.py``); positions come from the distributed
``ordered_prefix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.operators.cuts import Cuts, cut_table, cuts_before, cuts_before_in
from churnlens.operators.lookup import lookup
from churnlens.operators.ordered import ordered_prefix, stored
from churnlens.sources.fixtures import uniform


def decile_expr(rn: Column, n: Column, k: int = 10) -> Column:
    """T1 rule in exact integer arithmetic: greatest(1, ceil((rn - 1) * k / (n - 1)))."""
    a = (rn - 1) * k + (n - 2)
    b = n - 1
    return F.when(n > 1, F.greatest(F.lit(1), ((a - F.pmod(a, b)) / b).cast("int"))).otherwise(F.lit(1))


def deciles(df: DataFrame, p: str = "p", key: str = S.ID, k: int = 10, n: int | None = None) -> DataFrame:
    """G1: decile of risk — rank by p descending, ties by id; bucket sizes follow pd.qcut
    on ranks (the short bucket lands in the middle, e.g. 141×5, 140, 141×4 for 1,409 rows)."""
    n_col = df.agg(F.count(F.lit(1))).scalar() if n is None else F.lit(n)
    ranked = ordered_prefix(df, [(p, True)], tiebreak=key, rn="rank", n=n)
    return ranked.withColumn("decile", decile_expr(F.col("rank"), n_col, k))


def decile_ends(n: int, k: int = 10) -> list[int]:
    """The last rank of each decile but the last, by ``decile_expr``'s rule."""
    return [d * (n - 1) // k + 1 for d in range(1, k)]


def with_decile(df: DataFrame, p: str = "p", key: str = S.ID, k: int = 10) -> DataFrame:
    """G1 without the ranks: the rows and their decile, by comparison with the cut keys; rows don't move."""
    cuts = Cuts(df, [(p, True), (key, False)])
    n = cuts.sizes.get((), 0)
    keys = cuts.at({(): decile_ends(n, k)})[()] if n else []
    return df.withColumn("decile", cuts_before(cuts, keys) + 1)


def lift_table(df: DataFrame, y: str = "y", p: str = "p", key: str = S.ID, k: int = 10) -> DataFrame:
    """Per decile n, churns, rate, lift, running churns and cumulative capture.

    Raises ValueError on fewer rows than deciles or no positive label (the reference guards)."""
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y)).alias("pos")).first()
    if stats["n"] < k:
        raise ValueError(f"lift by decile needs at least {k} customers, got {stats['n']}")
    if not stats["pos"]:
        raise ValueError("lift by decile is undefined for a slice with no churn")
    base = stats["pos"] / stats["n"]
    per = with_decile(df, p, key, k).groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y)).cast("long").alias("churns"),
        F.avg(F.col(y).cast("double")).alias("churn_rate"))
    w = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # k rows only
    return per.select(
        "decile", "n", "churns", "churn_rate",
        (F.col("churn_rate") / F.lit(base)).alias("lift"),
        F.sum("churns").over(w).alias("cum_churns"),
        (F.sum("churns").over(w) / F.lit(float(stats["pos"]))).alias("cum_capture"))


def random_key(seed: int, key: str = S.ID) -> Column:
    """Reproducible random queue position: u = md5(seed|id) as a uniform."""
    return uniform(str(seed), F.col(key))


def queue_curve(df: DataFrame, sort_key: Column, value: str = "ve", key: str = S.ID,
                descending: bool = True) -> DataFrame:
    """Campaign curve for one queue: (contacted, cum_value, marginal)."""
    d = df.withColumn("_k", sort_key)
    c = ordered_prefix(d, [("_k", descending)], sums=[value], tiebreak=key, rn="contacted")
    return c.select(key, "contacted", F.col(f"cum_{value}").alias("cum_profit"), F.col(value).alias("marginal_ve"))


def lift_by(df: DataFrame, by: list[str], y: str = "y", p: str = "p", key: str = S.ID, k: int = 10) -> DataFrame:
    """G2 for many score sets at once (e.g. one per model): deciles inside each group."""
    df = stored(df.select(*by, key, p, y))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y)).alias("_pos"))
    bad = sizes.filter((F.col("_n") < k) | (F.col("_pos") == 0)).limit(1).collect()
    if bad:
        raise ValueError(f"lift by decile needs >= {k} rows and a positive label per group: {bad[0].asDict()}")
    cuts = Cuts(df, [(p, True), (key, False)], by)
    held = cut_table(df, cuts, cuts.at({g: decile_ends(n, k) for g, n in cuts.sizes.items()})).join(sizes, by)
    ranked = lookup(df, held, by).withColumn("decile", cuts_before_in(cuts, "_cuts") + 1)
    per = ranked.groupBy(*by, "decile").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y)).cast("long").alias("churns"),
        F.avg(F.col(y).cast("double")).alias("churn_rate"), F.first("_n").alias("_n"), F.first("_pos").alias("_pos"))
    w = Window.partitionBy(*by).orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.select(
        *by, "decile", "n", "churns", "churn_rate",
        (F.col("churn_rate") / (F.col("_pos") / F.col("_n"))).alias("lift"),
        F.sum("churns").over(w).alias("cum_churns"),
        (F.sum("churns").over(w) / F.col("_pos")).alias("cum_capture"))
