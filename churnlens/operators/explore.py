"""Filters, segment profiles and descriptive statistics.

Every profile over many columns is computed in ONE pass: the columns are
unpivoted to (column, value) pairs and grouped once, instead of one job per
column. Groups are small (a handful of categories), so Spark's partial
(map-side) aggregation collapses each partition before the shuffle; even a
category holding a third of all rows costs one partial row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.functions.treat import addon_count
from churnlens.operators.distributions import box_table, histograms
from churnlens.operators.lookup import lookup
from churnlens.operators.ordered import stored
from churnlens.operators.stats import exact_quantiles


def _stack(df: DataFrame, cols: list[str], extra: list[str] | None = None) -> DataFrame:
    """Unpivot ``cols`` to (column, value) with value as text; keeps ``extra`` columns."""
    return df.select(*(extra or []), *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        ids=extra or [], values=cols, variableColumnName="column", valueColumnName="value")


# ---------------------------------------------------------------- filters (D)

def segment_filter(df: DataFrame, column: str, value, negate: bool = False) -> DataFrame:
    """Equality / inequality filter (pushed to the scan when on a source column)."""
    cond = F.col(column) == value
    return df.filter(~cond if negate else cond)


def price_band(df: DataFrame, lo: float = 67.75, hi: float = 94.80, column: str = "MonthlyCharges") -> DataFrame:
    """Inclusive range."""
    return df.filter(F.col(column).between(lo, hi))


def early_monthly_cohort(df: DataFrame, max_tenure: int = 12) -> DataFrame:
    """D3: month-to-month AND tenure <= 12."""
    return df.filter((F.col("Contract") == S.MONTH_TO_MONTH) & (F.col("tenure") <= max_tenure))


def rare_categories(df: DataFrame, cols: list[str], threshold: float = 0.05) -> DataFrame:
    """Categories whose share inside their column is below ``threshold``."""
    shares = value_shares(df, cols)
    return shares.filter(F.col("share") < threshold)


def all_binary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column, are all non-null values in {0, 1}?"""
    st = _stack(df, cols)
    return st.groupBy("column").agg(
        F.coalesce(F.bool_and(F.when(F.col("value").isNotNull(), F.col("value").isin("0", "1"))), F.lit(True))
        .alias("is_binary"))


# ------------------------------------------------------------ aggregates (F)

def base_rate(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """base churn rate and n."""
    return df.agg(F.avg(F.col(target).cast("double")).alias("base_rate"), F.count(F.lit(1)).alias("n"))


def churn_by_category(df: DataFrame, column: str, target: str = S.TARGET) -> DataFrame:
    """churn rate and n per category, rate descending (G6: sorted result)."""
    return (df.groupBy(column)
            .agg(F.avg(F.col(target).cast("double")).alias("churn_rate"), F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("churn_rate"), F.col(column)))


def churn_by_many(df: DataFrame, cols: list[str], target: str = S.TARGET) -> DataFrame:
    """F2 over many columns in one pass, with base rate and above-base flag."""
    st = _stack(df, cols, [target])
    per = st.groupBy("column", "value").agg(
        F.avg(F.col(target).cast("double")).alias("churn_rate"), F.count(F.lit(1)).alias("n"))
    base = df.agg(F.avg(F.col(target).cast("double"))).scalar()  # scalar subquery
    return (per.withColumn("base_rate", base)
            .withColumn("above_base", F.col("churn_rate") > F.col("base_rate")))


def value_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    """normalised value counts per column (nulls excluded, like value_counts)."""
    st = _stack(df, cols).filter(F.col("value").isNotNull())
    counts = st.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "column").select(
        "column", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def describe(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear interpolation), max — unpivoted. The columns are
    written once: the quantiles read them several times."""
    st = (df if approx else stored(df.select(*cols), "numerics")).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])).alias("kv")
    ).select("kv.column", "kv.x")
    moments = st.groupBy("column").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    q = exact_quantiles(st, "x", [0.25, 0.5, 0.75], by=["column"], approx=approx)
    q = q.groupBy("column").pivot("q", [0.25, 0.5, 0.75]).agg(F.first("value"))
    q = q.select("column", F.col("`0.25`").alias("p25"), F.col("`0.5`").alias("p50"), F.col("`0.75`").alias("p75"))
    return moments.join(q, "column")


def medians_by_class(df: DataFrame, cols: list[str], target: str = S.TARGET, approx: bool = False) -> DataFrame:
    """median of each numeric per class, unpivoted to (class, column, median). The columns are written once:
    the quantiles read them several times."""
    st = (df if approx else stored(df.select(target, *cols), "numerics")).select(target, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])).alias("kv")
    ).select(target, "kv.column", "kv.x")
    q = exact_quantiles(st, "x", [0.5], by=[target, "column"], approx=approx)
    return q.select(target, "column", F.col("value").alias("median"))


def group_summary(df: DataFrame, by: str, x: str, approx: bool = False) -> DataFrame:
    """mean, median, min, max, size per group, rounded to 2 (half-even)."""
    agg = df.groupBy(by).agg(F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
                             F.count(F.lit(1)).alias("size"))
    med = exact_quantiles(df.select(by, F.col(x).cast("double").alias("x")), "x", [0.5], by=[by], approx=approx)
    return agg.join(med.select(by, F.col("value").alias("median")), by).select(
        by, F.bround("mean", 2).alias("mean"), F.bround("median", 2).alias("median"),
        F.bround("min", 2).alias("min"), F.bround("max", 2).alias("max"), "size")


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlations of all pairs in ONE aggregate, unpivoted to (a, b, r)."""
    pairs = [(a, b) for a in cols for b in cols]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]))
        .alias("kv")).select("kv.a", "kv.b", "kv.r")


def histogram(df: DataFrame, x: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """F10 / F11 of one column (``distributions.histograms``)."""
    return histograms(df, [x], bins, by).drop("column")


def box_stats(df: DataFrame, x: str, by: str = S.TARGET, approx: bool = False) -> DataFrame:
    """F12 of one column (``distributions.box_table``)."""
    return box_table(df, [x], by, approx).drop("column")


def quartile_bins(df: DataFrame, x: str, q: int = 4, approx: bool = False, by: list[str] | None = None) -> DataFrame:
    """Pd.qcut-style quantile bins — right-closed, lowest included; error on equal edges, the
    least and the greatest value among them.

    bin = 1 + number of inner edges strictly below x (equal to qcut for distinct edges).
    """
    probs = [i / q for i in range(q + 1)]
    keys = by or []
    edges = exact_quantiles(df.select(*keys, F.col(x).cast("double").alias("x")), "x", probs, by=keys, approx=approx)
    arr = edges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("q", "value"))).alias("e")) \
        .select(*keys, F.transform("e", lambda s: s["value"]).alias("edges"))
    arr = stored(arr, "edges")  # one row per group
    dup = arr.filter(F.size(F.array_distinct("edges")) < F.size("edges")).limit(1).collect()
    if dup:
        raise ValueError(f"quantile bin edges are not unique: {dup[0]['edges']}")
    arr = arr.withColumn("edges", F.slice("edges", 2, q - 1))
    j = lookup(df, arr, keys) if keys else df.withColumn("edges", arr.select("edges").scalar())
    return j.withColumn("bin", F.lit(1) + F.size(F.filter("edges", lambda e: e < F.col(x)))).drop("edges")


def price_quartile_profile(df: DataFrame, internet: str = "Fiber optic", approx: bool = False) -> DataFrame:
    """F8: inside one internet segment, per price quartile: rate, n, median tenure,
    median add-on count, share month-to-month."""
    seg = df.filter(F.col("InternetService") == internet).withColumn("n_addons", addon_count())
    binned = quartile_bins(seg, "MonthlyCharges", 4, approx=approx)
    agg = binned.groupBy("bin").agg(
        F.avg(F.col(S.TARGET).cast("double")).alias("churn_rate"), F.count(F.lit(1)).alias("n"),
        F.avg((F.col("Contract") == S.MONTH_TO_MONTH).cast("double")).alias("share_month_to_month"))
    med = exact_quantiles(
        binned.select("bin", F.explode(F.array(
            F.struct(F.lit("tenure").alias("column"), F.col("tenure").cast("double").alias("x")),
            F.struct(F.lit("n_addons").alias("column"), F.col("n_addons").cast("double").alias("x")))).alias("kv"))
        .select("bin", "kv.column", "kv.x"), "x", [0.5], by=["bin", "column"], approx=approx)
    med = med.groupBy("bin").pivot("column", ["tenure", "n_addons"]).agg(F.first("value")).select(
        "bin", F.col("tenure").alias("median_tenure"), F.col("n_addons").alias("median_addons"))
    return agg.join(med, "bin").select(
        F.col("bin").alias("price_quartile"), F.bround("churn_rate", 3).alias("churn_rate"), "n",
        F.col("median_tenure"), F.col("median_addons"), F.bround("share_month_to_month", 3).alias("share_month_to_month"))


def controlled_comparison(df: DataFrame, approx: bool = False) -> DataFrame:
    """fibre vs DSL in (a) the same price band and (b) month-to-month with tenure <= 12."""
    with_net = df.filter(F.col("InternetService") != "No")
    a = price_band(with_net).withColumn("control", F.lit("same_price_band"))
    b = early_monthly_cohort(with_net).withColumn("control", F.lit("m2m_tenure_le_12"))
    both = a.unionByName(b)
    return both.groupBy("control", "InternetService").agg(
        F.bround(F.avg(F.col(S.TARGET).cast("double")), 3).alias("churn_rate"), F.count(F.lit(1)).alias("n"))


def implication_check(df: DataFrame, antecedent: str, antecedent_value: str, consequents: list[str],
                      forbidden: str = "Yes") -> DataFrame:
    """Crosstab counts of (antecedent value, consequent value) and violations per column."""
    st = _stack(df, consequents, [antecedent])
    ct = st.groupBy("column", antecedent, "value").agg(F.count(F.lit(1)).alias("n"))
    return ct.withColumn("violation", (F.col(antecedent) == antecedent_value) & (F.col("value") == forbidden))
