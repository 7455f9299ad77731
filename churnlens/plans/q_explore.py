"""Registered queries: projections (C), filters (D), aggregates (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.functions import treat as TR
from churnlens.operators import explore as X
from churnlens.operators.distributions import kde_table
from churnlens.oracle import with_r, with_s
from churnlens.plans.catalog import register
from churnlens.plans.inputs import r_table, s_raw, s_treated

R6 = 6  # decimals for rates in compared outputs


@register("treated_subscribers", with_s("SELECT * FROM t"))
def treated_subscribers(spark, sf):
    """The whole row-local treatment as one projection."""
    return s_treated(spark, sf)


@register("real_subscribers", with_r("SELECT * FROM r"))
def real_subscribers(spark, sf):
    """R: subscribers from orders ⋈ customer ⋈ nation."""
    return r_table(spark, sf)


@register("base_rate", with_s("SELECT round(avg(Churn::double), 6) AS base_rate, count(*) AS n FROM t"))
def base_rate(spark, sf):
    """F1."""
    return X.base_rate(s_treated(spark, sf)).select(F.round("base_rate", R6).alias("base_rate"), "n")


@register("churn_by_contract", with_s(
    "SELECT Contract, round(avg(Churn::double), 6) AS churn_rate, count(*) AS n FROM t GROUP BY Contract"))
def churn_by_contract(spark, sf):
    """F2 (and the flagship query)."""
    df = X.churn_by_category(s_treated(spark, sf), "Contract")
    return df.select("Contract", F.round("churn_rate", R6).alias("churn_rate"), "n")


_BIV = ["Contract", "PaymentMethod", "InternetService", "OnlineSecurity", "TechSupport", "OnlineBackup",
        "DeviceProtection", "SeniorCitizen", "Partner", "Dependents", "PaperlessBilling"]
_UNPIVOT_BIV = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::varchar AS value, Churn FROM t" for c in _BIV)


@register("churn_by_many", with_s(f"""
SELECT "column", value, round(avg(Churn::double), 6) AS churn_rate, count(*) AS n,
  round((SELECT avg(Churn::double) FROM t), 6) AS base_rate,
  avg(Churn::double) > (SELECT avg(Churn::double) FROM t) AS above_base
FROM ({_UNPIVOT_BIV}) x GROUP BY "column", value"""))
def churn_by_many(spark, sf):
    """Churn rate per category of 11 columns in one pass, with base and flag."""
    df = X.churn_by_many(s_treated(spark, sf), _BIV)
    return df.select("column", "value", F.round("churn_rate", R6).alias("churn_rate"), "n",
                     F.round("base_rate", R6).alias("base_rate"), "above_base")


_CAT16 = ["gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService", "MultipleLines", "InternetService",
          *S.ADDONS, "Contract", "PaperlessBilling", "PaymentMethod"]
_UNPIVOT_16 = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::varchar AS value FROM t" for c in _CAT16)
_SHARES_SQL = f"""
, st AS ({_UNPIVOT_16}), c AS (SELECT "column", value, count(*) AS n FROM st WHERE value IS NOT NULL GROUP BY ALL)
SELECT "column", value, n, round(n / sum(n) OVER (PARTITION BY "column"), 6) AS share FROM c"""


@register("value_shares", with_s(_SHARES_SQL))
def value_shares(spark, sf):
    """normalised value counts of 16 columns."""
    df = X.value_shares(s_treated(spark, sf), _CAT16)
    return df.select("column", "value", "n", F.round("share", R6).alias("share"))


@register("rare_categories", with_s(_SHARES_SQL.replace(
    'SELECT "column", value, n, round(', 'SELECT * FROM (SELECT "column", value, n, round(') + ") WHERE share < 0.05"))
def rare_categories_5pct(spark, sf):
    """D5 with the EDA's 5 % threshold (S has no category that rare, so the answer is empty)."""
    df = X.rare_categories(s_treated(spark, sf), _CAT16, threshold=0.05)
    return df.select("column", "value", "n", F.round("share", R6).alias("share"))


@register("rare_categories_10pct", with_s(_SHARES_SQL.replace(
    'SELECT "column", value, n, round(', 'SELECT * FROM (SELECT "column", value, n, round(') + ") WHERE share < 0.10"))
def rare_categories(spark, sf):
    """Categories whose share is below a threshold (10% here; the EDA used 5%)."""
    df = X.rare_categories(s_treated(spark, sf), _CAT16, threshold=0.10)
    return df.select("column", "value", "n", F.round("share", R6).alias("share"))


_DESC_SQL = " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, min({c})::double AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
  round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c})::double AS max
  FROM t""" for c in S.NUMERIC)


def _round_desc(df):
    return df.select("column", "count", *[F.round(c, R6).alias(c) for c in ["mean", "std"]],
                     "min", *[F.round(c, R6).alias(c) for c in ["p25", "p50", "p75"]], "max")


@register("describe_numeric", with_s(_DESC_SQL))
def describe_numeric(spark, sf):
    """count, mean, sample std, min, quartiles, max of the 3 numerics."""
    return _round_desc(X.describe(s_treated(spark, sf), S.NUMERIC))


@register("describe_residual", with_s("""
SELECT 'residual' AS "column", count(r) AS count, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std,
  round(min(r), 6) AS min, round(quantile_cont(r, 0.25), 6) AS p25, round(quantile_cont(r, 0.5), 6) AS p50,
  round(quantile_cont(r, 0.75), 6) AS p75, round(max(r), 6) AS max
FROM (SELECT TotalCharges - tenure * MonthlyCharges AS r FROM t)"""))
def describe_residual(spark, sf):
    """C8 + F5: residual of total against tenure × monthly, described."""
    df = s_treated(spark, sf).select(TR.total_residual().alias("residual"))
    d = X.describe(df, ["residual"])
    return d.select("column", "count", *[F.round(c, R6).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


_MED_SQL = " UNION ALL ".join(
    f"SELECT Churn, '{c}' AS \"column\", round(quantile_cont({c}, 0.5), 6) AS median FROM t GROUP BY Churn"
    for c in S.NUMERIC)


@register("medians_by_class", with_s(_MED_SQL))
def medians_by_class(spark, sf):
    """medians of the 3 numerics per class."""
    df = X.medians_by_class(s_treated(spark, sf), S.NUMERIC)
    return df.select("Churn", "column", F.round("median", R6).alias("median"))


@register("monthly_by_internet", with_s("""
SELECT InternetService, round_even(avg(MonthlyCharges), 2) AS mean, round_even(quantile_cont(MonthlyCharges, 0.5), 2) AS median,
  round_even(min(MonthlyCharges), 2) AS min, round_even(max(MonthlyCharges), 2) AS max, count(*) AS size
FROM t GROUP BY InternetService"""))
def monthly_by_internet(spark, sf):
    """mean/median/min/max/size of monthly charges per internet type."""
    return X.group_summary(s_treated(spark, sf), "InternetService", "MonthlyCharges")


@register("fibre_price_quartiles", with_s("""
, f AS (SELECT *, OnlineSecurity + OnlineBackup + DeviceProtection + TechSupport + StreamingTV + StreamingMovies AS n_addons
        FROM t WHERE InternetService = 'Fiber optic'),
e AS (SELECT quantile_cont(MonthlyCharges, [0.25, 0.5, 0.75]) AS edges FROM f),
b AS (SELECT f.*, 1 + len(list_filter(edges, lambda x: x < MonthlyCharges)) AS bin FROM f, e)
SELECT bin::integer AS price_quartile, round_even(avg(Churn::double), 3) AS churn_rate, count(*) AS n,
  quantile_cont(tenure, 0.5) AS median_tenure, quantile_cont(n_addons, 0.5) AS median_addons,
  round_even(avg((Contract = 'Month-to-month')::int::double), 3) AS share_month_to_month
FROM b GROUP BY bin"""))
def fibre_price_quartiles(spark, sf):
    """F8 + G4: inside fibre, profile by price quartile (qcut edges, right-closed)."""
    df = X.price_quartile_profile(s_treated(spark, sf))
    return df.select(F.col("price_quartile").cast("int").alias("price_quartile"), "churn_rate", "n",
                     "median_tenure", "median_addons", "share_month_to_month")


_PAIRS = [(a, b) for a in S.NUMERIC for b in S.NUMERIC]


@register("numeric_correlation", with_s(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM t" for a, b in _PAIRS)))
def numeric_correlation(spark, sf):
    """Pearson correlation matrix of the 3 numerics, one aggregate."""
    return X.correlation_matrix(s_treated(spark, sf), S.NUMERIC).select("a", "b", F.round("r", R6).alias("r"))


def _hist_sql(x: str, by: str | None) -> str:
    keys = f"{by}, " if by else ""
    dens = (f", round(n / (sum(n) OVER (PARTITION BY {by}) * (\"right\" - \"left\")), 9) AS density" if by else "")
    return f"""
, rg AS (SELECT min({x}) AS lo, max({x}) AS hi FROM t),
b AS (SELECT {keys}CASE WHEN hi = lo THEN 0 ELSE least(29, cast(floor(({x} - lo) / ((hi - lo) / 30)) AS integer)) END AS bin, lo, hi
      FROM t, rg),
h AS (SELECT {keys}bin, lo + bin * (hi - lo) / 30 AS "left", lo + (bin + 1) * (hi - lo) / 30 AS "right",
      count(*) AS n FROM b GROUP BY ALL)
SELECT {keys}bin, round("left", 6) AS "left", round("right", 6) AS "right", n{dens} FROM h"""


@register("histogram_tenure", with_s(_hist_sql("tenure", None)))
def histogram_tenure(spark, sf):
    """equal-width 30-bin histogram of tenure."""
    h = X.histogram(s_treated(spark, sf), "tenure", 30)
    return h.select("bin", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), "n")


@register("density_monthly_by_class", with_s(_hist_sql("MonthlyCharges", "Churn")))
def density_monthly_by_class(spark, sf):
    """per-class density histogram of monthly charges."""
    h = X.histogram(s_treated(spark, sf), "MonthlyCharges", 30, by="Churn")
    return h.select("Churn", "bin", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), "n",
                    F.round("density", 9).alias("density"))


@register("box_tenure_by_class", with_s("""
, q AS (SELECT Churn, quantile_cont(tenure, 0.25) AS q1, quantile_cont(tenure, 0.5) AS median,
               quantile_cont(tenure, 0.75) AS q3 FROM t GROUP BY Churn),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q)
SELECT f.Churn, q1, median, q3,
  min(CASE WHEN tenure BETWEEN lo_f AND hi_f THEN tenure END)::double AS whisker_lo,
  max(CASE WHEN tenure BETWEEN lo_f AND hi_f THEN tenure END)::double AS whisker_hi,
  count(CASE WHEN NOT (tenure BETWEEN lo_f AND hi_f) THEN 1 END) AS n_outliers
FROM t JOIN f ON t.Churn = f.Churn GROUP BY f.Churn, q1, median, q3"""))
def box_tenure_by_class(spark, sf):
    """box-plot statistics of tenure per class."""
    return X.box_stats(s_treated(spark, sf), "tenure", "Churn")


def _each(sql: str, table: str = "t", cols=S.NUMERIC) -> str:
    """One common table per numeric column from a template, and all of them one under the other."""
    parts = [sql.format(x=c, t=table, c=c) for c in cols]
    return " UNION ALL ".join(f"(SELECT '{c}' AS \"column\", * FROM ({p}))" for c, p in zip(cols, parts, strict=True))


def _bins_sql(by: str | None) -> str:
    keys = f"{by}, " if by else ""
    dens = f", round(n / (sum(n) OVER (PARTITION BY {by}) * (\"right\" - \"left\")), 9) AS density" if by else ""
    return f"""SELECT {keys}bin, round("left", 6) AS "left", round("right", 6) AS "right", n{dens} FROM (
SELECT {keys}bin, lo + bin * (hi - lo) / 30 AS "left", lo + (bin + 1) * (hi - lo) / 30 AS "right", count(*) AS n FROM (
SELECT {keys}CASE WHEN hi = lo THEN 0 ELSE least(29, cast(floor(({{x}} - lo) / ((hi - lo) / 30)) AS integer)) END AS bin, lo, hi
FROM {{t}}, (SELECT min({{x}})::double AS lo, max({{x}})::double AS hi FROM {{t}})) GROUP BY ALL)"""


_BOX_SQL = """SELECT f.Churn, q1, median, q3,
  min(CASE WHEN {x} BETWEEN lo_f AND hi_f THEN {x} END)::double AS whisker_lo, max(CASE WHEN {x} BETWEEN lo_f AND hi_f THEN {x} END)::double AS whisker_hi,
  count(CASE WHEN NOT ({x} BETWEEN lo_f AND hi_f) THEN 1 END) AS n_outliers
FROM {t} JOIN (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM (
  SELECT Churn, quantile_cont({x}::double, 0.25) AS q1, quantile_cont({x}::double, 0.5) AS median, quantile_cont({x}::double, 0.75) AS q3 FROM {t} GROUP BY Churn)) f
  ON {t}.Churn = f.Churn GROUP BY f.Churn, q1, median, q3"""
_BOX_ROUND = 'SELECT "column", Churn, ' + ", ".join(f"round({c}, 6) AS {c}" for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")) + ", n_outliers FROM ("

_KDE_SQL = """SELECT v.Churn, point::integer AS point, round(lo + (hi - lo) * point / 99.0, 6) AS x,
       round(sum(c * exp(-0.5 * ((lo + (hi - lo) * point / 99.0 - v) / h) ^ 2) / sqrt(2 * pi())) / any_value(n * h), 9) AS density
FROM (SELECT Churn, {x}::double AS v, count(*) AS c FROM {t} GROUP BY Churn, {x})  v
JOIN (SELECT Churn, count({x}) AS n, stddev_samp({x}) * pow(count({x})::double, -0.2) AS h FROM {t} GROUP BY Churn) st USING (Churn),
  (SELECT unnest(range(100)) AS point) g, (SELECT min({x})::double AS lo, max({x})::double AS hi FROM {t}) rg GROUP BY v.Churn, point, lo, hi"""


def _tables_of_numerics(prefix: str, register_with, table: str, source, tag: str):
    """F10-F13 of all three numerics, over S or R."""
    def rounded(df, places):
        return df.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in df.columns])

    @register(f"{prefix}histogram_numerics", register_with("\n" + _each(_bins_sql(None), table)))
    def histogram_numerics(spark, sf):
        return rounded(X.histograms(source(spark, sf), S.NUMERIC, 30), {"left": 6, "right": 6})

    @register(f"{prefix}density_numerics_by_class", register_with("\n" + _each(_bins_sql("Churn"), table)))
    def density_numerics_by_class(spark, sf):
        return rounded(X.histograms(source(spark, sf), S.NUMERIC, 30, by="Churn"), {"left": 6, "right": 6, "density": 9})

    @register(f"{prefix}box_numerics_by_class", register_with("\n" + _BOX_ROUND + _each(_BOX_SQL, table) + ")"))
    def box_numerics_by_class(spark, sf):
        return rounded(X.box_table(source(spark, sf), S.NUMERIC, "Churn"), dict.fromkeys(("q1", "median", "q3", "whisker_lo", "whisker_hi"), 6))

    @register(f"{prefix}kde_numerics_by_class", register_with("\n" + _each(_KDE_SQL, table)))
    def kde_numerics_by_class(spark, sf):
        return rounded(kde_table(source(spark, sf), S.NUMERIC, "Churn", 100), {"x": 6, "density": 9})

    for i, fn in enumerate((histogram_numerics, density_numerics_by_class, box_numerics_by_class, kde_numerics_by_class)):
        fn.__doc__ = f"F{10 + i} of tenure, MonthlyCharges and TotalCharges{tag}."


_tables_of_numerics("", with_s, "t", s_treated, "")
_tables_of_numerics("r_", with_r, "r", r_table, " over R")


@register("controlled_fibre_vs_dsl", with_s("""
SELECT 'same_price_band' AS control, InternetService, round_even(avg(Churn::double), 3) AS churn_rate, count(*) AS n
FROM t WHERE InternetService <> 'No' AND MonthlyCharges BETWEEN 67.75 AND 94.80 GROUP BY InternetService
UNION ALL
SELECT 'm2m_tenure_le_12', InternetService, round_even(avg(Churn::double), 3), count(*)
FROM t WHERE InternetService <> 'No' AND Contract = 'Month-to-month' AND tenure <= 12 GROUP BY InternetService"""))
def controlled_fibre_vs_dsl(spark, sf):
    """F14 (D2, D3): fibre vs DSL controlled by price band and by contract + tenure."""
    return X.controlled_comparison(s_treated(spark, sf))


@register("fibre_segment", with_s("SELECT * FROM t WHERE InternetService = 'Fiber optic'"))
def fibre_segment(spark, sf):
    """Equality segment filter (pushed into the projection over the scan)."""
    return X.segment_filter(s_treated(spark, sf), "InternetService", "Fiber optic")


@register("price_band_rows", with_s("SELECT * FROM t WHERE MonthlyCharges BETWEEN 67.75 AND 94.80"))
def price_band_rows(spark, sf):
    """Inclusive price range."""
    return X.price_band(s_treated(spark, sf))


@register("early_monthly_cohort", with_s("SELECT * FROM t WHERE Contract = 'Month-to-month' AND tenure <= 12"))
def early_monthly_cohort(spark, sf):
    """D3: conjunctive cohort."""
    return X.early_monthly_cohort(s_treated(spark, sf))


@register("derived_columns", with_s("""
SELECT customerID, round_even(tenure * MonthlyCharges, 2) AS derived_total,
  round(TotalCharges - tenure * MonthlyCharges, 6) AS residual,
  OnlineSecurity + OnlineBackup + DeviceProtection + TechSupport + StreamingTV + StreamingMovies AS n_addons
FROM t"""))
def derived_columns(spark, sf):
    """Derived total (half-even), residual, add-on count."""
    return s_treated(spark, sf).select(
        "customerID", TR.derived_total().alias("derived_total"),
        F.round(TR.total_residual(), 6).alias("residual"), TR.addon_count().alias("n_addons"))


# ---- the same operators over R, the subscribers derived from orders ⋈ customer ⋈ nation


@register("r_churn_by_contract", with_r(
    "SELECT Contract, round(avg(Churn::double), 6) AS churn_rate, count(*) AS n FROM r GROUP BY Contract"))
def r_churn_by_contract(spark, sf):
    """F2 over R."""
    df = X.churn_by_category(r_table(spark, sf), "Contract")
    return df.select("Contract", F.round("churn_rate", R6).alias("churn_rate"), "n")


@register("r_segment_region_profile", with_r("""
SELECT segment, region, count(*) AS n, round(avg(Churn::double), 6) AS churn_rate,
       round(avg(tenure), 6) AS mean_tenure, round(avg(MonthlyCharges), 6) AS mean_monthly,
       round(sum(TotalCharges), 2) AS total_spend
FROM r GROUP BY segment, region"""))
def r_segment_region_profile(spark, sf):
    """F2 / F7 over R: churn and spend by market segment and region (join-derived keys)."""
    r = r_table(spark, sf)
    return r.groupBy("segment", "region").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("Churn").cast("double")), R6).alias("churn_rate"),
        F.round(F.avg("tenure"), R6).alias("mean_tenure"), F.round(F.avg("MonthlyCharges"), R6).alias("mean_monthly"),
        F.round(F.sum("TotalCharges"), 2).alias("total_spend"))


@register("r_describe_numeric", with_r(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count,
  round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::double AS min,
  round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, max({c})::double AS max FROM r""" for c in S.NUMERIC)))
def r_describe_numeric(spark, sf):
    """F5 over R: exact quartiles of tenure and spend."""
    return _round_desc(X.describe(r_table(spark, sf), S.NUMERIC))
