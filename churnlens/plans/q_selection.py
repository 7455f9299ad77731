"""Registered queries: splits, cross-validation tables and model choice on SQL-expressible scorers (I, E8, F18, F19).

The full model ladder (logistic, boosting, ensembles) is trained by the jobs and
tested in tests/; these registered queries cover the relational part of model
selection with two scorers that need no iterative fitting, so every step has a
DuckDB oracle: the fixed scorecard ``p_score`` and the contract rule (J5),
re-fitted on each training fold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.operators import selection as SEL
from churnlens.operators import splits as SP
from churnlens.oracle import with_s
from churnlens.plans.catalog import register
from churnlens.plans.inputs import s_treated

FOLDS_SQL = """
, cnt AS (SELECT Churn, count(*) AS c FROM t GROUP BY Churn),
off AS (SELECT Churn, (coalesce(sum(c) OVER (ORDER BY Churn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 5)
        AS o FROM cnt),
rep AS (SELECT unnest(range(3)) AS r),
rk AS (SELECT customerID, t.Churn, r AS repeat,
         row_number() OVER (PARTITION BY r, t.Churn ORDER BY
           cast(concat('0x', substr(md5(concat('fold42|' || r::varchar, '|', customerID)), 1, 8)) AS bigint), customerID) AS rn
       FROM t, rep),
folds AS (SELECT customerID, rk.Churn, repeat::integer AS repeat, ((rn - 1 + o) % 5)::integer AS fold
          FROM rk JOIN off ON rk.Churn = off.Churn)"""

SPLIT_SQL = """
, cnt AS (SELECT Churn, count(*) AS c, sum(count(*)) OVER () AS n FROM t GROUP BY Churn),
ex AS (SELECT Churn, c, ceil(0.2 * n) * c / n AS e FROM cnt),
fl AS (SELECT Churn, floor(e) AS q, e - floor(e) AS rem FROM ex),
need AS (SELECT (SELECT ceil(0.2 * count(*)) FROM t) - sum(q) AS k FROM fl),
quota AS (SELECT Churn, q + CASE WHEN row_number() OVER (ORDER BY rem DESC, Churn) <= (SELECT k FROM need) THEN 1 ELSE 0 END AS qt
          FROM fl),
rk AS (SELECT customerID, Churn, row_number() OVER (PARTITION BY Churn ORDER BY
         cast(concat('0x', substr(md5(concat('split42', '|', customerID)), 1, 8)) AS bigint), customerID) AS rn FROM t),
split AS (SELECT customerID, rk.Churn, CASE WHEN rn <= qt THEN 'test' ELSE 'train' END AS split
          FROM rk JOIN quota ON rk.Churn = quota.Churn)"""


@register("stratified_split", with_s(SPLIT_SQL + "\nSELECT customerID, Churn, split FROM split"))
def stratified_split(spark, sf):
    """Stratified hold-out, 20 % test, largest-remainder class quotas."""
    return SP.stratified_split(s_treated(spark, sf)).select("customerID", "Churn", "split")


@register("split_summary", with_s(SPLIT_SQL + """
SELECT split, count(*) AS n, sum(Churn)::bigint AS positives FROM split GROUP BY split"""))
def split_summary(spark, sf):
    """I1 check: sizes and positives per side."""
    s = SP.stratified_split(s_treated(spark, sf))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("Churn").cast("bigint").alias("positives"))


@register("cv_folds", with_s(FOLDS_SQL + "\nSELECT customerID, Churn, repeat, fold FROM folds"))
def cv_folds(spark, sf):
    """Repeated stratified 5-fold assignment, 3 repeats (long format)."""
    return SP.stratified_folds(s_treated(spark, sf), n_splits=5, n_repeats=3)


SCORES_SQL = FOLDS_SQL + """
, fagg AS (SELECT f.repeat, f.fold, (t.Contract = 'Month-to-month') AS flag, sum(t.Churn) AS s, count(*) AS c
           FROM folds f JOIN t USING (customerID) GROUP BY ALL),
tr AS (SELECT a.repeat, a.fold, a.flag, sum(b.s)::double / sum(b.c)::double AS rate FROM fagg a JOIN fagg b
       ON a.repeat = b.repeat AND a.flag = b.flag AND b.fold <> a.fold GROUP BY ALL),
val AS (
  SELECT 'scorecard' AS model, f.repeat, f.fold, t.customerID, t.Churn AS y, t.p_score AS p FROM folds f JOIN t USING (customerID)
  UNION ALL
  SELECT 'contract_rule', f.repeat, f.fold, t.customerID, t.Churn, tr.rate FROM folds f JOIN t USING (customerID)
  JOIN tr ON tr.repeat = f.repeat AND tr.fold = f.fold AND tr.flag = (t.Contract = 'Month-to-month')),
g AS (SELECT model, repeat, fold, p, sum(y)::double AS pos, sum(1 - y)::double AS neg FROM val GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps FROM g
      WINDOW w AS (PARTITION BY model, repeat, fold ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
tot AS (SELECT model, repeat, fold, sum(pos) AS n_pos, sum(neg) AS n_neg FROM g GROUP BY ALL),
rkm AS (SELECT c.model, c.repeat, c.fold, sum(neg * ((tps - pos) + pos / 2.0) / (n_pos * n_neg)) AS roc_auc,
               sum(pos / n_pos * tps / (tps + fps)) AS pr_auc
        FROM c JOIN tot USING (model, repeat, fold) GROUP BY ALL),
br AS (SELECT model, repeat, fold, avg((p - y) * (p - y)) AS brier FROM val GROUP BY ALL),
fs AS (SELECT * FROM rkm JOIN br USING (model, repeat, fold))"""


def _fold_scores(spark, sf):
    return SEL.rule_and_scorecard_fold_scores(s_treated(spark, sf))


@register("cv_fold_scores", with_s(SCORES_SQL + """
SELECT model, repeat, fold, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier FROM fs"""))
def cv_fold_scores(spark, sf):
    """Per (model, repeat, fold) validation metrics, all folds in one job."""
    f = _fold_scores(spark, sf)
    return f.select("model", "repeat", "fold", *[F.round(c, 6).alias(c) for c in ["roc_auc", "pr_auc", "brier"]])


@register("cv_summary", with_s(SCORES_SQL + """
SELECT model, round(avg(roc_auc), 6) AS roc_auc_mean, round(stddev_pop(roc_auc), 6) AS roc_auc_std,
       round(avg(pr_auc), 6) AS pr_auc_mean, round(stddev_pop(pr_auc), 6) AS pr_auc_std,
       round(avg(brier), 6) AS brier_mean, round(stddev_pop(brier), 6) AS brier_std, count(*) AS n_fits
FROM fs GROUP BY model"""))
def cv_summary(spark, sf):
    """fold mean and population std per metric and model."""
    s = SEL.cv_summary(_fold_scores(spark, sf))
    return s.select("model", *[F.round(c, 6).alias(c) for c in s.columns if c not in ("model", "n_fits")], "n_fits")


@register("paired_comparison", with_s(SCORES_SQL + """
, d AS (SELECT a.model, a.pr_auc AS pr, a.pr_auc - b.pr_auc AS diff FROM fs a JOIN fs b
        ON a.repeat = b.repeat AND a.fold = b.fold AND b.model = 'scorecard')
SELECT model, round(avg(pr), 6) AS pr_auc_mean, round(avg(diff), 6) AS diff_mean, round(stddev_pop(diff), 6) AS diff_std,
       count(*) FILTER (WHERE diff > 0) AS folds_won, count(*) AS n_folds FROM d GROUP BY model"""))
def paired_comparison(spark, sf):
    """Per-fold PR-AUC difference against a reference model on the same folds."""
    p = SEL.paired_comparison(_fold_scores(spark, sf), reference="scorecard")
    return p.select("model", *[F.round(c, 6).alias(c) for c in ["pr_auc_mean", "diff_mean", "diff_std"]],
                    "folds_won", "n_folds")
