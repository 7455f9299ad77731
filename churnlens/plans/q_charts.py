"""Registered queries: chart tables (L1-L4, L8), kernel density (F13), label re-attach (E1), baseline drop.

Per-model series use the two scorers that need no iterative fit (fixed scorecard,
contract rule fitted on the training split), scored once on the test split.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.models.learners import ContractRule
from churnlens.operators.ordered import stored
from churnlens.operators import charts as L
from churnlens.operators import decision as K
from churnlens.operators import selection as SEL
from churnlens.operators.splits import stratified_split
from churnlens.oracle import with_s
from churnlens.plans.catalog import register
from churnlens.plans.inputs import s_scored, s_treated
from churnlens.plans.q_decision import Q
from churnlens.plans.q_selection import SCORES_SQL, SPLIT_SQL, _fold_scores

PREDS_SQL = SPLIT_SQL + """
, rates AS (SELECT (t.Contract = 'Month-to-month') AS flag, avg(t.Churn::double) AS rate
            FROM t JOIN split USING (customerID) WHERE split = 'train' GROUP BY flag),
preds AS (
  SELECT 'scorecard' AS model, t.customerID, t.Churn AS y, t.p_score AS p
  FROM t JOIN split USING (customerID) WHERE split = 'test'
  UNION ALL
  SELECT 'contract_rule', t.customerID, t.Churn, rates.rate
  FROM t JOIN split USING (customerID) JOIN rates ON rates.flag = (t.Contract = 'Month-to-month') WHERE split = 'test')"""


def _preds(spark, sf):
    sp = stratified_split(s_treated(spark, sf))
    train, test = sp.filter("split = 'train'"), sp.filter("split = 'test'")
    rule = ContractRule().fit(train)
    unlabeled = test.drop("Churn")
    p_rule = rule.predict(unlabeled).select(F.lit("contract_rule").alias("model"), S.ID, "p")
    p_card = unlabeled.select(F.lit("scorecard").alias("model"), S.ID, F.col("p_score").alias("p"))
    labels = test.select(S.ID, F.col("Churn").alias("y"))
    # Re-attach the label by row identity; the result feeds several jobs, so it is
    # materialised once in the shared checkpoint folder
    return stored(p_card.unionByName(p_rule).join(labels, S.ID), "scores")


def r6(c):
    return F.round(c, 6).alias(c)


@register("test_predictions", with_s(PREDS_SQL + "\nSELECT model, customerID, y, p FROM preds"))
def test_predictions(spark, sf):
    """Per-model test-split probabilities with the label re-attached by id."""
    return _preds(spark, sf).select("model", S.ID, "y", "p")


@register("metric_comparison", with_s(SCORES_SQL + """
, cv AS (SELECT model, avg(roc_auc) AS roc_auc_mean, stddev_pop(roc_auc) AS roc_auc_std, avg(pr_auc) AS pr_auc_mean,
                stddev_pop(pr_auc) AS pr_auc_std, avg(brier) AS brier_mean, stddev_pop(brier) AS brier_std FROM fs GROUP BY model)
SELECT 'roc_auc' AS metric, model, round(roc_auc_mean, 6) AS mean, round(roc_auc_std, 6) AS std, model = 'contract_rule' AS is_baseline FROM cv
UNION ALL SELECT 'pr_auc', model, round(pr_auc_mean, 6), round(pr_auc_std, 6), model = 'contract_rule' FROM cv
UNION ALL SELECT 'brier', model, round(brier_mean, 6), round(brier_std, 6), model = 'contract_rule' FROM cv"""))
def metric_comparison(spark, sf):
    """L1: mean ± std per model and metric, baseline flagged."""
    t = L.metric_comparison(SEL.cv_summary(_fold_scores(spark, sf)))
    return t.select("metric", "model", r6("mean"), r6("std"), "is_baseline")


@register("cv_summary_without_baseline", with_s(SCORES_SQL + """
SELECT model, round(avg(pr_auc), 6) AS pr_auc_mean, count(*) AS n_fits FROM fs WHERE model <> 'contract_rule' GROUP BY model"""))
def cv_summary_without_baseline(spark, sf):
    """A result table with the baseline rows dropped."""
    cv = SEL.drop_baseline(SEL.cv_summary(_fold_scores(spark, sf)))
    return cv.select("model", r6("pr_auc_mean"), "n_fits")


CURVES_SQL = PREDS_SQL + """
, g AS (SELECT model, p, sum(y)::bigint AS pos, sum(1 - y)::bigint AS neg FROM preds GROUP BY model, p),
c AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p DESC) AS rn,
             sum(pos) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tps,
             sum(neg) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fps FROM g),
tot AS (SELECT model, sum(pos)::double AS n_pos, sum(neg)::double AS n_neg, count(*) AS m FROM g GROUP BY model),
nb AS (SELECT c.*, lag(tps) OVER w AS tps_prev, lag(fps) OVER w AS fps_prev, lead(tps) OVER w AS tps_next,
              lead(fps) OVER w AS fps_next FROM c WINDOW w AS (PARTITION BY model ORDER BY rn)),
series AS (
  SELECT model, 'roc' AS curve, 0.0::double AS x, 0.0::double AS y, NULL::double AS threshold FROM tot
  UNION ALL
  SELECT nb.model, 'roc', fps / n_neg, tps / n_pos, p FROM nb JOIN tot USING (model)
  WHERE rn = 1 OR rn = m OR fps_next - 2 * fps + fps_prev <> 0 OR tps_next - 2 * tps + tps_prev <> 0
  UNION ALL
  SELECT c.model, 'pr', tps / n_pos, tps / (tps + fps), p FROM c JOIN tot USING (model)
  UNION ALL
  SELECT model, 'pr', 0.0, 1.0, NULL FROM tot)"""


@register("curve_series", with_s(CURVES_SQL + """
SELECT model, curve, round(x, 6) AS x, round(y, 6) AS y, threshold,
       CASE WHEN model = 'scorecard' THEN 'champion' WHEN model = 'contract_rule' THEN 'baseline' ELSE 'other' END AS role
FROM series"""))
def curve_series(spark, sf):
    """L2: ROC and precision-recall series per model with roles."""
    s = L.curve_series(_preds(spark, sf), champion="scorecard")
    return s.select("model", "curve", r6("x"), r6("y"), "threshold", "role")


@register("calibration_series", with_s(PREDS_SQL + """
, e AS (SELECT model, quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM preds GROUP BY model),
b AS (SELECT preds.*, len(list_filter(edges, lambda v: v < p)) AS bin FROM preds JOIN e USING (model)),
br AS (SELECT model, avg((p - y) * (p - y)) AS brier FROM preds GROUP BY model)
SELECT b.model, bin::integer AS bin, round(avg(p), 6) AS predicted, round(avg(y::double), 6) AS observed, count(*) AS n,
       round(any_value(br.brier), 6) AS brier
FROM b JOIN br USING (model) GROUP BY b.model, bin"""))
def calibration_series(spark, sf):
    """L3: calibration points per model with its Brier score."""
    c = L.calibration_series(_preds(spark, sf))
    return c.select("model", "bin", r6("predicted"), r6("observed"), "n", r6("brier"))


@register("lift_series", with_s(PREDS_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p DESC, customerID) AS rk,
               count(*) OVER (PARTITION BY model) AS nn, sum(y) OVER (PARTITION BY model) AS np FROM preds),
d AS (SELECT *, greatest(1, ((rk - 1) * 10 + (nn - 2)) // (nn - 1))::integer AS decile FROM r),
per AS (SELECT model, decile, count(*) AS n, sum(y)::bigint AS churns, avg(y::double) AS churn_rate,
               any_value(nn) AS nn, any_value(np) AS np FROM d GROUP BY model, decile)
SELECT model, decile, n, churns, round(churn_rate, 6) AS churn_rate, round(churn_rate / (np / nn), 6) AS lift,
       (sum(churns) OVER (PARTITION BY model ORDER BY decile))::bigint AS cum_churns,
       round(sum(churns) OVER (PARTITION BY model ORDER BY decile) / np, 6) AS cum_capture,
       round(decile / 10.0, 6) AS no_model_capture
FROM per"""))
def lift_series(spark, sf):
    """L4: lift / capture per model and decile, with the no-model line."""
    t = L.lift_series(_preds(spark, sf))
    return t.select("model", "decile", "n", "churns", r6("churn_rate"), r6("lift"),
                    F.col("cum_churns").cast("bigint").alias("cum_churns"), r6("cum_capture"), r6("no_model_capture"))


@register("budget_curve", with_s(Q + """
SELECT queue, customerID, contacted, round(cum_profit, 4) AS cum_profit,
       (queue = 'expected_value' AND contacted = n) AS is_optimum FROM cv, opt"""))
def budget_curve(spark, sf):
    """The four queue curves with the optimum flagged."""
    sc = s_scored(spark, sf)
    b = L.budget_curve(K.queue_curves(sc), K.optimal_campaign(sc))
    return b.select("queue", S.ID, "contacted", F.round("cum_profit", 4).alias("cum_profit"), "is_optimum")


@register("kde_tenure_by_class", with_s("""
, rg AS (SELECT min(tenure) AS lo, max(tenure) AS hi FROM t),
st AS (SELECT Churn, count(tenure) AS n, stddev_samp(tenure) * pow(count(tenure)::double, -0.2) AS h FROM t GROUP BY Churn),
v AS (SELECT Churn, tenure AS v, count(*) AS c FROM t GROUP BY Churn, tenure),
g AS (SELECT unnest(range(100)) AS point)
SELECT v.Churn, point::integer AS point, round(lo + (hi - lo) * point / 99.0, 6) AS x,
       round(sum(c * exp(-0.5 * ((lo + (hi - lo) * point / 99.0 - v) / h) ^ 2) / sqrt(2 * pi())) / any_value(n * h), 9) AS density
FROM v JOIN st USING (Churn), g, rg GROUP BY v.Churn, point, lo, hi"""))
def kde_tenure_by_class(spark, sf):
    """Gaussian KDE of tenure per class (Scott bandwidth) on a 100-point grid."""
    k = L.kde(s_treated(spark, sf), "tenure", "Churn", 100)
    return k.select("Churn", F.col("point").cast("int").alias("point"), F.round("x", 6).alias("x"),
                    F.round("density", 9).alias("density"))


@register("mean_probability", with_s(PREDS_SQL + """
SELECT model, round(avg(p), 6) AS mean_p, round(avg(y::double), 6) AS base_rate, count(*) AS n FROM preds GROUP BY model"""))
def mean_probability(spark, sf):
    """mean predicted probability per model against the observed base rate (calibration level)."""
    return _preds(spark, sf).groupBy("model").agg(
        F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(F.col("y").cast("double")), 6).alias("base_rate"),
        F.count(F.lit(1)).alias("n"))
