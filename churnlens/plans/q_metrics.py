"""Registered queries: ranking, deciles, lift (G) and model metrics (H) on scored S."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.operators import metrics as M
from churnlens.operators import ranking as RK
from churnlens.oracle import with_s
from churnlens.plans.catalog import register
from churnlens.plans.inputs import s_scored

SC = """
, sc AS (SELECT customerID, Churn AS y, p_score AS p, MonthlyCharges AS mc,
                (Contract = 'Month-to-month')::integer AS m2m, Contract, tenure FROM t)"""

CUM = SC + """
, g AS (SELECT p, sum(y)::bigint AS pos, sum(1 - y)::bigint AS neg FROM sc GROUP BY p),
c AS (SELECT *, row_number() OVER (ORDER BY p DESC) AS rn,
             sum(pos) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tps,
             sum(neg) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fps FROM g),
tot AS (SELECT sum(pos)::double AS n_pos, sum(neg)::double AS n_neg, count(*) AS m FROM g)"""


def r6(c):
    return F.round(c, 6).alias(c)


@register("score_metrics", with_s(CUM + """
SELECT round(sum(neg * ((tps - pos) + pos / 2.0) / (n_pos * n_neg)), 6) AS roc_auc,
       round(sum(pos / n_pos * tps / (tps + fps)), 6) AS pr_auc,
       (SELECT round(avg((p - y) * (p - y)), 6) FROM sc) AS brier,
       (SELECT round(avg(y::double), 6) FROM sc) AS base_rate,
       (SELECT count(*) FROM sc) AS n
FROM c, tot"""))
def score_metrics(spark, sf):
    """H1-H4: exact ROC-AUC (ties averaged), average precision (step), Brier, base rate, n."""
    m = M.evaluate(s_scored(spark, sf))
    return m.select(r6("roc_auc"), r6("pr_auc"), r6("brier"), r6("base_rate"), "n")


@register("score_metrics_by_contract", with_s(SC + """
, g AS (SELECT Contract, p, sum(y)::bigint AS pos, sum(1 - y)::bigint AS neg FROM sc GROUP BY Contract, p),
c AS (SELECT *, sum(pos) OVER (PARTITION BY Contract ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tps,
             sum(neg) OVER (PARTITION BY Contract ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fps FROM g),
tot AS (SELECT Contract, sum(pos)::double AS n_pos, sum(neg)::double AS n_neg FROM g GROUP BY Contract),
rk AS (SELECT c.Contract, sum(neg * ((tps - pos) + pos / 2.0) / (n_pos * n_neg)) AS roc_auc,
              sum(pos / n_pos * tps / (tps + fps)) AS pr_auc FROM c JOIN tot USING (Contract) GROUP BY c.Contract),
simple AS (SELECT Contract, avg((p - y) * (p - y)) AS brier, avg(y::double) AS base_rate, count(*) AS n
           FROM sc GROUP BY Contract)
SELECT Contract, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier,
       round(base_rate, 6) AS base_rate, n FROM simple JOIN rk USING (Contract)"""))
def score_metrics_by_contract(spark, sf):
    """H4 grouped: the same metrics per group in one job (groups = contract here, split/model elsewhere)."""
    m = M.evaluate(s_scored(spark, sf), by=["Contract"])
    return m.select("Contract", r6("roc_auc"), r6("pr_auc"), r6("brier"), r6("base_rate"), "n")


@register("calibration_curve", with_s(SC + """
, e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM sc),
b AS (SELECT sc.*, len(list_filter(edges, lambda x: x < p)) AS bin FROM sc, e)
SELECT bin::integer AS bin, round(avg(p), 6) AS predicted, round(avg(y::double), 6) AS observed, count(*) AS n
FROM b GROUP BY bin"""))
def calibration_curve(spark, sf):
    """H5: quantile calibration curve (10 bins, empty bins dropped)."""
    c = M.calibration_curve(s_scored(spark, sf))
    return c.select("bin", r6("predicted"), r6("observed"), "n")


@register("roc_points", with_s(CUM + """
, nb AS (SELECT c.*, lag(tps) OVER w AS tps_prev, lag(fps) OVER w AS fps_prev,
                lead(tps) OVER w AS tps_next, lead(fps) OVER w AS fps_next FROM c WINDOW w AS (ORDER BY rn))
SELECT 0.0::double AS fpr, 0.0::double AS tpr, NULL::double AS threshold
UNION ALL
SELECT round(fps / n_neg, 6), round(tps / n_pos, 6), p FROM nb, tot
WHERE rn = 1 OR rn = m OR fps_next - 2 * fps + fps_prev <> 0 OR tps_next - 2 * tps + tps_prev <> 0"""))
def roc_points(spark, sf):
    """H6: ROC points with collinear points dropped, plus the origin."""
    r = M.roc_points(s_scored(spark, sf))
    return r.select(r6("fpr"), r6("tpr"), "threshold")


@register("pr_points", with_s(CUM + """
SELECT round(tps / (tps + fps), 6) AS precision, round(tps / n_pos, 6) AS recall, p AS threshold FROM c, tot
UNION ALL SELECT 1.0, 0.0, NULL"""))
def pr_points(spark, sf):
    """H7: precision-recall points plus the closing (1, 0)."""
    r = M.pr_points(s_scored(spark, sf))
    return r.select(r6("precision"), r6("recall"), "threshold")


DEC = SC + """
, r AS (SELECT *, row_number() OVER (ORDER BY p DESC, customerID) AS rk, count(*) OVER () AS nn FROM sc),
d AS (SELECT *, greatest(1, ((rk - 1) * 10 + (nn - 2)) // (nn - 1))::integer AS decile FROM r)"""


@register("decile_of_customer", with_s(DEC + "\nSELECT customerID, decile FROM d"))
def decile_of_customer(spark, sf):
    """G1 without ranks: every customer's decile by comparison with nine cut keys."""
    return RK.with_decile(s_scored(spark, sf)).select("customerID", "decile")


@register("risk_deciles", with_s(DEC + "\nSELECT customerID, p, rk AS rank, decile FROM d"))
def risk_deciles(spark, sf):
    """G1: rank by p desc (ties by id) and decile by the qcut-on-ranks rule."""
    return RK.deciles(s_scored(spark, sf)).select("customerID", "p", "rank", "decile")


@register("lift_table", with_s(DEC + """
, per AS (SELECT decile, count(*) AS n, sum(y)::bigint AS churns, avg(y::double) AS churn_rate FROM d GROUP BY decile)
SELECT decile, n, churns, round(churn_rate, 6) AS churn_rate,
       round(churn_rate / (SELECT avg(y::double) FROM sc), 6) AS lift,
       (sum(churns) OVER (ORDER BY decile))::bigint AS cum_churns,
       round(sum(churns) OVER (ORDER BY decile) / (SELECT sum(y)::double FROM sc), 6) AS cum_capture
FROM per"""))
def lift_table(spark, sf):
    """Lift and cumulative capture by risk decile."""
    t = RK.lift_table(s_scored(spark, sf))
    return t.select("decile", "n", "churns", r6("churn_rate"), r6("lift"),
                    F.col("cum_churns").cast("bigint").alias("cum_churns"), r6("cum_capture"))
