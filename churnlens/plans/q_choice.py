"""Registered queries: model choice on five scorers that need no iterative fit.

Folds, scores and metrics are computed from the subscriber table. The scorers are the fixed scorecard,
the contract rule (re-fitted per training fold), two one-line scores, and the soft vote of the scorecard
and one of them; "without TotalCharges" means that the scores that read it do without. No fit is timed:
a model's cost per fold is the number of distinct scores it gives, in thousands.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlens.operators import selection as SEL
from churnlens.operators.ordered import stored
from churnlens.oracle import with_s
from churnlens.plans.catalog import register
from churnlens.plans.inputs import s_treated
from churnlens.plans.q_selection import SCORES_SQL


def soft_vote(*scores: Column) -> Column:
    """Mean of the members' probabilities."""
    return reduce(lambda a, b: a + b, scores) / len(scores)


def _sigmoid(x: Column) -> Column:
    return F.round(1.0 / (1.0 + F.exp(-x)), 6)


def scorers(total: bool) -> dict[str, Column]:
    charges = _sigmoid(F.col("MonthlyCharges") / 40.0 - 2.5 - (F.col("TotalCharges") / 1500.0 if total else F.lit(0.0)))
    return {"tenure": _sigmoid(0.2 - F.col("tenure") / 24.0), "charges": charges, "voting": soft_vote(F.col("p_score"), charges)}


def _scorer_sql(total: bool) -> dict[str, str]:
    charges = f"round(1.0::double / (1.0::double + exp(-(MonthlyCharges / 40.0::double - 2.5::double - {'TotalCharges / 1500.0::double' if total else '0.0::double'}))), 6)"
    return {"tenure": "round(1.0::double / (1.0::double + exp(-(0.2::double - tenure / 24.0::double))), 6)", "charges": charges,
            "voting": f"(p_score + {charges}) / 2"}


def _ladder_sql(total: bool) -> str:
    """The fold scores of all five scorers, ending in the CTE ``fs`` with a cost column."""
    more = "".join(f"\n  UNION ALL SELECT '{name}', f.repeat, f.fold, t.customerID, t.Churn, {sql} FROM folds f JOIN t USING (customerID)"
                   for name, sql in _scorer_sql(total).items())
    return SCORES_SQL.replace("AND tr.flag = (t.Contract = 'Month-to-month')),", f"AND tr.flag = (t.Contract = 'Month-to-month'){more}),").replace(
        "fs AS (SELECT * FROM rkm JOIN br USING (model, repeat, fold))",
        "cost AS (SELECT model, repeat, fold, count(*) / 1000.0::double AS seconds FROM g GROUP BY ALL),\n"
        "fs AS (SELECT * FROM rkm JOIN br USING (model, repeat, fold) JOIN cost USING (model, repeat, fold))")


def _fold_scores(spark, sf):
    """Fold scores of the five scorers, with their cost."""
    return SEL.rule_and_scorecard_fold_scores(s_treated(spark, sf), scorers=scorers(True))


def _with_and_without(spark, sf):
    """Summaries of the five scorers with and without TotalCharges, over the same folds."""
    other = {f"{name} without": score for name, score in scorers(False).items()}
    fs = stored(SEL.rule_and_scorecard_fold_scores(s_treated(spark, sf), scorers={**scorers(True), **other}), "ablation")
    changed = F.col("model").isin(list(other))
    same = ~F.col("model").isin(list(scorers(True)))
    return (SEL.cv_summary(fs.filter(~changed)),
            SEL.cv_summary(fs.filter(changed | same).withColumn("model", F.regexp_replace("model", " without$", ""))))


_PAIRED = """
, d AS (SELECT a.model, a.pr_auc AS pr, a.seconds, a.pr_auc - b.pr_auc AS diff FROM fs a JOIN fs b
        ON a.repeat = b.repeat AND a.fold = b.fold AND b.model = {reference}),
pc AS (SELECT model, avg(pr) AS pr_auc_mean, avg(diff) AS diff_mean, stddev_pop(diff) AS diff_std, avg(seconds) AS seconds_per_fit FROM d GROUP BY model),
lead AS (SELECT model AS leader, diff_mean AS lead_diff FROM pc ORDER BY pr_auc_mean DESC, model LIMIT 1),
tied AS (SELECT model FROM pc, lead WHERE model <> leader AND abs(diff_mean - {offset}) < diff_std),
cands AS (SELECT model, seconds_per_fit FROM pc WHERE model IN (SELECT leader FROM lead UNION ALL SELECT model FROM tied))
SELECT leader, coalesce((SELECT list_sort(list(model)) FROM tied), []) AS tied,
       (SELECT model FROM cands ORDER BY seconds_per_fit, model LIMIT 1) AS champion FROM lead"""


@register("champion_choice", with_s(_ladder_sql(True) + _PAIRED.format(reference="'scorecard'", offset="lead_diff").replace(
    "list_sort(list(model))", "array_to_string(list_sort(list(model)), ',')").replace(", [])", ", '')")))
def champion_choice(spark, sf):
    """Leader by mean PR-AUC, its ties by the paired rule, the cheapest of them."""
    fs = stored(_fold_scores(spark, sf), "choice")
    row = SEL.champion(SEL.paired_comparison(fs, reference="scorecard"), SEL.cv_summary(fs))
    return row.withColumn("tied", F.array_join("tied", ","))


@register("champion_vs_leader", with_s(_ladder_sql(True) + _PAIRED.format(
    reference="(SELECT model FROM fs GROUP BY model ORDER BY avg(pr_auc) DESC, model LIMIT 1)", offset="0").replace(
    "list_sort(list(model))", "array_to_string(list_sort(list(model)), ',')").replace(", [])", ", '')")))
def champion_vs_leader(spark, sf):
    """Ties judged on differences to the leader itself."""
    return SEL.champion_vs_leader(stored(_fold_scores(spark, sf), "choice")).withColumn("tied", F.array_join("tied", ","))


def _both(sql: str) -> str:
    """``w`` and ``o``: the fold scores with and without TotalCharges."""
    names = ("val", "g", "c", "tot", "rkm", "br", "cost", "fs")
    second = _ladder_sql(False)
    second = second[second.index("val AS ("):]
    for n in names:
        second = second.replace(f"{n} AS (", f"{n}_o AS (")
    second = re.sub(rf"\b(FROM|JOIN) ({'|'.join(names)})\b", r"\1 \2_o", second)
    second = second.replace("SELECT c.model, c.repeat, c.fold", "SELECT c_o.model, c_o.repeat, c_o.fold")
    return _ladder_sql(True) + ",\n" + second + sql


@register("ablation_table", with_s(_both("""
, w AS (SELECT model, avg(roc_auc) AS m, stddev_pop(roc_auc) AS s FROM fs GROUP BY model),
o AS (SELECT model, avg(roc_auc) AS m FROM fs_o GROUP BY model)
SELECT model, round(w.m, 6) AS with_mean, round(o.m, 6) AS without_mean, round(o.m - w.m, 6) AS difference, round(w.s, 6) AS with_std,
       round((o.m - w.m) / nullif(w.s, 0), 4) AS in_deviations FROM w JOIN o USING (model)""")))
def ablation_table(spark, sf):
    """Without against with TotalCharges, in ROC-AUC and in fold deviations."""
    a = SEL.ablation_table(*_with_and_without(spark, sf))
    return a.select("model", *[F.round(c, 6).alias(c) for c in ("with_mean", "without_mean", "difference", "with_std")],
                    F.round("in_deviations", 4).alias("in_deviations"))


@register("ablation_dumbbell", with_s(_both("""
, l AS (SELECT model, 'roc_auc' AS metric, roc_auc AS v FROM fs UNION ALL SELECT model, 'pr_auc', pr_auc FROM fs),
lo AS (SELECT model, 'roc_auc' AS metric, roc_auc AS v FROM fs_o UNION ALL SELECT model, 'pr_auc', pr_auc FROM fs_o)
SELECT model, metric, round(a.v, 6) AS with_total, round(b.v, 6) AS without_total
FROM (SELECT model, metric, avg(v) AS v FROM l GROUP BY ALL) a JOIN (SELECT model, metric, avg(v) AS v FROM lo GROUP BY ALL) b USING (model, metric)
WHERE model <> 'contract_rule'""")))
def ablation_dumbbell(spark, sf):
    """Both metrics with and without TotalCharges, without the baseline."""
    d = SEL.ablation_dumbbell(*_with_and_without(spark, sf))
    return d.select("model", "metric", F.round("with_total", 6).alias("with_total"), F.round("without_total", 6).alias("without_total"))


@register("soft_vote", with_s("\nSELECT customerID, " + ", ".join(f"{sql} AS {name}" for name, sql in _scorer_sql(True).items()) + " FROM t"))
def soft_vote_scores(spark, sf):
    """The members' scores and their soft vote."""
    return s_treated(spark, sf).select("customerID", *[c.alias(n) for n, c in scorers(True).items()])
