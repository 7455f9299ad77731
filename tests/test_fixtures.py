"""The planted subscriber table reproduces the figures recorded in FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from churnlens.operators.decision import optimal_campaign
from churnlens.operators.metrics import evaluate
from churnlens.plans.inputs import s_raw, s_scored, s_treated

from .conftest import SF001, SF01

CASES = [
    # sf, rows, churn, by contract M/1/2, AUC of p_score, mean p, distinct p, blank totals, campaign n, profit
    (SF001, 150, 0.2800, (0.407, 0.143, 0.083), 0.7617, None, 106, 1, 5, 76.63),
    (SF01, 1500, 0.2940, (0.447, 0.152, 0.080), 0.7519, 0.1885, 239, 23, 81, 1285.91),
]


@pytest.mark.parametrize("sf,rows,churn,by_contract,auc,mean_p,distinct_p,blanks,n_camp,profit", CASES)
def test_planted_scorecard(spark, sf, rows, churn, by_contract, auc, mean_p, distinct_p, blanks, n_camp, profit):
    t = s_treated(spark, sf)
    row = t.agg(F.count(F.lit(1)).alias("n"), F.avg("Churn").alias("c"), F.avg("p_score").alias("mp"),
                F.count_distinct("p_score").alias("dp")).first()
    assert row["n"] == rows
    assert round(row["c"], 4) == churn
    if mean_p is not None:
        assert round(row["mp"], 4) == mean_p
    assert row["dp"] == distinct_p
    rates = {r["Contract"]: round(r["r"], 3) for r in t.groupBy("Contract").agg(F.avg("Churn").alias("r")).collect()}
    assert (rates["Month-to-month"], rates["One year"], rates["Two year"]) == by_contract
    assert s_raw(spark, sf).filter(F.col("TotalCharges") == " ").count() == blanks
    m = evaluate(s_scored(spark, sf)).first()
    assert round(m["roc_auc"], 4) == auc
    o = optimal_campaign(s_scored(spark, sf)).first()
    assert o["n_contacted"] == n_camp
    assert round(o["profit"], 2) == profit


def test_real_subscribers_shape(spark):
    from churnlens.plans.inputs import r_table

    r = r_table(spark, SF01)
    row = r.agg(F.count(F.lit(1)).alias("n"), F.avg("Churn").alias("c")).first()
    assert row["n"] == 1496
    assert round(row["c"], 3) == 0.246


def test_implications_hold(spark):
    raw = s_raw(spark, SF01)
    assert raw.filter((F.col("InternetService") == "No") & (F.col("OnlineSecurity") == "Yes")).count() == 0
    assert raw.filter((F.col("PhoneService") == "No") != (F.col("MultipleLines") == "No phone service")).count() == 0
    assert raw.filter((F.col("tenure") == 0) != (F.col("TotalCharges") == " ")).count() == 0
