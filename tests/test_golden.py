"""Golden cases that need no data file (FIXTURES.md §5)."""

import pytest
from pyspark.sql import functions as F

from churnlens.functions.decision import BusinessParams, customer_threshold, threshold_floor
from churnlens.operators.ranking import deciles
from churnlens.operators.selection import champion
from churnlens.operators.splits import class_quotas


def test_decile_sizes_1409(spark):
    df = spark.range(1409).select(F.col("id").cast("string").alias("customerID"),
                                  (F.col("id") % 97 / 97.0).alias("p"))
    sizes = [r["n"] for r in deciles(df).groupBy("decile").agg(F.count(F.lit(1)).alias("n")).orderBy("decile").collect()]
    assert sizes == [141, 141, 141, 141, 141, 140, 141, 141, 141, 141]


def test_stratified_quotas_7043():
    q = class_quotas({0: 7043 - 1869, 1: 1869}, 1409)
    assert q == {1: 374, 0: 1035}
    assert 7043 - 1409 == 5634 and 1869 - 374 == 1495


# published paired rows: model, PR-AUC mean, diff mean, diff std, folds won, n folds, seconds per fit
PUBLISHED = [
    ("Regra de contrato", 0.4093, -0.2519, 0.0170, 0, 15, 0.0005),
    ("Regressão logística", 0.6612, 0.0000, 0.0000, 0, 15, 0.0160),
    ("AdaBoost", 0.6601, -0.0011, 0.0085, 5, 15, 0.6781),
    ("XGBoost", 0.6677, 0.0065, 0.0087, 11, 15, 0.2261),
    ("LightGBM", 0.6569, -0.0044, 0.0102, 4, 15, 0.5928),
    ("Ensemble (votação)", 0.6710, 0.0098, 0.0063, 15, 15, 1.4936),
    ("Ensemble (stacking)", 0.6715, 0.0103, 0.0055, 14, 15, 8.4574),
]


def test_champion_from_published_rows(spark):
    paired = spark.createDataFrame(PUBLISHED, "model string, pr_auc_mean double, diff_mean double, diff_std double, "
                                              "folds_won int, n_folds int, seconds_per_fit double")
    r = champion(paired).first()
    assert r["leader"] == "Ensemble (stacking)"
    assert sorted(r["tied"]) == ["Ensemble (votação)", "XGBoost"]
    assert r["champion"] == "XGBoost"


@pytest.mark.parametrize("discount,floor", [(0.02, 0.067), (0.05, 0.167), (0.10, 0.333), (0.15, 0.500),
                                            (0.20, 0.667), (0.25, 0.833), (0.30, 1.000)])
def test_floors(spark, discount, floor):
    v = spark.range(1).select(threshold_floor(BusinessParams(discount=discount))).first()[0]
    assert round(v, 3) == floor


@pytest.mark.parametrize("mc,thr", [(18.25, 0.9041), (20.0, 0.8542), (70.10, 0.4819), (116.0, 0.4231), (118.0, 0.4216)])
def test_threshold_formula(spark, mc, thr):
    v = spark.range(1).select(customer_threshold(F.lit(mc))).first()[0]
    assert round(v, 4) == thr


def test_champion_vs_leader_rule(spark):
    from churnlens.operators.selection import champion_vs_leader

    rows = []
    for r in range(3):
        for f in range(5):
            base = 0.5 + 0.01 * f
            rows += [("a", r, f, 0.8, base + 0.02, 0.1, 1.0),      # leader, slow
                     ("b", r, f, 0.8, base + 0.02 - (0.01 if f % 2 else -0.01), 0.1, 0.2),  # noisy, tied
                     ("c", r, f, 0.8, base - 0.05, 0.1, 0.1)]      # clearly worse, cheapest
    fs = spark.createDataFrame(rows, "model string, repeat int, fold int, roc_auc double, pr_auc double, "
                                     "brier double, seconds double")
    out = champion_vs_leader(fs).first()
    assert out["leader"] in {"a", "b"} and out["champion"] == "b" and "c" not in out["tied"]


def test_champion_name_falls_back_to_logistic(spark, tmp_path):
    from churnlens.sources.raw import champion_name, write_report

    assert champion_name(spark, str(tmp_path / "missing")) == "logistic"
    write_report(spark.range(1).select(F.lit("xgboost").alias("champion")), str(tmp_path / "rep"))
    assert champion_name(spark, str(tmp_path / "rep")) == "xgboost"
