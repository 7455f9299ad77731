"""Model layer: scaler, one-hot, logistic equivalence, learners, ensembles (small rounds)."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnlens.models.catalog import MODEL_ORDER, calibration_variants, catalogue
from churnlens.models.features import feature_names, preprocessing_stages
from churnlens.models.learners import AdaBoost, Logistic, Voting
from churnlens.operators.metrics import evaluate
from churnlens.operators.splits import stratified_split
from churnlens.plans.inputs import s_treated

from .conftest import SF01


@pytest.fixture(scope="module")
def split(spark):
    sp = stratified_split(s_treated(spark, SF01).drop("p_score")).persist()
    return sp.filter("split = 'train'").drop("split"), sp.filter("split = 'test'").drop("split")


@pytest.fixture(scope="module")
def prepared(split):
    train, _ = split
    prep = Pipeline(stages=preprocessing_stages()).fit(train)
    return prep, prep.transform(train).persist()


def test_feature_layout(prepared, split):
    _, feats = prepared
    names = feature_names(feats)
    assert len(names) == 26
    assert names[:3] == ["tenure__z", "MonthlyCharges__z", "TotalCharges__z"]
    train, _ = split
    without = Pipeline(stages=preprocessing_stages(False)).fit(train).transform(train)
    assert len(feature_names(without)) == 25


def test_population_scaler(prepared):
    _, feats = prepared
    z = feats.select("tenure__z").toPandas()["tenure__z"].to_numpy()
    assert abs(z.mean()) < 1e-9
    assert abs(z.std(ddof=0) - 1.0) < 1e-9  # population std, not the sample one


def test_split_quotas(split):
    train, test = split
    n, pos = test.count(), test.agg(F.sum("Churn")).first()[0]
    assert n == 300 and train.count() == 1200
    total_pos = pos + train.agg(F.sum("Churn")).first()[0]
    assert pos == round(total_pos * 300 / 1500)


def test_logistic_matches_single_machine_objective(prepared):
    """The gradient of ½‖w‖² + Σ logloss at the solution is 0."""
    _, feats = prepared
    fitted = Logistic().fit(feats, "Churn")
    w, b = np.array(fitted.coefficients), fitted.intercept
    pdf = feats.select(vector_to_array("features").alias("x"), "Churn").toPandas()
    X = np.vstack(pdf["x"].to_numpy())
    y = pdf["Churn"].to_numpy()
    p = 1 / (1 + np.exp(-(X @ w + b)))
    grad_w = w + X.T @ (p - y)
    grad_b = np.sum(p - y)
    assert np.max(np.abs(grad_w)) < 1e-6 and abs(grad_b) < 1e-6


def test_voting_is_mean_of_bases(prepared):
    _, feats = prepared
    bases = [Logistic(), AdaBoost(rounds=3)]
    v = Voting(bases).fit(feats, "Churn")
    out = v.predict(feats, "p")
    for i, f in enumerate(v.fitted):
        out = f.predict(out, f"b{i}")
    diff = out.select(F.max(F.abs(F.col("p") - (F.col("b0") + F.col("b1")) / 2))).first()[0]
    assert diff < 1e-12


def test_ladder_small_rounds_beats_rule(split):
    train, test = split
    cat = catalogue(rounds=4)
    assert list(cat) == MODEL_ORDER
    auc = {}
    for name in ["contract_rule", "logistic", "adaboost", "xgboost"]:
        fitted = cat[name].fit(train)
        sc = fitted.score(test).select("customerID", F.col("Churn").alias("y"), "p")
        m = evaluate(sc).first()
        auc[name] = m["roc_auc"]
        assert 0 < m["brier"] < 0.25
    assert auc["logistic"] > auc["contract_rule"]


def test_adaboost_deterministic(prepared):
    _, feats = prepared
    a = AdaBoost(rounds=4).fit(feats, "Churn")
    b = AdaBoost(rounds=4).fit(feats, "Churn")
    assert a.stumps == b.stumps and len(a.stumps) == 4
    # the weights are the same whether or not they are written in between
    assert AdaBoost(rounds=4, flush=2).fit(feats, "Churn").stumps == a.stumps


def test_calibration_variants(split):
    train, test = split
    v = calibration_variants()
    means = {}
    for name, m in v.items():
        sc = m.fit(train).score(test)
        means[name] = sc.agg(F.avg("p")).first()[0]
    base = test.agg(F.avg("Churn")).first()[0]
    # balancing inflates the level; isotonic brings it back towards the base rate
    assert means["balanced"] > means["plain"]
    assert abs(means["balanced_isotonic"] - base) < abs(means["balanced"] - base)


def test_coefficients_named(split):
    train, _ = split
    fitted = catalogue()["logistic"].fit(train)
    rows = fitted.coefficients(train).collect()
    assert rows[0]["feature"] == "intercept" and len(rows) == 27
    assert catalogue()["contract_rule"].fit(train).coefficients(train).count() == 0


def test_save_and_load_round_trip(split, tmp_path):
    from churnlens.models.catalog import load_fitted

    train, test = split
    fitted = catalogue()["logistic"].fit(train)
    fitted.save(str(tmp_path / "m"))
    again = load_fitted(str(tmp_path / "m"))
    a = fitted.score(test).select("customerID", F.col("p").alias("a"))
    b = again.score(test).select("customerID", F.col("p").alias("b"))
    assert a.join(b, "customerID").select(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-12
