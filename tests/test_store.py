"""Saving and loading every kind of model; jobs that follow a training with other settings; ablation and CSV input."""

import pytest
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.functions.treat import coerce_number, enforce_feasible, treat
from churnlens.models import store
from churnlens.models.catalog import calibration_variants, catalogue, load_fitted
from churnlens.operators.explore import quartile_bins
from churnlens.operators.quality import SchemaError
from churnlens.operators.selection import ablation_dumbbell, ablation_table
from churnlens.plans import jobs as J
from churnlens.plans.inputs import s_raw, s_treated
from churnlens.sources import raw as RAW

from .conftest import SF001


@pytest.fixture(scope="module")
def train(spark):
    return s_treated(spark, SF001).drop("p_score").persist()


@pytest.mark.parametrize("name", ["contract_rule", "logistic", "adaboost", "xgboost", "voting", "stacking", "balanced_isotonic"])
def test_every_model_comes_back(train, tmp_path, name):
    model = {**catalogue(rounds=2), **calibration_variants()}[name]
    fitted = model.fit(train)
    fitted.save(str(tmp_path / name))
    back = load_fitted(str(tmp_path / name))
    a, b = ({r[S.ID]: r["p"] for r in m.score(train).select(S.ID, "p").collect()} for m in (fitted, back))
    assert a == b and len(a) == 150 and all(0 <= p <= 1 for p in a.values()) and back.name == name


def test_unknown_kinds_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="no way to save"):
        store.save(object(), str(tmp_path / "x"))
    store._note(str(tmp_path / "y"), "something else")
    with pytest.raises(ValueError, match="unknown kind"):
        store.load(str(tmp_path / "y"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_fitted(str(tmp_path / "nothing"))


def test_a_broken_training_leaves_the_model(spark, train, tmp_path, monkeypatch):
    """Readers take a model's parts from the folder that was named last, once all of it was written."""
    out, where = str(tmp_path / "run"), f"{tmp_path}/run/models/contract_rule"
    J.train_job(spark, train, out, model="contract_rule")
    first = J.published(spark, where)
    n = J.decide_job(spark, train, out, model="contract_rule")["optimal"].first()["n_contacted"]
    monkeypatch.setattr(J, "lift_table", lambda *a: 1 / 0)  # after the split, the settings and the scores are written
    with pytest.raises(ZeroDivisionError):
        J.train_job(spark, train, out, model="contract_rule", seed=7)
    assert J.published(spark, where) == first
    assert J.decide_job(spark, train, out, model="contract_rule")["optimal"].first()["n_contacted"] == n
    monkeypatch.undo()
    J.train_job(spark, train, out, model="contract_rule", seed=7)
    assert J.published(spark, where) != first and spark.read.json(f"{J.published(spark, where)}/settings").first()["seed"] == 7


def test_jobs_follow_other_settings(spark, train, tmp_path):
    out = str(tmp_path / "run")
    J.train_job(spark, train, out, model="contract_rule", use_total_charges=False, test_size=0.3)
    report = spark.read.json(f"{J.published(spark, out + '/models/contract_rule-no-total-charges')}/report").first()
    assert report["test_size"] == 0.3 and report["n_features"] == 1 and report["estimator"] == "ContractRule" and report["versions"]["churnlens"]
    d = J.decide_job(spark, train, out, model="contract_rule", use_total_charges=False)
    assert spark.read.json(f"{out}/decision/report").first()["test_base"]["n"] == 45
    assert d["sensitivity"].count() == 31
    J.segments_job(spark, train, out, model="contract_rule", use_total_charges=False)
    with pytest.raises(J.SplitMismatch, match="test size"):
        J.decide_job(spark, train, out, model="contract_rule", use_total_charges=False, test_size=0.2)
    with pytest.raises(J.SplitMismatch, match="other customers"):
        J.decide_job(spark, train.limit(100), out, model="contract_rule", use_total_charges=False)


def test_ablation_is_without_minus_with(spark):
    cols = "model string, roc_auc_mean double, roc_auc_std double, pr_auc_mean double, pr_auc_std double"
    a = spark.createDataFrame([("m", 0.80, 0.02, 0.5, 0.1), ("z", 0.7, 0.0, 0.4, 0.0), ("contract_rule", 0.6, 0.1, 0.3, 0.1)], cols)
    b = spark.createDataFrame([("m", 0.79, 0.03, 0.6, 0.1), ("z", 0.7, 0.1, 0.4, 0.0), ("contract_rule", 0.6, 0.1, 0.3, 0.1)], cols)
    rows = {r["model"]: r for r in ablation_table(a, b).collect()}
    assert rows["m"]["difference"] == pytest.approx(-0.01) and rows["m"]["in_deviations"] == pytest.approx(-0.5)
    assert rows["z"]["in_deviations"] is None
    assert {(r["model"], r["metric"], r["with_total"], r["without_total"]) for r in ablation_dumbbell(a, b).collect()} == {
        ("m", "roc_auc", 0.8, 0.79), ("m", "pr_auc", 0.5, 0.6), ("z", "roc_auc", 0.7, 0.7), ("z", "pr_auc", 0.4, 0.4)}


# CSV input


def _csv(df, tmp_path, name):
    path = str(tmp_path / name)
    RAW.write_raw_csv(df, path)
    return path


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    raw = s_raw(spark, SF001).select(*S.RAW_COLUMNS)
    swapped = [{"Partner": "Dependents", "Dependents": "Partner"}.get(c, c) for c in S.RAW_COLUMNS]
    got = RAW.load_treated(spark, _csv(raw.select(*swapped), tmp_path, "swapped"))
    assert sorted(got.collect()) == sorted(treat(raw).collect())


@pytest.mark.parametrize("break_it, text", [
    (lambda d: d.drop("Churn"), "Churn: missing"), (lambda d: d.withColumn("more", F.lit(1)), "more: unexpected"),
    (lambda d: d.withColumn("tenure", F.lit("abc")), "tenure: not int: 'abc'"),
    (lambda d: d.withColumn("MonthlyCharges", F.lit("nan")), "MonthlyCharges: not decimal: 'nan'"),
    (lambda d: d.withColumn("Contract", F.lit("Three year")), "Contract: outside domain: 'Three year'")])
def test_broken_csv_raises(spark, tmp_path, break_it, text):
    raw = s_raw(spark, SF001).select(*S.RAW_COLUMNS)
    with pytest.raises(SchemaError, match=text):
        RAW.load_treated(spark, _csv(break_it(raw), tmp_path, "broken"))


def test_problems_list_every_value(spark, tmp_path):
    raw = s_raw(spark, SF001).select(*S.RAW_COLUMNS).withColumn("PaymentMethod", F.concat(F.lit("pay"), F.col(S.ID)))
    with pytest.raises(SchemaError, match="and 130 more") as e:
        RAW.load_treated(spark, _csv(raw, tmp_path, "many"))
    assert e.value.problems.count() == 150


# small semantics


def test_numbers_in_text(spark):
    texts = ["1.5", " 2 ", "", " ", "nan", "NaN", "12D", "1e3", ".5", "-3", "1,5", None, "0x1p3", "5f"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", coerce_number("t").alias("v"))
    assert [r["v"] for r in got.orderBy("i").collect()] == [1.5, 2.0, 0, 0, 0, 0, 0, 1000.0, 0.5, -3.0, 0, 0, 0, 0]


def test_quartile_edge_equal_to_the_least_value(spark):
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 1, 1, 2, 3, 4, 5, 6, 7])], "customerID int, x double")
    with pytest.raises(ValueError, match="not unique"):
        quartile_bins(d, "x")


def test_feasibility_is_enforced(spark):
    t = s_treated(spark, SF001).withColumns({"MultipleLines": F.lit(1), "TechSupport": F.lit(1)})
    out = enforce_feasible(t)
    assert out.filter("PhoneService = 0 and MultipleLines <> 0").count() == 0
    assert out.filter("InternetService = 'No' and TechSupport <> 0").count() == 0
    assert out.filter("PhoneService = 1 and MultipleLines = 1").count() == t.filter("PhoneService = 1").count()
