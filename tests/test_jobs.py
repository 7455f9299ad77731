"""End-to-end compare → train → decide → segments on planted subscribers (reduced ladder)."""

import pytest

from churnlens.plans import jobs as J

from .conftest import SF001


def test_jobs_end_to_end(spark, tmp_path):
    out = str(tmp_path / "run")
    t = J.load_input(spark, None, SF001).persist()
    r = J.compare_job(spark, t, out, rounds=2, n_splits=2, n_repeats=1, parallelism=3,
                      models=["contract_rule", "logistic", "xgboost"])
    champ = r["champion"].first()
    assert champ["champion"] in {"contract_rule", "logistic", "xgboost"}
    assert r["fold_scores"].count() == 3 * 2
    rep = spark.read.json(f"{out}/compare/report").first()
    assert rep["champion"] == champ["champion"]
    tr = J.train_job(spark, t, out, model="logistic", rounds=2)
    assert {r["split"] for r in tr["metrics"].collect()} == {"train", "test"}
    d = J.decide_job(spark, t, out, model="logistic")
    n = d["optimal"].first()["n_contacted"]
    assert d["curves"].filter("contacted = 1").count() == 4
    assert d["sensitivity"].count() == 31
    assert isinstance(d["sentence"].first()[0], str) and n >= 0
    J.segments_job(spark, t, out, model="logistic")
    assert spark.read.option("header", True).csv(f"{out}/segments/contact_list_{n}_customers").count() == n


def test_decide_refuses_other_split(spark, tmp_path):
    out = str(tmp_path / "run2")
    t = J.load_input(spark, None, SF001).persist()
    J.train_job(spark, t, out, model="contract_rule", seed=1)
    with pytest.raises(J.SplitMismatch):
        J.decide_job(spark, t, out, model="contract_rule", seed=42)


def test_csv_input_path(spark, tmp_path):
    from churnlens import schema as S
    from churnlens.plans.inputs import s_raw
    from churnlens.sources.raw import write_raw_csv

    path = str(tmp_path / "raw.csv")
    write_raw_csv(s_raw(spark, SF001).select(*S.RAW_COLUMNS), path)
    t = J.load_input(spark, path, None)
    assert t.count() == 150 and "customerID" in t.columns
