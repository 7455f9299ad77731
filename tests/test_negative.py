"""Fail-loud guards: one small negative input each (FIXTURES.md §4)."""

import pytest
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.functions.decision import BusinessParams
from churnlens.functions.treat import treat
from churnlens.models.catalog import get_model
from churnlens.operators import decision as K
from churnlens.operators.explore import quartile_bins
from churnlens.operators.quality import SchemaError, validate_raw, validate_treated
from churnlens.operators.ranking import lift_table
from churnlens.plans.inputs import s_raw, s_scored, s_treated

from .conftest import SF001


@pytest.fixture(scope="module")
def raw(spark):
    return s_raw(spark, SF001).select(*S.RAW_COLUMNS).limit(40).persist()


def test_valid_raw_passes(raw):
    validate_raw(raw)
    validate_treated(treat(raw))


def test_missing_column(raw):
    with pytest.raises(SchemaError, match="Churn: missing"):
        validate_raw(raw.drop("Churn"))


def test_extra_column(raw):
    with pytest.raises(SchemaError, match="extra: unexpected"):
        validate_raw(raw.withColumn("extra", F.lit(1)))


def test_total_charges_as_double(raw):
    with pytest.raises(SchemaError, match="TotalCharges: not text: 'double'"):
        validate_raw(raw.withColumn("TotalCharges", F.lit(1.5)))


def test_tenure_as_text(raw):
    with pytest.raises(SchemaError, match="tenure: not int: 'string'"):
        validate_raw(raw.withColumn("tenure", F.col("tenure").cast("string")))


def test_unknown_contract_and_all_problems_at_once(raw):
    bad = raw.withColumn("Contract", F.lit("Three year")).drop("gender")
    with pytest.raises(SchemaError) as e:
        validate_raw(bad)
    msg = str(e.value)
    assert "gender: missing" in msg and "Contract: outside domain: 'Three year'" in msg
    assert {(r["column"], r["check"]) for r in e.value.problems.collect()} == {("gender", "missing"), ("Contract", "outside domain")}


def test_non_binary_after_treatment(raw):
    t = treat(raw).withColumn("TechSupport", F.when(F.col("tenure") > 10, F.lit(7)).otherwise(F.col("TechSupport")))
    with pytest.raises(SchemaError, match="TechSupport: not 0/1: '7'"):
        validate_treated(t)


def test_unmapped_value_becomes_null_and_is_counted(raw, spark):
    from churnlens.operators.quality import null_counts

    t = treat(raw.withColumn("Partner", F.when(F.col("tenure") == 1, "Maybe").otherwise(F.col("Partner"))))
    rows = {r["column"]: r["n_null"] for r in null_counts(t).collect()}
    assert rows.get("Partner", 0) == raw.filter(F.col("tenure") == 1).count()


def test_lift_needs_ten_rows(spark):
    sc = s_scored(spark, SF001).limit(9)
    with pytest.raises(ValueError, match="at least 10"):
        lift_table(sc)


def test_lift_needs_a_positive(spark):
    sc = s_scored(spark, SF001).filter("y = 0")
    with pytest.raises(ValueError, match="no churn"):
        lift_table(sc)


def test_equal_quartile_edges(spark):
    df = spark.range(20).select(F.lit(5.0).alias("x"))
    with pytest.raises(ValueError, match="not unique"):
        quartile_bins(df, "x").collect()


def test_zero_monthly_charge_threshold_is_null(spark):
    sc = s_scored(spark, SF001).limit(3).withColumn("mc", F.lit(0.0))
    rows = K.decision_per_customer(sc).collect()
    assert all(r["threshold"] is None for r in rows)


def test_unknown_model_name():
    with pytest.raises(ValueError, match="unknown model 'svm'"):
        get_model("svm")


def test_unseen_category_scores_with_zero_one_hot(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from churnlens.models.features import feature_names, preprocessing_stages

    t = s_treated(spark, SF001)
    prep = Pipeline(stages=preprocessing_stages()).fit(t)
    odd = t.limit(2).withColumn("Contract", F.lit("Three year"))
    out = prep.transform(odd)
    names = feature_names(out)
    idx = [i for i, n in enumerate(names) if n.startswith("Contract__oh_")]
    assert len(idx) == 3
    for r in out.select(vector_to_array("features").alias("a")).collect():
        assert [r["a"][i] for i in idx] == [0.0, 0.0, 0.0]


def test_discount_at_or_above_margin_kills_campaign(spark):
    sc = s_scored(spark, SF001)
    params = BusinessParams(discount=0.30, margin=0.30)
    o = K.optimal_campaign(sc, params).first()
    assert o["n_contacted"] == 0 and o["profit"] == 0.0 and o["profit_per_contact"] == 0.0
    assert o["floor"] == 1.0
    sentence = K.business_sentence(K.optimal_campaign(sc, params), K.queue_curves(sc, params), sc.count(),
                                   lang="en").first()[0]
    assert "pays off for no customer" in sentence and "100%" in sentence
    pt = K.business_sentence(K.optimal_campaign(sc, params), K.queue_curves(sc, params), sc.count()).first()[0]
    assert "não se paga" in pt and "100%" in pt


def test_smallest_values_bounded_on_hot_group(spark):
    from churnlens.operators.quality import smallest_values

    df = spark.range(200000).select(F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g"),
                                    F.format_string("v%07d", (F.lit(500000) - F.col("id"))).alias("v"))
    got = {r["g"]: list(r["values"]) for r in smallest_values(df, "g", "v", 5).collect()}
    assert got["hot"] == ["v0300001", "v0300002", "v0300003", "v0300004", "v0300005"]
    assert got["cold"] == ["v0300010", "v0300020", "v0300030", "v0300040", "v0300050"]


def test_nulls_pass_validators_and_are_reported(raw):
    """A null is not a domain violation (both validators ignore it); the null report shows it."""
    from churnlens.operators.quality import null_counts

    with_null = raw.withColumn("Contract", F.when(F.col("tenure") < 5, F.lit(None)).otherwise(F.col("Contract")))
    validate_raw(with_null)
    validate_treated(treat(with_null))
    rows = {r["column"]: r["n_null"] for r in null_counts(with_null).collect()}
    assert rows["Contract"] == raw.filter(F.col("tenure") < 5).count() > 0


def test_single_class_group_gives_null_auc(spark):
    from churnlens.operators.metrics import evaluate

    sc = s_scored(spark, SF001).withColumn("g", F.when(F.col("y") == 1, "only_pos").otherwise("mixed"))
    sc = sc.withColumn("g", F.when(F.col("customerID").cast("int") % 2 == 0, "mixed").otherwise(F.col("g")))
    rows = {r["g"]: r for r in evaluate(sc, by=["g"]).collect()}
    assert rows["only_pos"]["roc_auc"] is None
    assert rows["mixed"]["roc_auc"] is not None
