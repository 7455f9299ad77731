"""Batch jobs (M1-M4): compare → train → decide, plus the segment/campaign tables.

    spark-submit -m churnlens.plans.jobs compare  --csv /shared/raw.csv --out /shared/churn
    python -m churnlens.plans.jobs train   --sf-dir /root/testdata/sf0.01 --out /shared/churn
    python -m churnlens.plans.jobs decide  --sf-dir ... --out ... --discount 0.05
    python -m churnlens.plans.jobs segments --sf-dir ... --out ...

Stages talk through files on the shared filesystem: the comparison report
names the champion; the training job writes the model, the split it used and
the scored test rows; the decision job reads those and refuses a split that
does not match its own seed (no training row may leak into the campaign).
"""

from __future__ import annotations

import argparse
import platform
import sys
import uuid

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import churnlens
from churnlens import schema as S
from churnlens.functions.decision import BusinessParams
from churnlens.models import evaluation as EV
from churnlens.models.catalog import calibration_variants, catalogue, get_model
from churnlens.models.features import feature_names
from churnlens.operators import decision as K
from churnlens.operators import selection as SEL
from churnlens.operators.metrics import evaluate
from churnlens.operators.ordered import stored
from churnlens.operators.ranking import lift_table
from churnlens.operators.splits import stratified_split
from churnlens.plans.inputs import s_treated
from churnlens.sources import raw as RAW


def _tables(out: str, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def load_input(spark: SparkSession, csv: str | None, sf_dir: str | None, base: str = "customer") -> DataFrame:
    """Raw CSV through A2, or the planted subscriber table derived from the driver's tables."""
    if csv:
        return RAW.load_treated(spark, csv)
    return s_treated(spark, sf_dir, base).drop("p_score")


def model_dir(out: str, name: str, use_total_charges: bool) -> str:
    """Artefacts keyed by model AND ablation, so training a challenger never overwrites production."""
    return f"{out}/models/{name}{'' if use_total_charges else '-no-total-charges'}"


def published(spark: SparkSession, mdir: str) -> str:
    """The folder of the model last published under ``mdir``: what readers take everything from."""
    rows = spark.read.schema("folder string, at timestamp").json(f"{mdir}/published")
    return f"{mdir}/{rows.agg(F.max_by('folder', F.struct('at', 'folder'))).first()[0]}"


def publish(spark: SparkSession, mdir: str, folder: str) -> None:
    """Names a finished folder as the model. One row is appended once all parts are written: a reader sees the
    former model whole, or this one, never parts of both; a training that breaks off changes nothing."""
    spark.range(1).select(F.lit(folder).alias("folder"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").json(f"{mdir}/published")


# ------------------------------------------------------------------ M2 compare

def compare_job(spark: SparkSession, treated: DataFrame, out: str, seed: int = 42, rounds: int = 300,
                n_splits: int = 5, n_repeats: int = 3, parallelism: int = 2, test_size: float = 0.2,
                reference: str = "logistic", models: list[str] | None = None) -> dict[str, DataFrame]:
    """M2 / A5: CV with and without TotalCharges, paired table, champion, test measurement,
    calibration experiment; writes the tables and the comparison report.
    ``models`` restricts the ladder (default: all seven). A run that broke off and is started again with the
    same rows and settings goes on after the fits it had finished."""
    def cat(use_total):
        c = catalogue(use_total, seed, rounds)
        return {k: v for k, v in c.items() if not models or k in models}

    sp = stored(stratified_split(treated, test_size=test_size, seed=seed), "split")
    train, test = sp.filter("split = 'train'").drop("split"), sp.filter("split = 'test'").drop("split")
    run = f"{out}/runs/{EV.run_id(train, seed=seed, rounds=rounds, n_splits=n_splits, n_repeats=n_repeats, version=churnlens.__version__)}"
    fs_with = stored(EV.cross_validate(train, cat(True), n_splits, n_repeats, seed, parallelism, run=f"{run}/with"), "fold-scores")
    fs_without = stored(EV.cross_validate(train, cat(False), n_splits, n_repeats, seed, parallelism, run=f"{run}/without"), "fold-scores")
    cv_with, cv_without = SEL.cv_summary(fs_with), SEL.cv_summary(fs_without)
    paired = SEL.paired_comparison(fs_with, reference=reference)
    champ = SEL.champion(paired, cv_with)
    test_metrics, test_calib, test_lift = EV.test_measurement(train, test, cat(True), parallelism)
    cal_metrics, cal_curves = EV.calibration_experiment(train, test, calibration_variants(seed))
    tables = {
        "fold_scores": fs_with, "fold_scores_without_total": fs_without,
        "cv_with_total": cv_with, "cv_without_total": cv_without, "paired": paired,
        "ablation": SEL.ablation_table(cv_with, cv_without),
        "test_metrics": test_metrics, "test_calibration": test_calib, "test_lift": test_lift,
        "calibration_experiment": cal_metrics, "calibration_curves": cal_curves,
    }
    _tables(f"{out}/compare", tables)
    base_rate = test.agg(F.avg(F.col(S.TARGET).cast("double"))).scalar()
    report = champ.select(F.lit(seed).alias("seed"), base_rate.alias("test_base_rate"), "leader", "tied", "champion",
                          RAW.nested(paired).alias("paired"), RAW.nested(cv_with).alias("cv_with_total"),
                          RAW.nested(cv_without).alias("cv_without_total"), RAW.nested(test_lift).alias("test_lift"),
                          RAW.nested(test_calib).alias("test_calibration"), RAW.nested(test_metrics).alias("test"))
    RAW.write_report(report, f"{out}/compare/report")
    return {**tables, "champion": champ}


# -------------------------------------------------------------------- M1 train

def train_job(spark: SparkSession, treated: DataFrame, out: str, model: str | None = None,
              use_total_charges: bool = True, seed: int = 42, test_size: float = 0.2, rounds: int = 300) -> dict:
    """M1 (A3, A4, A7): champion from the comparison report (or --model), fit on the stored
    training split, metrics by split, lift, coefficients, model and report written."""
    name = model or RAW.champion_name(spark, f"{out}/compare/report")
    m = get_model(name, use_total_charges=use_total_charges, seed=seed, rounds=rounds)  # unknown name → error
    folder = f"v-{uuid.uuid4().hex[:12]}"
    mdir = f"{model_dir(out, name, use_total_charges)}/{folder}"
    sp = stratified_split(treated, test_size=test_size, seed=seed)
    sp.select(S.ID, "split").write.mode("overwrite").parquet(f"{mdir}/split")   # the split travels with the model
    RAW.write_report(spark.range(1).select(F.lit(seed).alias("seed"), F.lit(test_size).alias("test_size"),
                                           F.lit(use_total_charges).alias("use_total_charges")), f"{mdir}/settings")
    sp = spark.read.parquet(f"{mdir}/split").join(treated, S.ID)
    train = sp.filter("split = 'train'").drop("split")
    fitted = m.fit(train)
    scored = fitted.score(sp).select(S.ID, "split", F.col(S.TARGET).alias("y"), "p", F.col("MonthlyCharges").alias("mc"),
                                     (F.col("Contract") == S.MONTH_TO_MONTH).cast("int").alias("m2m"), "Contract", "tenure")
    scored.write.mode("overwrite").parquet(f"{mdir}/scored")
    scored = spark.read.parquet(f"{mdir}/scored")
    metrics = evaluate(scored, by=["split"])
    lift = lift_table(scored.filter("split = 'test'"))
    coefs = fitted.coefficients(train)
    fitted.save(f"{mdir}/artefact")
    _tables(mdir, {"metrics": metrics, "lift": lift, "coefficients": coefs})
    report = spark.range(1).select(
        F.current_timestamp().alias("trained_at"), F.lit(name).alias("model"), F.lit(use_total_charges).alias("use_total_charges"),
        F.lit(seed).alias("seed"), F.lit(test_size).alias("test_size"),
        F.lit(n_features(fitted, train)).alias("n_features"), F.lit(type(m.learner).__name__).alias("estimator"),
        F.struct(F.lit(churnlens.__version__).alias("churnlens"), F.lit(pyspark.__version__).alias("spark"), F.lit(platform.python_version()).alias("python")).alias("versions"),
        F.array(*[F.lit(c) for c in treated.columns]).alias("columns"),
        RAW.nested(metrics).alias("metrics"), RAW.nested(lift).alias("lift"), RAW.nested(coefs).alias("coefficients"))
    RAW.write_report(report, f"{mdir}/report")
    publish(spark, model_dir(out, name, use_total_charges), folder)
    return {"model_dir": mdir, "metrics": metrics, "lift": lift, "coefficients": coefs}


def n_features(fitted, train: DataFrame) -> int:
    """Length of the feature vector; of a model that reads one raw column, 1."""
    return 1 if fitted.prep is None else len(feature_names(fitted.prep.transform(train.limit(1))))


# ------------------------------------------------------------------- M3 decide

# K9: the whole decision job on the out-of-sample rows of the stored split


class SplitMismatch(ValueError):
    """The stored split of the model is not the split this job would draw."""


def id_checksum(df: DataFrame) -> tuple:
    """Count and order-free checksum of the ids: equal for equal sets of customers."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(S.ID).cast("decimal(38,0)"))).first())


def scored_test(spark: SparkSession, treated: DataFrame, mdir: str, seed: int | None = None, test_size: float | None = None) -> DataFrame:
    """The model's out-of-sample rows. Refuses a model trained on other customers, or with another seed or
    test size than asked for; by default its own are taken."""
    has = spark.read.json(f"{mdir}/settings").first()
    if (seed not in (None, has["seed"])) or (test_size not in (None, has["test_size"])):
        raise SplitMismatch(f"model at {mdir} was trained with seed {has['seed']} and test size {has['test_size']}; refusing to decide")
    if id_checksum(spark.read.parquet(f"{mdir}/split")) != id_checksum(treated):
        raise SplitMismatch(f"model at {mdir} was trained on other customers; refusing to decide")
    return spark.read.parquet(f"{mdir}/scored").filter("split = 'test'").drop("split")


def parse_grid(text: str | None) -> dict | None:
    """A custom one-at-a-time grid, e.g. "discount=0.05,0.10;contact_cost=5,15"."""
    if not text:
        return None
    grid = {}
    for part in text.split(";"):
        name, values = part.split("=")
        name = name.strip()
        if name not in BusinessParams.__dataclass_fields__:
            raise ValueError(f"unknown parameter {name!r}")
        grid[name] = [float(v) for v in values.split(",")]
    return grid


def decide_job(spark: SparkSession, treated: DataFrame, out: str, model: str | None = None,
               params: BusinessParams | None = None, seed: int | None = None, use_total_charges: bool = True,
               grid: dict | None = None, test_size: float | None = None) -> dict:
    """M3 / K9 (A6): the whole decision job on the model's out-of-sample rows."""
    params = params or BusinessParams()
    name = model or RAW.champion_name(spark, f"{out}/compare/report")
    mdir = published(spark, model_dir(out, name, use_total_charges))
    sc = scored_test(spark, treated, mdir, seed, test_size).persist()
    seed = int(spark.read.json(f"{mdir}/settings").first()["seed"])
    opt = K.optimal_campaign(sc, params)
    n = int(opt.first()["n_contacted"])
    curves = K.queue_curves(sc, params, seed)
    curves.write.mode("overwrite").parquet(f"{out}/decision/curves")
    curves = spark.read.parquet(f"{out}/decision/curves")
    at_n = K.profit_at_budget(curves, n)
    overlap = K.top_overlap(sc, params)
    sens = K.sensitivity(sc, params, grid)
    sentence = K.business_sentence(opt, curves, sc.count())
    thresholds = K.threshold_summary(sc, params)
    _tables(f"{out}/decision", {"optimal": opt, "profit_at_budget": at_n, "overlap": overlap, "sensitivity": sens,
                                "thresholds": thresholds, "per_customer": K.decision_per_customer(sc, params)})
    pr = params.as_dict()
    report = opt.select(F.struct(*[F.lit(v).alias(k) for k, v in pr.items()]).alias("params"),
                        F.lit(seed).alias("seed"), F.struct(*opt.columns).alias("optimal"),
                        thresholds.select(F.struct(*thresholds.columns)).scalar().alias("thresholds"),
                        sentence.select("sentence").scalar().alias("sentence"),
                        sc.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("rate"))).scalar().alias("test_base"),
                        F.lit(treated.count()).alias("base_size"), RAW.nested(at_n).alias("profit_at_budget"), RAW.nested(overlap).alias("overlap"),
                        RAW.nested(sens).alias("sensitivity"))
    RAW.write_report(report, f"{out}/decision/report")
    return {"optimal": opt, "curves": curves, "sensitivity": sens, "overlap": overlap, "sentence": sentence}


# ----------------------------------------------------------------- M4 segments

def segments_job(spark: SparkSession, treated: DataFrame, out: str, model: str | None = None,
                 params: BusinessParams | None = None, seed: int | None = None, use_total_charges: bool = True,
                 test_size: float | None = None) -> dict:
    from churnlens.operators.explore import churn_by_many

    params = params or BusinessParams()
    cols = ["Contract", "InternetService", "PaymentMethod", "TechSupport", "OnlineSecurity", "SeniorCitizen",
            "Dependents", "Partner", "PaperlessBilling"]
    seg = churn_by_many(treated, cols)
    name = model or RAW.champion_name(spark, f"{out}/compare/report")
    mdir = published(spark, model_dir(out, name, use_total_charges))
    sc = scored_test(spark, treated, mdir, seed, test_size)
    seed = int(spark.read.json(f"{mdir}/settings").first()["seed"])
    contacts = K.contact_list(sc, params)
    _tables(f"{out}/segments", {"churn_by_category": seg, "curves": K.queue_curves(sc, params, seed)})
    n = contacts.count()
    RAW.export_csv(contacts, f"{out}/segments/contact_list_{n}_customers")
    return {"segments": seg, "contacts": contacts}


# ------------------------------------------------------------------------ CLI

def main(argv: list[str] | None = None) -> None:
    """M1-M4 command line (K13 parameters and grid); A9: the treated base table is persisted once."""
    from churnlens.session import get_spark

    ap = argparse.ArgumentParser(prog="python -m churnlens.plans.jobs")
    ap.add_argument("job", choices=["compare", "train", "decide", "segments"])
    ap.add_argument("--csv")
    ap.add_argument("--sf-dir")
    ap.add_argument("--base", default="customer", choices=["customer", "orders"])
    ap.add_argument("--out", required=True)
    ap.add_argument("--model")
    ap.add_argument("--without-total-charges", action="store_true")
    ap.add_argument("--seed", type=int, help="default: 42; when deciding, the model's own")
    ap.add_argument("--test-size", type=float, help="default: 0.2; when deciding, the model's own")
    ap.add_argument("--rounds", type=int, default=300)
    ap.add_argument("--n-splits", type=int, default=5)
    ap.add_argument("--n-repeats", type=int, default=3)
    ap.add_argument("--parallelism", type=int, default=2)
    ap.add_argument("--models", help="comma-separated subset of the ladder (compare)")
    d = BusinessParams()
    ap.add_argument("--margin", type=float, default=d.margin)
    ap.add_argument("--discount", type=float, default=d.discount)
    ap.add_argument("--acceptance", type=float, default=d.acceptance)
    ap.add_argument("--horizon", type=int, default=d.horizon)
    ap.add_argument("--contact-cost", type=float, default=d.contact_cost)
    ap.add_argument("--grid", help='custom sensitivity grid, e.g. "discount=0.05,0.1;margin=0.2,0.3"')
    a = ap.parse_args(argv)
    if not (a.csv or a.sf_dir):
        ap.error("give --csv or --sf-dir")
    spark = SparkSession.getActiveSession() or get_spark()
    treated = load_input(spark, a.csv, a.sf_dir, a.base).persist()
    params = BusinessParams(a.margin, a.discount, a.acceptance, a.horizon, a.contact_cost)
    seed, size = 42 if a.seed is None else a.seed, 0.2 if a.test_size is None else a.test_size
    if a.job == "compare":
        r = compare_job(spark, treated, a.out, seed, a.rounds, a.n_splits, a.n_repeats, a.parallelism, size,
                        models=a.models.split(",") if a.models else None)
        r["champion"].show(truncate=False)
    elif a.job == "train":
        r = train_job(spark, treated, a.out, a.model, not a.without_total_charges, seed, size, a.rounds)
        r["metrics"].show()
    elif a.job == "decide":
        r = decide_job(spark, treated, a.out, a.model, params, a.seed, not a.without_total_charges,
                       parse_grid(a.grid), a.test_size)
        r["optimal"].show()
        print(r["sentence"].first()[0])
    else:
        segments_job(spark, treated, a.out, a.model, params, a.seed, not a.without_total_charges, a.test_size)


if __name__ == "__main__":
    main(sys.argv[1:])
