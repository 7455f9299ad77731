"""Cross-validation, the paired comparison, test measurement and the calibration
experiment (I3, I4, I5, I8, I9) — fits orchestrated from the driver, data on Spark.

Each fit is a set of Spark jobs; independent fits run concurrently from a
driver thread pool (``parallelism``); the logistic fits of all folds share their
passes. A finished fit is noted in a ledger, so a run that broke off goes on where it was. Every fit's validation predictions are
written — collapsed to (score -> positives, negatives) — as its own parquet
folder under the shared checkpoint directory (a written table cuts lineage and
survives executor loss); all metrics are then computed in ONE grouped job. Each model is fitted
once per fold: the CV table and the paired table both derive from the same
``fold_scores`` (no refit).
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.models.catalog import ChurnModel
from churnlens.models.features import numeric_columns, preprocessing_stages
from churnlens.models.learners import Logistic
from churnlens.models.newton import FittedLogistic, rows_of, solve
from churnlens.operators import selection as SEL
from churnlens.operators.ordered import stored
from churnlens.operators.metrics import calibration_curve, evaluate, evaluate_counts, score_counts
from churnlens.operators.ranking import lift_by
from churnlens.operators.splits import stratified_folds
from churnlens.session import ensure_checkpoint_dir


def scratch_path(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/churnlens/{name}-{uuid.uuid4().hex[:12]}"


def _write_counts(fitted, frame: DataFrame, path: str, label: str) -> None:
    """Validation scores collapsed to (p -> pos, neg): everything the CV metrics need, and far
    smaller than row-level predictions on a large table."""
    scored = fitted.score(frame).select(F.col(label).cast("int").alias("y"), "p")
    score_counts(scored).write.mode("overwrite").parquet(path)


def _write_predictions(fitted, frame: DataFrame, path: str, label: str) -> None:
    fitted.score(frame).select(S.ID, F.col(label).cast("int").alias("y"), "p").write.mode("overwrite").parquet(path)


FITS = "model string, repeat int, fold int, seconds double"


def run_id(train: DataFrame, **settings) -> str:
    """A name that the same rows and settings always get: what an interrupted run is found again by."""
    rows = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(train.columns)]
    n, a = train.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows).cast("decimal(38,0)"))).first()
    return hashlib.sha256(json.dumps([n, str(a), sorted(train.columns), settings], sort_keys=True).encode()).hexdigest()[:20]


class Ledger:
    """Fits that are done, one row each, written after a fit's scores; read when a run begins. Fits that end
    at the same time write folders of their own."""

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path
        try:
            rows = spark.read.schema(FITS).option("recursiveFileLookup", True).json(path).collect()  # a row per fit
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        self.done = {(r["model"], r["repeat"], r["fold"]): r["seconds"] for r in rows}

    def add(self, fits: list[tuple]) -> None:
        name, repeat, fold, _ = fits[0]
        self.spark.createDataFrame(fits, FITS).coalesce(1).write.mode("overwrite").json(f"{self.path}/{name}-{repeat}-{fold}")


def _fold_columns(n_repeats: int) -> list[str]:
    return [f"fold_{r}" for r in range(n_repeats)]


def with_folds(train: DataFrame, label: str, n_splits: int, n_repeats: int, seed: int) -> DataFrame:
    """The rows with one fold column per repeat, written once: a fit's rows are then a plain filter."""
    folds = stratified_folds(train, y=label, n_splits=n_splits, n_repeats=n_repeats, seed=seed)
    wide = folds.groupBy(S.ID).agg(*[F.max(F.when(F.col("repeat") == r, F.col("fold"))).alias(c) for r, c in enumerate(_fold_columns(n_repeats))])
    return stored(train.join(wide, S.ID), "cv")


def _logistic_folds(model: ChurnModel, data: DataFrame, path: str, n_splits: int, n_repeats: int, label: str) -> None:
    """All fits of a logistic model at once: raw features are assembled once, each fit scales them by its own
    training rows, and every pass over the rows serves all fits. Scores of all validation sets are written together."""
    from pyspark.ml import Pipeline

    learner, num = model.learner, numeric_columns(model.use_total_charges)
    prep = Pipeline(stages=preprocessing_stages(model.use_total_charges, scaled=False)).fit(data)
    fits = [(r, k) for r in range(n_repeats) for k in range(n_splits)]
    members = [F.col(f"fold_{r}") != k for r, k in fits]
    feats = prep.transform(data)
    rows = stored(rows_of(feats, label, learner.features, learner.weights(data, members, label)), "cv-logistic")
    scale = data.agg(*[f(F.when(m, F.col(c).cast("double"))) for m in members for c in num for f in (F.avg, F.stddev_pop)]).first()
    moments = np.array([x or 0.0 for x in scale], float).reshape(len(fits), len(num), 2)
    width = rows.select(F.size("x")).first()[0]
    means, scales = np.zeros((len(fits), width)), np.ones((len(fits), width))
    means[:, :len(num)] = moments[:, :, 0]
    scales[:, :len(num)] = np.where(moments[:, :, 1] > 0, moments[:, :, 1], 1.0)
    solved = solve(rows, width, len(fits), means, scales)
    per = {}
    for (r, k), w, m, s in zip(fits, solved, means, scales, strict=True):
        raw = w[1:] / s
        per[r, k] = FittedLogistic(float(w[0] - raw @ m), raw.tolist(), learner.features).probability("_fa")
    scored = feats.select(F.col(label).cast("int").alias("y"), *_fold_columns(n_repeats), vector_to_array(F.col(learner.features)).alias("_fa"))
    each = []
    for r in range(n_repeats):
        p = F.lit(None).cast("double")
        for k in range(n_splits):
            p = F.when(F.col(f"fold_{r}") == k, per[r, k]).otherwise(p)
        each.append(F.struct(F.lit(r).alias("repeat"), F.col(f"fold_{r}").alias("fold"), p.alias("p")))
    counts = score_counts(scored.select("y", F.inline(F.array(*each))), by=["repeat", "fold"])
    counts.write.mode("overwrite").partitionBy("repeat", "fold").parquet(path)


def cross_validate(train: DataFrame, models: dict[str, ChurnModel], n_splits: int = 5, n_repeats: int = 3,
                   seed: int = 42, parallelism: int = 2, label: str = S.TARGET, run: str | None = None) -> DataFrame:
    """fold_scores (model, repeat, fold, roc_auc, pr_auc, brier, seconds).

    ``run``: a folder on the shared file system. Fits whose scores a run under the same folder has written
    (``run_id`` names one by rows and settings) are taken from there and not repeated. The fits of a
    logistic model share their passes; ``seconds`` is then their mean.
    """
    spark = train.sparkSession
    data = with_folds(train, label, n_splits, n_repeats, seed)
    root = run or scratch_path(spark, "cv")
    ledger = Ledger(spark, f"{root}/fits")
    fits = [(r, k) for r in range(n_repeats) for k in range(n_splits)]
    tasks = [(name, r, k) for r, k in fits for name, m in models.items()
             if not isinstance(m.learner, Logistic) and (name, r, k) not in ledger.done]

    def one(task):
        name, r, k = task
        rows = data.select(*train.columns, F.col(f"fold_{r}").alias("_fold"))
        tr, va = rows.filter(F.col("_fold") != k).drop("_fold"), rows.filter(F.col("_fold") == k).drop("_fold")
        t0 = time.perf_counter()
        fitted = models[name].fit(tr, label)
        seconds = time.perf_counter() - t0
        _write_counts(fitted, va, f"{root}/scores/model={name}/repeat={r}/fold={k}", label)
        ledger.add([(name, r, k, seconds)])
        return (name, r, k), seconds

    for name, m in models.items():
        if isinstance(m.learner, Logistic) and any((name, r, k) not in ledger.done for r, k in fits):
            t0 = time.perf_counter()
            _logistic_folds(m, data, f"{root}/scores/model={name}", n_splits, n_repeats, label)
            seconds = (time.perf_counter() - t0) / len(fits)
            ledger.add([(name, r, k, seconds) for r, k in fits])
            ledger.done.update({(name, r, k): seconds for r, k in fits})
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        ledger.done.update(pool.map(one, tasks))
    # an unfinished fit may have left scores, and an earlier run other models
    timings = [(name, r, k, ledger.done[name, r, k]) for name in models for r, k in fits]
    secs = spark.createDataFrame(timings, FITS)
    by = ["model", "repeat", "fold"]
    counts = spark.read.schema("p double, pos long, neg long, model string, repeat int, fold int").parquet(f"{root}/scores")
    scores = evaluate_counts(counts.filter(F.col("model").isin(list(models))), by).select(*by, *SEL.METRICS)
    return scores.join(F.broadcast(secs), by)  # a row per fit


def test_measurement(train: DataFrame, test: DataFrame, models: dict[str, ChurnModel], parallelism: int = 2,
                     label: str = S.TARGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit each model on all training rows, score the test rows ONCE; return
    (metrics by model, calibration curves by model, lift tables by model)."""
    spark = train.sparkSession
    root = scratch_path(spark, "test")

    def run(name):
        fitted = models[name].fit(train, label)
        _write_predictions(fitted, test, f"{root}/model={name}", label)
        return name

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        list(pool.map(run, list(models)))
    preds = spark.read.parquet(root)
    metrics = evaluate(preds, by=["model"])
    calib = calibration_curve(preds, by=["model"])
    lifts = lift_by(preds, by=["model"])  # deciles inside each model, one job
    return metrics, calib, lifts


def calibration_experiment(train: DataFrame, test: DataFrame, variants: dict[str, ChurnModel],
                           label: str = S.TARGET) -> tuple[DataFrame, DataFrame]:
    """Metrics + mean predicted probability (F17) and calibration curve per variant."""
    spark = train.sparkSession
    root = scratch_path(spark, "calib")
    for name, m in variants.items():
        _write_predictions(m.fit(train, label), test, f"{root}/variant={name}", label)
    preds = spark.read.parquet(root)
    metrics = evaluate(preds, by=["variant"]).join(
        preds.groupBy("variant").agg(F.avg("p").alias("mean_p")), "variant")
    return metrics, calibration_curve(preds, by=["variant"])


def compare(fold_scores: DataFrame, reference: str = "logistic") -> tuple[DataFrame, DataFrame, DataFrame]:
    """I5 + I6 from one fold_scores table: (cv summary, paired table, champion row)."""
    cv = SEL.cv_summary(fold_scores)
    paired = SEL.paired_comparison(fold_scores, reference=reference)
    return cv, paired, SEL.champion(paired, cv)
