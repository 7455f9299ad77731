"""Fitted models on disk (A7): one folder per model, its parts in folders below, all in Spark's formats.

``kind`` (a one-row JSON table) says what a folder holds; a kind that isn't known raises on both ways.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import SparkSession

from churnlens.models.learners import (
    FittedAdaBoost,
    FittedIsotonic,
    FittedRule,
    FittedSpark,
    FittedStacking,
    FittedVoting,
)
from churnlens.models.newton import FittedLogistic
from churnlens.models.stumps import Stump

SPARK_MODELS = {"logistic": LogisticRegressionModel, "boosted trees": GBTClassificationModel}
PLAIN = {"rule": FittedRule, "ridge logistic": FittedLogistic}  # their fields are all there is


def _note(path: str, kind: str, **values) -> None:
    spark = SparkSession.active()
    spark.createDataFrame([(kind, json.dumps(values))], "kind string, fields string").coalesce(1).write.mode("overwrite").json(f"{path}/kind")


def save(fitted, path: str) -> None:
    if isinstance(fitted, FittedSpark):
        kind = next((k for k, cls in SPARK_MODELS.items() if isinstance(fitted.model, cls)), None)
        if kind is None:
            raise ValueError(f"no way to save a {type(fitted.model).__name__}")
        fitted.model.write().overwrite().save(f"{path}/model")
        _note(path, kind, tag=fitted.tag)
    elif isinstance(fitted, FittedAdaBoost):
        _note(path, "adaboost", features=fitted.features, stumps=[vars(s) for s in fitted.stumps])
    elif type(fitted) in PLAIN.values():
        _note(path, next(k for k, cls in PLAIN.items() if cls is type(fitted)), **vars(fitted))
    elif isinstance(fitted, (FittedVoting, FittedStacking)):
        stacking = isinstance(fitted, FittedStacking)
        parts = fitted.bases if stacking else fitted.fitted
        for i, b in enumerate(parts):
            save(b, f"{path}/base{i}")
        if stacking:
            save(fitted.meta, f"{path}/meta")
        _note(path, "stacking" if stacking else "voting", parts=len(parts))
    elif isinstance(fitted, FittedIsotonic):
        for i, (b, iso) in enumerate(fitted.pairs):
            save(b, f"{path}/base{i}")
            iso.write().overwrite().save(f"{path}/isotonic{i}")
        _note(path, "isotonic", parts=len(fitted.pairs))
    else:
        raise ValueError(f"no way to save a {type(fitted).__name__}")


def load(path: str):
    row = SparkSession.active().read.schema("kind string, fields string").json(f"{path}/kind").first()
    kind, fields = row["kind"], json.loads(row["fields"])
    if kind in SPARK_MODELS:
        return FittedSpark(SPARK_MODELS[kind].load(f"{path}/model"), fields["tag"])
    if kind == "adaboost":
        return FittedAdaBoost([Stump(**dict(s, values=tuple(s["values"]))) for s in fields["stumps"]], fields["features"])
    if kind in PLAIN:
        return PLAIN[kind](**fields)
    bases = [load(f"{path}/base{i}") for i in range(fields.get("parts", 0))]
    if kind == "voting":
        return FittedVoting(bases)
    if kind == "stacking":
        return FittedStacking(bases, load(f"{path}/meta"))
    if kind == "isotonic":
        return FittedIsotonic([(b, IsotonicRegressionModel.load(f"{path}/isotonic{i}")) for i, b in enumerate(bases)])
    raise ValueError(f"{path} holds a model of unknown kind {kind!r}")
