"""Model catalogue (J16), preprocessing + learner wrappers, scoring (J15) and coefficients."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.models import store
from churnlens.models.features import feature_names, preprocessing_stages
from churnlens.models.learners import (
    GBT,
    AdaBoost,
    ContractRule,
    IsotonicCalibrated,
    Logistic,
    Stacking,
    Voting,
)
from churnlens.models.newton import FittedLogistic

# --- fixed values: model keys in ladder order and the reference's display names
MODEL_ORDER = ["contract_rule", "logistic", "adaboost", "xgboost", "lightgbm", "voting", "stacking"]
DISPLAY_NAMES = {
    "contract_rule": "Regra de contrato",
    "logistic": "Regressão logística",
    "adaboost": "AdaBoost",
    "xgboost": "XGBoost",
    "lightgbm": "LightGBM",
    "voting": "Ensemble (votação)",
    "stacking": "Ensemble (stacking)",
}
# ---------------------------------------------------------------------------


@dataclass
class ChurnModel:
    """A named model: feature preparation (unless it reads raw columns) + a learner."""

    name: str
    learner: object
    use_total_charges: bool = True
    prepared: bool = True

    def fit(self, train: DataFrame, label: str = S.TARGET) -> "FittedModel":
        if not self.prepared:
            return FittedModel(self.name, None, self.learner.fit(train, label))
        prep = Pipeline(stages=preprocessing_stages(self.use_total_charges)).fit(train)
        feats = prep.transform(train)
        if isinstance(self.learner, Logistic):  # reads them once, to write what its passes read
            return FittedModel(self.name, prep, self.learner.fit(feats, label))
        feats = feats.persist()
        try:
            fitted = self.learner.fit(feats, label)
        finally:
            feats.unpersist()
        return FittedModel(self.name, prep, fitted)


@dataclass
class FittedModel:
    name: str
    prep: object
    fitted: object = field(repr=False)

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """P(churn = 1) as column ``out``; input columns kept, feature columns dropped."""
        cols = df.columns
        d = self.prep.transform(df) if self.prep is not None else df
        return self.fitted.predict(d, out=out).select(*cols, out)

    def coefficients(self, sample: DataFrame) -> DataFrame:
        """Named coefficients for linear models; empty for the others."""
        spark = sample.sparkSession
        if not isinstance(self.fitted, FittedLogistic):
            return spark.createDataFrame([], "feature string, coefficient double")
        names = feature_names(self.prep.transform(sample.limit(1)))
        rows = [("intercept", self.fitted.intercept), *zip(names, self.fitted.coefficients, strict=True)]
        return spark.createDataFrame(rows, "feature string, coefficient double")

    def save(self, path: str) -> None:
        """The feature preparation and the model, one folder each."""
        if self.prep is not None:
            self.prep.write().overwrite().save(f"{path}/prep")
        store.save(self.fitted, f"{path}/model")
        store._note(path, "churn model", name=self.name, prepared=self.prep is not None)


def catalogue(use_total_charges: bool = True, seed: int = 42, rounds: int = 300) -> dict[str, ChurnModel]:
    """Name -> model, in ladder order. ``rounds`` scales every booster (tests use few)."""

    def ada():
        return AdaBoost(rounds=rounds, learning_rate=0.5)

    def xgb():
        return GBT(rounds=rounds, step=0.05, depth=3, subsample=0.8, feature_fraction="0.8", seed=seed)

    def lgbm():
        # leaf-wise 15 leaves → level-wise depth 4 stand-in; row subsampling is inert in the original
        return GBT(rounds=rounds, step=0.05, depth=4, subsample=1.0, feature_fraction="0.8", seed=seed)

    def bases():
        return [Logistic(), ada(), xgb(), lgbm()]

    u = use_total_charges
    return {
        "contract_rule": ChurnModel("contract_rule", ContractRule(), u, prepared=False),
        "logistic": ChurnModel("logistic", Logistic(), u),
        "adaboost": ChurnModel("adaboost", ada(), u),
        "xgboost": ChurnModel("xgboost", xgb(), u),
        "lightgbm": ChurnModel("lightgbm", lgbm(), u),
        "voting": ChurnModel("voting", Voting(bases()), u),
        "stacking": ChurnModel("stacking", Stacking(bases(), seed=seed), u),
    }


def get_model(name: str, **kw) -> ChurnModel:
    cat = catalogue(**kw)
    if name not in cat:
        raise ValueError(f"unknown model {name!r}; choose one of {list(cat)}")
    return cat[name]


def calibration_variants(seed: int = 42) -> dict[str, ChurnModel]:
    """I8: plain logistic, class-balanced logistic, balanced + isotonic recalibration."""
    return {
        "plain": ChurnModel("plain", Logistic()),
        "balanced": ChurnModel("balanced", Logistic(balanced=True)),
        "balanced_isotonic": ChurnModel("balanced_isotonic", IsotonicCalibrated(seed=seed)),
    }


def load_fitted(path: str, name: str | None = None) -> FittedModel:
    """A model saved by ``FittedModel.save``, of any kind; a folder without one raises."""
    from pyspark.ml import PipelineModel
    from pyspark.sql import SparkSession

    row = SparkSession.active().read.schema("kind string, fields string").json(f"{path}/kind").first()
    about = json.loads(row["fields"])
    prep = PipelineModel.load(f"{path}/prep") if about["prepared"] else None
    return FittedModel(name or about["name"], prep, store.load(f"{path}/model"))
