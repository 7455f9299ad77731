"""Feature preparation as Spark ML stages.

* numerics: standardised with the POPULATION std learned on the training rows
  (``PopulationScaler``; Spark's StandardScaler uses the sample std);
* 3 categoricals (J2): StringIndexer(alphabetAsc, keep) + OneHotEncoder(dropLast) —
  every known level kept, an unseen level encodes to all zeros;
* 13 model binaries passed through; anything else is dropped;
* assembled to 26 columns (25 without TotalCharges) in the order num, cat, bin.

Everything learned lives inside the Pipeline, so it only sees training rows.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import schema as S


class _ScalerParams(HasInputCols, HasOutputCols):
    means = Param(Params._dummy(), "means", "column means", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population standard deviations", typeConverter=TypeConverters.toListFloat)


class PopulationScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """(x − mean) / stddev_pop per column, learned in ONE aggregate over the training rows."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "PopulationScalerModel":
        cols = self.getInputCols()
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        means = [float(row[f"m{i}"]) for i in range(len(cols))]
        # a constant column keeps scale 1, like the single-machine scaler
        stds = [float(row[f"s{i}"]) if row[f"s{i}"] else 1.0 for i in range(len(cols))]
        return PopulationScalerModel(inputCols=cols, outputCols=self.getOutputCols(), means=means, stds=stds)


class PopulationScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        pairs = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault("means"), self.getOrDefault("stds"))
        return df.withColumns({o: (F.col(i).cast("double") - m) / s for i, o, m, s in pairs})


def numeric_columns(use_total_charges: bool = True) -> list[str]:
    """The feature subset switch (ablation without TotalCharges)."""
    return [c for c in S.NUMERIC if use_total_charges or c != "TotalCharges"]


def preprocessing_stages(use_total_charges: bool = True, features: str = "features", scaled: bool = True) -> list:
    """Population scaler, one-hot (unknown -> zeros), binaries passed, assembled vector.
    Without ``scaled`` the numerics are passed as they are, for fits that scale on their own."""
    num = numeric_columns(use_total_charges)
    cat = S.CATEGORICAL
    scaler = [PopulationScaler(inputCols=num, outputCols=[f"{c}__z" for c in num])] if scaled else []
    return [
        *scaler,
        StringIndexer(inputCols=cat, outputCols=[f"{c}__idx" for c in cat], stringOrderType="alphabetAsc",
                      handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}__idx" for c in cat], outputCols=[f"{c}__oh" for c in cat], dropLast=True),
        VectorAssembler(inputCols=[f"{c}__z" if scaled else c for c in num] + [f"{c}__oh" for c in cat] + S.MODEL_BINARIES,
                        outputCol=features, handleInvalid="keep"),
    ]


def feature_names(df: DataFrame, features: str = "features") -> list[str]:
    """Names of the assembled features, read from the ML attribute metadata."""
    attrs = df.schema[features].metadata["ml_attr"]["attrs"]
    flat = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)
    return [n for _, n in flat]
