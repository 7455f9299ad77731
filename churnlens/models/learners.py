"""Classifiers of the model ladder, expressed with Spark ML.

A learner fits on a prepared DataFrame (``features`` vector + label) and its
fitted form adds a probability-of-churn column. Ensembles share ONE prepared
feature table (one preprocessor fitted on the outer training rows).

* Logistic: the single-machine objective ½‖w‖² + C·Σ loss (C = 1, raw features), by Newton
  steps of one aggregate each (``models/newton.py``); the fits of all folds share these passes.
* AdaBoost (SAMME, depth-1 trees): a row's log weight Σ_j α_j · wrong_j(x) is a column that is
  written with the features every few rounds; the fitted ensemble scores as one expression.
* Gradient boosting: MLlib ``GBTClassifier`` stands in for both boosters
  (first-order, level-wise; same knobs, not the same numbers).
* Isotonic calibration: per fold, Spark's ``IsotonicRegression`` on the held-out
  logit; the calibrated probability is the mean over folds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.models.isotonic import isotonic_blocks
from churnlens.models.newton import FittedLogistic, rows_of, solve
from churnlens.models.stumps import Stump, StumpSearch, stump_of, votes
from churnlens.operators.ordered import stored
from churnlens.operators.splits import stratified_folds

LABEL = S.TARGET
FEATURES = "features"


def _p1(col: str) -> Column:
    return vector_to_array(F.col(col))[1]


# ------------------------------------------------------------------ logistic

@dataclass
class Logistic:
    """Ridge logistic regression (C = 1, the intercept free), ``balanced``: with class weights."""

    balanced: bool = False
    features: str = FEATURES

    def fit(self, df: DataFrame, label: str = LABEL, tag: str = "lr") -> FittedLogistic:
        return self.fit_many(df, [F.lit(True)], label)[0]

    def weights(self, df: DataFrame, members: list[Column], label: str = LABEL) -> list[Column]:
        """A row's weight per member condition: 0 where it doesn't hold, else 1, or n / (2 · n_class) (J7) of
        the rows for which it holds, from one aggregate of class counts."""
        if not self.balanced:
            return [F.when(m, 1.0).otherwise(0.0) for m in members]
        counts = {r[0]: r[1:] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(
            *[F.count_if(m).alias(f"n{i}") for i, m in enumerate(members)]).collect()}  # one row per class
        out = []
        for i, m in enumerate(members):
            held = {y: n[i] for y, n in counts.items() if n[i]}
            each = F.lit(0.0)
            for y, n in held.items():
                each = F.when(F.col(label) == y, sum(held.values()) / (len(held) * n)).otherwise(each)
            out.append(F.when(m, each).otherwise(0.0))
        return out

    def fit_many(self, df: DataFrame, members: list[Column], label: str = LABEL) -> list[FittedLogistic]:
        """One model per member condition, on the rows for which it holds; all in the same passes."""
        rows = stored(rows_of(df, label, self.features, self.weights(df, members, label)), "logistic")
        first = rows.select(F.size("x")).first()
        if first is None:
            raise ValueError("no rows to fit on")
        solved = solve(rows, first[0], len(members))
        return [FittedLogistic(float(w[0]), [float(c) for c in w[1:]], self.features) for w in solved]


@dataclass
class FittedSpark:
    model: object
    tag: str

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        t = self.model.transform(df)
        return t.withColumn(out, _p1(f"_prob_{self.tag}")).drop(
            f"_prob_{self.tag}", f"_raw_{self.tag}", f"_pred_{self.tag}")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


# ------------------------------------------------------------- boosted trees

@dataclass
class GBT:
    """J9 / J10 stand-in: MLlib gradient-boosted trees."""

    rounds: int = 300
    step: float = 0.05
    depth: int = 3
    subsample: float = 0.8
    feature_fraction: str = "0.8"
    seed: int = 42
    features: str = FEATURES

    def fit(self, df: DataFrame, label: str = LABEL, tag: str = "gbt"):
        g = GBTClassifier(featuresCol=self.features, labelCol=label, maxIter=self.rounds, stepSize=self.step,
                          maxDepth=self.depth, subsamplingRate=self.subsample,
                          featureSubsetStrategy=self.feature_fraction, seed=self.seed, predictionCol=f"_pred_{tag}")
        g.setProbabilityCol(f"_prob_{tag}").setRawPredictionCol(f"_raw_{tag}")
        return FittedSpark(g.fit(df), tag)


# ------------------------------------------------------------------ AdaBoost

@dataclass
class AdaBoost:
    """SAMME with decision stumps, ``rounds`` rounds, shrinkage ``learning_rate``.

    Each round's stump is the best over all split points (``models/stumps.py``). A row's log weight is a
    column; every ``flush`` rounds it is written with the features, so a round's expression has that many
    terms at most.
    """

    rounds: int = 300
    learning_rate: float = 0.5
    flush: int = 25
    features: str = FEATURES

    def fit(self, df: DataFrame, label: str = LABEL, tag: str = "ada"):
        base = stored(df.select(vector_to_array(F.col(self.features)).alias("x"), F.col(label).cast("double").alias("y"),
                                F.lit(0.0).alias("_lw")), "boost")
        search = StumpSearch(base)
        stumps: list[Stump] = []
        log_w, bound = F.col("_lw"), 0.0
        for i in range(self.rounds):
            split, total = search.best(base.withColumn("w", F.exp(log_w - F.lit(bound))))
            stump, wrong = stump_of(split, total, 0.0)
            err = wrong / sum(total)
            if err <= 0:
                stumps.append(replace(stump, alpha=1.0))
                break
            if err >= 0.5:
                if not stumps:
                    raise ValueError("AdaBoost: first stump is no better than chance")
                break
            alpha = self.learning_rate * math.log((1 - err) / err)
            stumps.append(replace(stump, alpha=alpha))
            log_w, bound = log_w + F.lit(alpha) * (stump.predicted() != F.col("y")).cast("double"), bound + alpha
            if (i + 1) % self.flush == 0:
                base, log_w = stored(base.withColumn("_lw", log_w), "boost"), F.col("_lw")
        return FittedAdaBoost(stumps, self.features)


@dataclass
class FittedAdaBoost:
    stumps: list[Stump] = field(repr=False)
    features: str = FEATURES

    def decision(self, arr: str = "_fa") -> Column:
        return votes(self.stumps, arr) / F.lit(sum(s.alpha for s in self.stumps))

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        d = df.withColumn("_fa", vector_to_array(F.col(self.features)))
        return d.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * self.decision()))).drop("_fa")


# ------------------------------------------------------------------ ensembles

@dataclass
class Voting:
    """Soft voting — mean of the base probabilities."""

    bases: list

    def fit(self, df: DataFrame, label: str = LABEL, tag: str = "vote"):
        return FittedVoting([b.fit(df, label, tag=f"{tag}{i}") for i, b in enumerate(self.bases)])


@dataclass
class FittedVoting:
    fitted: list

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        d = df
        for i, f in enumerate(self.fitted):
            d = f.predict(d, out=f"_pv{i}")
        mean = sum((F.col(f"_pv{i}") for i in range(len(self.fitted))), F.lit(0.0)) / len(self.fitted)
        return d.withColumn(out, mean).drop(*[f"_pv{i}" for i in range(len(self.fitted))])


@dataclass
class Stacking:
    """5-fold out-of-fold base probabilities → logistic meta-learner; bases refit on all rows."""

    bases: list
    n_folds: int = 5
    seed: int = 42

    def fit(self, df: DataFrame, label: str = LABEL, tag: str = "stack"):
        # folds are dealt with the features and written once: a lost executor doesn't deal them again
        d = stored(stratified_folds(df, label, self.n_folds, 1, self.seed, keep=[FEATURES]), "stack")
        cols = [f"_pb{i}" for i in range(len(self.bases))]
        others = [F.col("fold") != k for k in range(self.n_folds)]
        # logistic bases are fitted on all folds in the same passes
        fitted = [b.fit_many(d, others, label) if isinstance(b, Logistic) else None for b in self.bases]
        oof = None
        for k in range(self.n_folds):
            h, train = d.filter(F.col("fold") == k), d.filter(others[k])
            for i, b in enumerate(self.bases):
                own = fitted[i][k] if fitted[i] else b.fit(train, label, tag=f"{tag}f{k}b{i}")
                h = own.predict(h, out=cols[i])
            part = h.select(label, *cols)
            oof = part if oof is None else oof.unionByName(part)
        meta_in = VectorAssembler(inputCols=cols, outputCol="_meta").transform(oof)
        meta = Logistic(features="_meta").fit(meta_in, label, tag=f"{tag}m")
        full = [b.fit(df, label, tag=f"{tag}b{i}") for i, b in enumerate(self.bases)]
        return FittedStacking(full, meta)


@dataclass
class FittedStacking:
    bases: list
    meta: FittedLogistic

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        d = df
        cols = []
        for i, b in enumerate(self.bases):
            d = b.predict(d, out=f"_pb{i}")
            cols.append(f"_pb{i}")
        d = VectorAssembler(inputCols=cols, outputCol="_meta").transform(d)
        return self.meta.predict(d, out=out).drop("_meta", *cols)


@dataclass
class IsotonicCalibrated:
    """Balanced logistic recalibrated by isotonic regression on held-out logits, 5 folds averaged."""

    base: Logistic = field(default_factory=lambda: Logistic(balanced=True))
    n_folds: int = 5
    seed: int = 42

    def fit(self, df: DataFrame, label: str = LABEL, tag: str = "iso"):
        d = stored(stratified_folds(df, label, self.n_folds, 1, self.seed, keep=[self.base.features]), "iso")
        fitted = self.base.fit_many(d, [F.col("fold") != k for k in range(self.n_folds)], label)
        held = None
        for k, f in enumerate(fitted):
            part = f.logit(d.filter(F.col("fold") == k), "_logit").select("fold", "_logit", F.col(label).cast("double").alias("_y"))
            held = part if held is None else held.unionByName(part)
        # pooled where the rows are; Spark's model is made from the blocks' ends alone
        blocks = stored(isotonic_blocks(held, "_logit", "_y", ["fold"]), "blocks")
        ends = blocks.select("fold", F.explode(F.when(F.col("low") < F.col("high"), F.array("low", "high")).otherwise(F.array("low"))).alias("_logit"),
                             F.col("mean").alias("_y"), "weight")
        iso = IsotonicRegression(featuresCol="_logit", labelCol="_y", weightCol="weight", predictionCol="_iso", isotonic=True)
        return FittedIsotonic([(f, iso.fit(ends.filter(F.col("fold") == k))) for k, f in enumerate(fitted)])


@dataclass
class FittedIsotonic:
    pairs: list

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        d = df
        cols = []
        for k, (fitted, iso) in enumerate(self.pairs):
            d = fitted.logit(d, out="_logit")
            d = iso.transform(d).withColumnRenamed("_iso", f"_pc{k}").drop("_logit")
            cols.append(f"_pc{k}")
        mean = sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols)
        return d.withColumn(out, F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0))).drop(*cols)


# ------------------------------------------------------------- rule baseline

@dataclass
class ContractRule:
    """p = training churn rate inside / outside one category (reads the raw text column)."""

    column: str = "Contract"
    category: str = S.MONTH_TO_MONTH

    def fit(self, df: DataFrame, label: str = LABEL, tag: str = "rule"):
        rows = df.groupBy((F.col(self.column) == self.category).alias("flag")).agg(
            F.avg(F.col(label).cast("double")).alias("rate")).collect()  # two rows
        rates = {r["flag"]: r["rate"] for r in rows}
        return FittedRule(self.column, self.category, rates.get(True), rates.get(False))


@dataclass
class FittedRule:
    column: str
    category: str
    rate_flagged: float | None
    rate_rest: float | None

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        flag = F.col(self.column) == self.category
        return df.withColumn(out, F.when(flag, F.lit(self.rate_flagged)).otherwise(F.lit(self.rate_rest)))

    def predict_class(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, (F.col(self.column) == self.category).cast("int"))
