"""The tables behind each figure (L1-L4, L8) and the kernel density (F13); drawing is not built.

Inputs are the small result tables of the other operators (CV summaries,
per-model predictions, queue curves), so these are cheap projections/unions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.distributions import kde_table
from churnlens.operators.metrics import calibration_curve, evaluate, pr_points, roc_points
from churnlens.operators.ranking import lift_by


def metric_comparison(cv: DataFrame, baseline: str = "contract_rule") -> DataFrame:
    """L1: (metric, model, mean, std, is_baseline) from a CV summary, sorted by metric then mean."""
    parts = [cv.select(F.lit(m).alias("metric"), "model", F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_std").alias("std"))
             for m in ["roc_auc", "pr_auc", "brier"]]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("is_baseline", F.col("model") == baseline).orderBy("metric", F.desc("mean"), "model")


def _role(champion: str, baseline: str):
    return (F.when(F.col("model") == champion, "champion").when(F.col("model") == baseline, "baseline")
            .otherwise("other"))


def curve_series(preds: DataFrame, champion: str, baseline: str = "contract_rule") -> DataFrame:
    """L2: ROC and PR points per model with the role champion / baseline / other."""
    roc = roc_points(preds, by=["model"]).select("model", F.lit("roc").alias("curve"), F.col("fpr").alias("x"),
                                                 F.col("tpr").alias("y"), "threshold")
    pr = pr_points(preds, by=["model"]).select("model", F.lit("pr").alias("curve"), F.col("recall").alias("x"),
                                               F.col("precision").alias("y"), "threshold")
    return roc.unionByName(pr).withColumn("role", _role(champion, baseline))


def calibration_series(preds: DataFrame) -> DataFrame:
    """L3: calibration points per model with the model's Brier score."""
    brier = evaluate(preds, by=["model"]).select("model", "brier")
    return calibration_curve(preds, by=["model"]).join(brier, "model")


def lift_series(preds: DataFrame) -> DataFrame:
    """L4: lift and capture per model and decile, with the no-model capture line (decile / 10)."""
    return lift_by(preds, by=["model"]).withColumn("no_model_capture", F.col("decile") / 10.0)


def budget_curve(curves: DataFrame, optimal: DataFrame) -> DataFrame:
    """Queue curves with the optimum flagged (expected-value queue at the optimal n)."""
    n = optimal.select("n_contacted").scalar()
    return curves.withColumn("is_optimum", (F.col("queue") == "expected_value") & (F.col("contacted") == n))


def kde(df: DataFrame, x: str, by: str, points: int = 100) -> DataFrame:
    """F13 of one column (``distributions.kde_table``)."""
    return kde_table(df, [x], by, points).drop("column")
