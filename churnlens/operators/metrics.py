"""Model metrics over a scored table (id, y, p) as distributed DataFrame queries (H1-H7).

Rankings only need the DISTINCT scores: rows are first collapsed to
(group, p) -> (positives, negatives) with a map-side partial aggregate, then
running counts in descending score come from ``ordered_prefix`` (distributed,
no one-task window). From those:

* ROC-AUC with ties averaged = Σ neg_s · (P_above_s + pos_s / 2) / (P · N)
* average precision (step sum)  = Σ pos_s / P · precision_s
* ROC / PR points per distinct threshold, collinear ROC points dropped.

All functions accept ``by`` grouping columns (e.g. split, model, fold) so
many score sets are measured in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.lookup import lookup
from churnlens.operators.ordered import ordered_prefix, stored
from churnlens.operators.stats import exact_quantiles


def score_counts(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Collapse rows to distinct (by, score) with positive / negative counts."""
    return df.groupBy(*by, F.col(p).alias("p")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"),
        F.sum((1 - F.col(y)).cast("long")).alias("neg"))


def cumulative_scores(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (),
                      counted: bool = False) -> DataFrame:
    """(by, p, pos, neg, rn, tps, fps): cumulative counts at each distinct score, descending.
    ``counted=True`` when ``df`` already is a stored (by, p, pos, neg) table."""
    sc = df if counted else stored(score_counts(df, y, p, by), "scores")
    cum = ordered_prefix(sc, [("p", True)], sums=["pos", "neg"], partition=by, rn="rn", write=False, apart=True)
    return cum.withColumnRenamed("cum_pos", "tps").withColumnRenamed("cum_neg", "fps")


def _totals(cum: DataFrame, sc: DataFrame, by: list[str], aggs: dict) -> DataFrame:
    """Attach per-group totals of the collapsed table ``sc``: a lookup on the group keys, or one
    scalar subquery when ungrouped (no constant-key join)."""
    if by:
        return lookup(cum, sc.groupBy(*by).agg(*[a.alias(k) for k, a in aggs.items()]), by)
    one = sc.agg(F.struct(*[a.alias(k) for k, a in aggs.items()])).scalar()  # ONE subquery for all totals
    return cum.withColumns({k: one[k] for k in aggs})


def ranking_metrics(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """H1 + H2: (by, roc_auc, pr_auc)."""
    return evaluate(df, y, p, by).select(*by, "roc_auc", "pr_auc")


def evaluate(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """H4: (by, roc_auc, pr_auc, brier, base_rate, n), all from ONE pass over the rows:
    rows collapse to (by, p, pos, neg), and every metric is computed on that table."""
    return evaluate_counts(stored(score_counts(df, y, p, by), "scores"), by)


def evaluate_counts(sc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """H1-H4 from a stored (by, p, pos, neg) table: one order, one aggregate. H3 Brier = Σ pos·(p−1)² + neg·p² over n.
    ROC-AUC and PR-AUC are null, not an ANSI error, when a group has a single class."""
    by = list(by)
    cum = cumulative_scores(sc, by=by, counted=True)
    pos, neg, n = F.col("n_pos"), F.col("n_neg"), F.col("n_pos") + F.col("n_neg")
    sums = cum.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.sum(F.col("neg") * ((F.col("tps") - F.col("pos")) + F.col("pos") / 2.0)).alias("_auc"),
        F.sum(F.col("pos") * F.col("tps") / (F.col("tps") + F.col("fps"))).alias("_ap"),
        F.sum(F.col("pos") * (F.col("p") - 1) ** 2 + F.col("neg") * F.col("p") ** 2).alias("_se"))
    return sums.select(*by, F.try_divide("_auc", pos.cast("double") * neg).alias("roc_auc"), F.try_divide("_ap", pos).alias("pr_auc"),
                       (F.col("_se") / n).alias("brier"), (pos / n).alias("base_rate"), n.alias("n"))


def calibration_curve(df: DataFrame, y: str = "y", p: str = "p", n_bins: int = 10,
                      by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """H5: quantile calibration — edges are exact percentiles of p; bin = inner edges strictly
    below p; empty bins dropped. Returns (by, bin, predicted, observed, n)."""
    by = list(by)
    probs = [i / n_bins for i in range(1, n_bins)]
    edges = exact_quantiles(df.select(*by, F.col(p).alias("_x")), "_x", probs, by=by, approx=approx)
    arr = edges.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("q", "value"))).alias("_e")) \
        .select(*by, F.transform("_e", lambda s: s["value"]).alias("_edges"))
    # one row per group, or a scalar subquery when ungrouped
    j = lookup(df, arr, by) if by else df.withColumn("_edges", arr.select("_edges").scalar())
    binned = j.withColumn("bin", F.size(F.filter("_edges", lambda e: e < F.col(p))))
    return binned.groupBy(*by, "bin").agg(
        F.avg(F.col(p)).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"),
        F.count(F.lit(1)).alias("n"))


def roc_points(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """H6: ROC points (fpr, tpr, threshold) per distinct threshold, collinear points dropped,
    plus the origin (threshold null). A point is on the line of its neighbours if the next score has
    the same counts, so one order gives all that is needed."""
    by = list(by)
    sc = stored(score_counts(df, y, p, by), "scores")
    cum = ordered_prefix(sc, [("p", True)], sums=["pos", "neg"], partition=by, rn="rn", write=False, nexts=["pos", "neg"], apart=True)
    j = _totals(cum, sc, by, {"n_pos": F.sum("pos"), "n_neg": F.sum("neg")})
    keep = (F.col("rn") == 1) | F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    pts = j.filter(keep).select(*by, F.try_divide(F.col("cum_neg"), F.col("n_neg")).alias("fpr"),
                                F.try_divide(F.col("cum_pos"), F.col("n_pos")).alias("tpr"), F.col("p").alias("threshold"))
    origin_src = sc.select(*by).distinct() if by else cum.sparkSession.range(1)
    origin = origin_src.select(*by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                               F.lit(None).cast("double").alias("threshold"))
    return origin.unionByName(pts)


def pr_points(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """H7: precision-recall points per distinct threshold plus the closing (precision 1, recall 0)."""
    by = list(by)
    sc = stored(score_counts(df, y, p, by), "scores")
    cum = cumulative_scores(sc, by=by, counted=True)
    j = _totals(cum, sc, by, {"n_pos": F.sum("pos")})
    pts = j.select(*by, (F.col("tps") / (F.col("tps") + F.col("fps"))).alias("precision"),
                   F.when(F.col("n_pos") == 0, 1.0).otherwise(F.col("tps") / F.col("n_pos")).alias("recall"),
                   F.col("p").alias("threshold"))
    close_src = sc.select(*by).distinct() if by else cum.sparkSession.range(1)
    close = close_src.select(*by, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
                             F.lit(None).cast("double").alias("threshold"))
    return pts.unionByName(close)
