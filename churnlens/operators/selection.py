"""Cross-validation tables and model choice.

Everything here works on a small ``fold_scores`` table (model, repeat, fold,
roc_auc, pr_auc, brier[, seconds]) — at most models × folds rows — produced by
ONE grouped metrics job over the union of all validation predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.operators.metrics import evaluate, evaluate_counts, score_counts
from churnlens.operators.ordered import stored
from churnlens.operators.splits import stratified_folds

METRICS = ["roc_auc", "pr_auc", "brier"]


def fold_metrics(val: DataFrame, by: tuple[str, ...] = ("model", "repeat", "fold")) -> DataFrame:
    """Metrics of every (model, repeat, fold) validation set in one job."""
    return evaluate(val, "y", "p", by=list(by)).select(*by, *METRICS)


def rule_and_scorecard_fold_scores(treated: DataFrame, y: str = S.TARGET, scorers: dict | None = None,
                                   n_splits: int = 5, n_repeats: int = 3, seed: int = 42) -> DataFrame:
    """Fold scores of the two scorers that need no iterative fit: the fixed scorecard and the
    contract rule (J5) re-fitted on each training fold. The rule's fit is a per
    (repeat, fold, flag) aggregate (≤ repeats × folds × 2 rows), so training-fold rates come
    from totals minus the held-out part. ``scorers``: further models as row-local score columns of
    ``treated``; their table also has a cost column, ``seconds``. Scores come along when the folds are
    dealt, so fold and row are never joined, and the dealt rows are written once."""
    scores = {"scorecard": F.col("p_score"), **(scorers or {})}
    names = {f"_p{i}": name for i, name in enumerate(scores)}
    t = treated.select(S.ID, F.col(y).alias("y"), (F.col("Contract") == S.MONTH_TO_MONTH).alias("flag"),
                       *[scores[name].alias(c) for c, name in names.items()])
    j = stored(stratified_folds(t, "y", n_splits, n_repeats, seed, keep=["flag", *names]).drop(S.ID), "folds")
    part = j.groupBy("repeat", "fold", "flag").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("c"))
    tot = part.groupBy("repeat", "flag").agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    rates = part.join(tot, ["repeat", "flag"]).select(
        "repeat", "fold", "flag",
        ((F.col("ts") - F.col("s")).cast("double") / (F.col("tc") - F.col("c")).cast("double")).alias("rate"))
    # every validation set collapsed to (model, repeat, fold, p) -> (pos, neg), written once: all metrics
    # are computed from that small table
    each = F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).alias("p")) for c, name in {**names, "rate": "contract_rule"}.items()])
    val = j.join(F.broadcast(rates), ["repeat", "fold", "flag"]).select("repeat", "fold", "y", F.inline(each))
    by = ["model", "repeat", "fold"]
    counts = stored(score_counts(val, by=by), "scores")
    found = evaluate_counts(counts, by).select(*by, *METRICS)
    if not scorers:
        return found
    # no fit is timed here: a model's cost is how many distinct scores it gives
    return found.join(counts.groupBy(*by).agg((F.count(F.lit(1)) / 1000).alias("seconds")), by)


def cv_summary(fold_scores: DataFrame) -> DataFrame:
    """mean and population std (ddof 0) per metric and model, number of fits."""
    aggs = []
    for m in METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return fold_scores.groupBy("model").agg(*aggs, F.count(F.lit(1)).alias("n_fits"))


def paired_comparison(fold_scores: DataFrame, reference: str, metric: str = "pr_auc") -> DataFrame:
    """Per-fold difference against ``reference`` on the same (repeat, fold):
    mean, population std, folds won; plus mean seconds per fit when present."""
    # E8 as a window over (repeat, fold) rather than a self-join: the fold table is evaluated
    # ONCE, so the reference's own difference is exactly 0 (a self-join would evaluate the
    # float sums twice, and distributed sums may differ in the last bit between evaluations)
    w = Window.partitionBy("repeat", "fold")
    ref = F.max(F.when(F.col("model") == reference, F.col(metric))).over(w)
    d = fold_scores.withColumn("_d", F.col(metric) - ref)
    aggs = [F.avg(metric).alias(f"{metric}_mean"), F.avg("_d").alias("diff_mean"),
            F.stddev_pop("_d").alias("diff_std"), F.count_if(F.col("_d") > 0).alias("folds_won"),
            F.count(F.lit(1)).alias("n_folds")]
    if "seconds" in fold_scores.columns:
        aggs.append(F.avg("seconds").alias("seconds_per_fit"))
    return d.groupBy("model").agg(*aggs)


def champion(paired: DataFrame, cv: DataFrame | None = None) -> DataFrame:
    """I6 / E2 (reference tie rule): leader = max_by PR-AUC mean (G7), looked up by name; a model ties with the leader
    when |diff_mean_m − diff_mean_leader| < diff_std_m, where the differences are the paired
    ones against the reference model; leader + ties (E10) → cheapest by seconds per fit (min_by).
    Returns one row (leader, tied, champion)."""
    cv = cv if cv is not None else paired
    leader = cv.agg(F.max_by("model", "pr_auc_mean")).scalar()
    lead_diff = paired.filter(F.col("model") == leader).agg(F.first("diff_mean")).scalar()
    tied = paired.filter((F.col("model") != leader) & (F.abs(F.col("diff_mean") - lead_diff) < F.col("diff_std")))
    return _choose(paired, leader, tied)


def champion_vs_leader(fold_scores: DataFrame) -> DataFrame:
    """I6 (``vs_leader`` rule): ties judged on per-fold differences against the leader itself:
    |mean diff| < population std of the diffs."""
    cv = cv_summary(fold_scores)
    leader_name = cv.orderBy(F.desc("pr_auc_mean"), "model").first()["model"]
    paired = paired_comparison(fold_scores, reference=leader_name)
    tied = paired.filter((F.col("model") != leader_name) & (F.abs(F.col("diff_mean")) < F.col("diff_std")))
    return _choose(paired, F.lit(leader_name), tied)


def _choose(paired: DataFrame, leader, tied: DataFrame) -> DataFrame:
    cands = paired.filter(F.col("model") == leader).select("model", "seconds_per_fit").unionByName(
        tied.select("model", "seconds_per_fit"))  # E10: UNION ALL of leader and ties
    tied_list = tied.agg(F.array_sort(F.collect_list("model"))).scalar()
    best = cands.agg(F.min_by("model", "seconds_per_fit")).scalar()
    return paired.sparkSession.range(1).select(leader.alias("leader"), tied_list.alias("tied"),
                                               best.alias("champion"))


def ablation_table(cv_with: DataFrame, cv_without: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """Without against with a feature, per model: means, difference (without - with), and that
    difference in fold deviations of the "with" run (null where that is 0)."""
    a = cv_with.select("model", F.col(f"{metric}_mean").alias("with_mean"), F.col(f"{metric}_std").alias("with_std"))
    b = cv_without.select("model", F.col(f"{metric}_mean").alias("without_mean"))
    change = F.col("without_mean") - F.col("with_mean")
    return a.join(b, "model").select("model", "with_mean", "without_mean", change.alias("difference"), "with_std",
                                     F.try_divide(change, F.col("with_std")).alias("in_deviations"))


def ablation_dumbbell(cv_with: DataFrame, cv_without: DataFrame) -> DataFrame:
    """(model, metric, with, without) of ROC-AUC and PR-AUC, without the baseline."""
    def points(cv: DataFrame, name: str) -> DataFrame:
        return cv.select("model", F.col("roc_auc_mean").alias("roc_auc"), F.col("pr_auc_mean").alias("pr_auc")).unpivot(
            ["model"], ["roc_auc", "pr_auc"], "metric", name)

    both = points(cv_with, "with_total").join(points(cv_without, "without_total"), ["model", "metric"])
    return drop_baseline(both)


def drop_baseline(df: DataFrame, baseline: str = "contract_rule", column: str = "model") -> DataFrame:
    """Drop the baseline rows from a result table."""
    return df.filter(F.col(column) != baseline)
