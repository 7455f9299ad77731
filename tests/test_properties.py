"""Properties: distributed operators equal brute force / single-window versions."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlens.operators import decision as K
from churnlens.operators.metrics import calibration_curve, evaluate, pr_points, roc_points
from churnlens.operators.ordered import ordered_prefix
from churnlens.operators.stats import exact_quantiles
from churnlens.plans.inputs import s_scored, s_treated

from .conftest import SF01


@pytest.fixture(scope="module")
def scored(spark):
    return s_scored(spark, SF01).persist()


@pytest.fixture(scope="module")
def local(scored):
    pdf = scored.toPandas().sort_values("customerID").reset_index(drop=True)
    return pdf


def plain_window(df, order, sums=(), partition=()):
    """The same by one window per group."""
    cols = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in order]
    w = Window.partitionBy(*partition).orderBy(*cols)
    df = df.withColumn("rn", F.row_number().over(w).cast("long"))
    for s in sums:
        df = df.withColumn(f"cum_{s}", F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return df


@pytest.mark.parametrize("buckets", [1, 7, 130, 400])
@pytest.mark.parametrize("order", [[("num", True)], [("num", False)], [("txt", True)], [("txt", False), ("num", True)]])
def test_ordered_prefix_nulls_text_and_any_number_of_buckets(spark, buckets, order):
    rows = [(i, None if i % 7 == 0 else float((i * 37) % 50), None if i % 5 == 0 else "abcäéz"[i % 6] * (i % 3), ["x", "y", None][i % 3]) for i in range(600)]
    d = spark.createDataFrame(rows, "id long, num double, txt string, g string")
    for part in ([], ["g"]):
        a = plain_window(d, [*order, ("id", False)], ["id"], part)
        b = ordered_prefix(d, order, sums=["id"], partition=part, tiebreak="id", n_buckets=buckets)
        assert sorted(a.select("id", "rn", "cum_id").collect()) == sorted(b.select("id", "rn", "cum_id").collect())


def test_ordered_prefix_of_nothing(spark):
    d = spark.createDataFrame([], "id long, v double")
    assert ordered_prefix(d, [("v", True)], sums=["v"], tiebreak="id").collect() == []


def test_ordered_prefix_bucketed_equals_window(spark, scored):
    d = K.with_decision(scored)
    a = plain_window(d, [("p", True), ("customerID", False)], ["ve"])
    b = ordered_prefix(d, [("p", True)], sums=["ve"], tiebreak="customerID", n_buckets=7)
    j = a.select("customerID", "rn", F.col("cum_ve").alias("a")).join(
        b.select("customerID", F.col("rn").alias("rn_b"), F.col("cum_ve").alias("b")), "customerID")
    assert j.filter("rn <> rn_b").count() == 0
    assert j.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-6
    assert sorted(r[0] for r in b.select("rn").collect()) == list(range(1, d.count() + 1))


def test_ordered_prefix_partitioned_giant_tie(spark, scored):
    """One partition holding most rows, all tied on the key: split across buckets by id."""
    d = scored.withColumn("g", F.when(F.col("m2m") == 1, "hot").otherwise("cold")).withColumn("k", F.lit(1.0))
    a = plain_window(d, [("k", False), ("customerID", False)], ["mc"], ["g"])
    b = ordered_prefix(d, [("k", False)], sums=["mc"], partition=["g"], tiebreak="customerID", n_buckets=16)
    j = a.select("customerID", "rn", "cum_mc").join(
        b.select("customerID", F.col("rn").alias("rn2"), F.col("cum_mc").alias("c2")), "customerID")
    assert j.filter("rn <> rn2").count() == 0
    assert j.agg(F.max(F.abs(F.col("cum_mc") - F.col("c2")))).first()[0] < 1e-6


def test_same_results_2_and_200_partitions(spark, scored):
    out = []
    for n in (2, 200):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        c = K.queue_curves(scored, n_buckets=5)
        out.append(sorted((r["queue"], r["customerID"], r["contacted"], round(r["cum_profit"], 4)) for r in c.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out[0] == out[1]


def _auc_brute(y, p):
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def _ap_brute(y, p):
    order = np.argsort(-p, kind="mergesort")
    ys, ps = y[order], p[order]
    thr_idx = np.r_[np.where(np.diff(ps))[0], len(ps) - 1]
    tps = np.cumsum(ys)[thr_idx]
    fps = 1 + thr_idx - tps
    prec = tps / (tps + fps)
    rec = tps / tps[-1]
    return float(np.sum(np.diff(np.r_[0, rec]) * prec))


def test_metrics_equal_brute_force(scored, local):
    m = evaluate(scored).first()
    y, p = local["y"].to_numpy(), local["p"].to_numpy()
    assert abs(m["roc_auc"] - _auc_brute(y, p)) < 1e-12
    assert abs(m["pr_auc"] - _ap_brute(y, p)) < 1e-12
    assert abs(m["brier"] - np.mean((p - y) ** 2)) < 1e-12


def test_quantiles_equal_numpy(spark, scored, local):
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    for col in ["p", "mc"]:
        got = {r["q"]: r["value"] for r in exact_quantiles(scored, col, probs).collect()}
        want = np.percentile(local[col].to_numpy(), [q * 100 for q in probs])
        for q, w in zip(probs, want):
            assert abs(got[q] - w) < 1e-9


def test_calibration_equals_numpy(scored, local):
    y, p = local["y"].to_numpy(), local["p"].to_numpy()
    bins = np.percentile(p, np.linspace(0, 1, 11) * 100)
    ids = np.searchsorted(bins[1:-1], p)
    got = {r["bin"]: (r["predicted"], r["observed"]) for r in calibration_curve(scored).collect()}
    for b in np.unique(ids):
        assert abs(got[b][0] - p[ids == b].mean()) < 1e-12
        assert abs(got[b][1] - y[ids == b].mean()) < 1e-12
    assert set(got) == set(np.unique(ids).tolist())


def test_roc_points_equal_reference_algorithm(scored, local):
    y, p = local["y"].to_numpy(), local["p"].to_numpy()
    order = np.argsort(-p, kind="mergesort")
    ys, ps = y[order], p[order]
    idx = np.r_[np.where(np.diff(ps))[0], len(ps) - 1]
    tps = np.cumsum(ys)[idx]
    fps = 1 + idx - tps
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    want = sorted(zip(np.r_[0, fps[keep] / fps[-1]].round(9), np.r_[0, tps[keep] / tps[-1]].round(9)))
    got = sorted((round(r["fpr"], 9), round(r["tpr"], 9)) for r in roc_points(scored).collect())
    assert got == want
    pr = pr_points(scored).collect()
    assert len(pr) == len(idx) + 1


def test_optimum_equals_brute_force(scored, local):
    """The running profit of the VE queue peaks exactly at the last positive VE."""
    curves = K.queue_curves(scored)
    chk = K.optimum_check(curves).first()
    assert chk["argmax_contacted"] == chk["n_positive"] == K.optimal_campaign(scored).first()["n_contacted"]
    ve = 0.4 * local["mc"].to_numpy() * 12 * (local["p"].to_numpy() * 0.3 - 0.1) - 15.0
    best = max(np.cumsum(np.sort(ve)[::-1]))
    assert abs(curves.filter("queue = 'expected_value'").agg(F.max("cum_profit")).first()[0] - best) < 1e-6


def test_all_queues_end_equal(scored):
    ends = K.queue_curves(scored).groupBy("queue").agg(F.max_by("cum_profit", "contacted").alias("end")).collect()
    vals = [r["end"] for r in ends]
    assert len(vals) == 4 and max(vals) - min(vals) < 1e-6


def test_sensitivity_default_rows_equal_optimum(scored):
    o = K.optimal_campaign(scored).first()
    rows = K.sensitivity(scored).filter("is_default").collect()
    assert len(rows) == 5
    assert all(r["n_contacted"] == o["n_contacted"] and abs(r["profit"] - o["profit"]) < 1e-6 for r in rows)


def test_quartile_bins_equal_qcut(spark):
    import pandas as pd

    from churnlens.operators.explore import quartile_bins

    t = s_treated(spark, SF01).filter("InternetService = 'Fiber optic'").select("customerID", "MonthlyCharges")
    got = {r["customerID"]: r["bin"] for r in quartile_bins(t, "MonthlyCharges").collect()}
    pdf = t.toPandas()
    want = pd.qcut(pdf["MonthlyCharges"], 4, labels=[1, 2, 3, 4]).astype(int)
    assert all(got[i] == w for i, w in zip(pdf["customerID"], want))


def test_ordered_prefix_many_buckets(spark, scored):
    """More buckets than rows in most of them."""
    d = K.with_decision(scored).withColumn("g", F.col("m2m"))
    a = plain_window(d, [("ve", True), ("customerID", False)], ["mc"], ["g"])
    b = ordered_prefix(d, [("ve", True)], sums=["mc"], partition=["g"], tiebreak="customerID", n_buckets=400)
    j = a.select("customerID", "rn", "cum_mc").join(
        b.select("customerID", F.col("rn").alias("rn2"), F.col("cum_mc").alias("c2")), "customerID")
    assert j.filter("rn <> rn2").count() == 0
    assert j.agg(F.max(F.abs(F.col("cum_mc") - F.col("c2")))).first()[0] < 1e-6


def test_approx_quantiles_close_to_exact(scored):
    exact = {r["q"]: r["value"] for r in exact_quantiles(scored, "mc", [0.25, 0.5, 0.75]).collect()}
    approx = {r["q"]: r["value"] for r in exact_quantiles(scored, "mc", [0.25, 0.5, 0.75], approx=True).collect()}
    assert all(abs(exact[q] - approx[q]) < 0.5 for q in exact)


def test_custom_grid(scored):
    from churnlens.plans.jobs import parse_grid

    grid = parse_grid("discount=0.05,0.1;contact_cost=5,15")
    s = K.sensitivity(scored, grid=grid).collect()
    assert len(s) == 4 and sum(r["is_default"] for r in s) == 2
    with pytest.raises(ValueError):
        parse_grid("price=1")


def test_single_queue_curve_matches_four_queue_version(scored):
    """One queue's curve equals the same queue inside the stacked four-queue job."""
    from churnlens.operators.ranking import queue_curve

    d = K.with_decision(scored)
    one = {r["customerID"]: (r["contacted"], round(r["cum_profit"], 6)) for r in queue_curve(d, F.col("ve")).collect()}
    four = {r["customerID"]: (r["contacted"], round(r["cum_profit"], 6))
            for r in K.queue_curves(scored).filter("queue = 'expected_value'").collect()}
    assert one == four


def test_grouped_quantiles_equal_pandas(spark):
    t = s_treated(spark, SF01)
    got = {(r["Contract"], r["q"]): r["value"]
           for r in exact_quantiles(t, "MonthlyCharges", [0.25, 0.5, 0.75], by=["Contract"]).collect()}
    pdf = t.select("Contract", "MonthlyCharges").toPandas()
    for (c, q), v in got.items():
        assert abs(v - pdf[pdf.Contract == c].MonthlyCharges.quantile(q)) < 1e-9


def test_shares_and_histogram_totals(spark):
    from churnlens.operators.explore import histogram, value_shares

    t = s_treated(spark, SF01)
    sums = value_shares(t, ["Contract", "InternetService", "PaymentMethod"]).groupBy("column").agg(F.sum("share")).collect()
    assert all(abs(r[1] - 1.0) < 1e-12 for r in sums)
    h = histogram(t, "tenure", 30)
    assert h.agg(F.sum("n")).first()[0] == t.count() and h.count() <= 30
    dens = histogram(t, "MonthlyCharges", 30, by="Churn").withColumn("area", F.col("density") * (F.col("right") - F.col("left")))
    assert all(abs(r[1] - 1.0) < 1e-9 for r in dens.groupBy("Churn").agg(F.sum("area")).collect())


def test_sensitivity_is_monotone_in_discount_and_cost(scored):
    s = K.sensitivity(scored).collect()
    for param in ("discount", "contact_cost"):
        rows = sorted((r["value"], r["n_contacted"]) for r in s if r["parameter"] == param)
        ns = [n for _, n in rows]
        assert ns == sorted(ns, reverse=True)  # a dearer offer never widens the campaign
