"""Newton logistic, exact stumps, pooled isotonic and resumable cross-validation against brute force."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from churnlens.models import evaluation as EV
from churnlens.models import isotonic as I
from churnlens.models.catalog import ChurnModel, catalogue
from churnlens.models.learners import AdaBoost, ContractRule, Logistic
from churnlens.models.stumps import Stump, StumpSearch, between, stump_of, votes
from churnlens.operators.ordered import stored
from churnlens.plans.inputs import s_treated

from .conftest import SF001


@pytest.fixture(scope="module")
def points(spark):
    """300 rows, 3 features: continuous, a few values, binary; labels follow them with noise."""
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=300), rng.integers(0, 5, 300), rng.integers(0, 2, 300)]).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.5, -0.4, 0.8])))).astype(int)
    rows = [(i, Vectors.dense(v), int(t), i % 3) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, ["customerID", "features", "Churn", "fold"])
    return df.repartition(4).persist(), x, y


def newton(x, y, u):
    z, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(z @ w)))
        w -= np.linalg.solve((z * (u * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (u * (p - y)) + ridge @ w)
    return w


@pytest.mark.parametrize("balanced", [False, True])
def test_all_folds_at_once_equal_single_fits(points, balanced):
    df, x, y = points
    fold = np.arange(len(x)) % 3
    fitted = Logistic(balanced).fit_many(df, [F.col("fold") != k for k in range(3)])
    for k, f in enumerate(fitted):
        u = (fold != k).astype(float)
        if balanced:
            n1, n = (u * y).sum(), u.sum()
            u *= np.where(y == 1, n / (2 * n1), n / (2 * (n - n1)))
        assert np.allclose([f.intercept, *f.coefficients], newton(x, y, u), atol=1e-8)
    p = {r.customerID: r.p for r in fitted[0].predict(df).collect()}
    want = 1 / (1 + np.exp(-(x @ fitted[0].coefficients + fitted[0].intercept)))
    assert all(abs(p[i] - want[i]) < 1e-12 for i in p)


def test_far_apart_classes_converge(spark):
    """Separable classes and a huge scale: the full Newton step goes too far and is halved."""
    rows = [(i, Vectors.dense([1e4 * (i - 50), 1.0]), int(i > 50), 0) for i in range(100)]
    df = spark.createDataFrame(rows, ["customerID", "features", "Churn", "fold"])
    f = Logistic().fit(df)
    x, y = np.array([r[1].toArray() for r in rows]), np.array([r[2] for r in rows])
    p = 1 / (1 + np.exp(-np.clip(x @ f.coefficients + f.intercept, -700, 700)))
    assert np.abs(np.array(f.coefficients) + x.T @ (p - y)).max() < 1e-3 and abs((p - y).sum()) < 1e-6
    with pytest.raises(ValueError):
        Logistic().fit(df.limit(0))


def brute_stump(x, y, w):
    one, total, best = (w * (y == 1)).sum(), w.sum(), (np.inf, -1, None)

    def g(a, n):
        return 2 * a * (n - a) / n if n else 0.0

    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:], strict=False):
            left = x[:, f] <= a
            s = g((w * left * (y == 1)).sum(), (w * left).sum()) + g(one - (w * left * (y == 1)).sum(), total - (w * left).sum())
            if s < best[0] * (1 - 1e-12):
                best = (s, f, between(a, b))
    return best


@pytest.mark.parametrize("sizes", [(1024, 50_000), (8, 50_000), (8, 20)])
def test_best_stump_is_over_all_split_points(spark, sizes):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=2000), rng.integers(0, 700, 2000), rng.integers(0, 2, 2000), np.full(2000, 4.0)]).astype(float)
    y = ((x[:, 0] > 0.731) ^ (rng.random(2000) < 0.2)).astype(float)
    table = spark.createDataFrame([(v.tolist(), float(t), float(w)) for v, t, w in zip(x, y, rng.random(2000), strict=True)], "x array<double>, y double, w0 double")
    table = stored(table.repartition(5), "test")
    search = StumpSearch(table, *sizes)
    w0 = np.array([r.w0 for r in table.collect()])
    xs, ys = (np.array([r[c] for r in table.select("x", "y", "w0").collect()]) for c in ("x", "y"))
    assert len(np.unique(x[:, 0])) > 256
    for weight, w in ((F.col("w0"), w0), (F.exp(F.col("w0") * 3), np.exp(w0 * 3)), (F.lit(1.0), np.ones(2000))):
        split, (one, zero) = search.best(table.withColumn("w", weight))
        want = brute_stump(xs, ys, w)
        assert split.feature == want[1] and abs(split.threshold - want[2]) < 1e-9 and abs(split.impurity - want[0]) < 1e-6 * want[0]
        stump, wrong = stump_of(split, (one, zero), 1.0)
        predicted = np.where(xs[:, split.feature] <= split.threshold, stump.left, stump.right)
        assert abs(wrong - (w * (predicted != ys)).sum()) < 1e-6 * w.sum()


def test_one_class_and_constant_features_make_a_leaf(spark):
    table = stored(spark.createDataFrame([([1.0], 1.0)] * 5, "x array<double>, y double"), "test")
    split, total = StumpSearch(table).best(table.withColumn("w", F.lit(1.0)))
    assert stump_of(split, total, 1.0) == (Stump(1.0, 1.0, 1.0), 0.0)


def test_merged_votes_equal_the_sum_and_stay_small(spark):
    rng = random.Random(5)
    stumps = [Stump(rng.random(), float(rng.random() < 0.5), float(rng.random() < 0.5), rng.randrange(2), rng.choice([0.1, 0.2, 0.5, rng.random()])) for _ in range(300)]
    stumps += [Stump(0.3, 1.0, 1.0), Stump(0.2, 1.0, 0.0, 1, None, (0.25, 0.5))]
    df = spark.createDataFrame([([rng.random(), v],) for v in [0.0, 0.1, 0.2, 0.25, 0.5, 0.9, 1.0] * 20], "x array<double>")

    def vote(x):
        def side(s):
            if s.feature < 0:
                return s.left
            here = x[s.feature] <= s.threshold if s.threshold is not None else x[s.feature] in s.values
            return s.left if here else s.right

        return sum(s.alpha * (2 * side(s) - 1) for s in stumps)

    assert all(abs(r.v - vote(r.x)) < 1e-9 for r in df.select("x", votes(stumps).alias("v")).collect())

    def nodes(n):
        plan = df.select(votes(stumps[:n]).alias("v"))._jdf.queryExecution().optimizedPlan()
        return plan.treeString().count("lambda")

    assert nodes(30) == nodes(300)


def test_adaboost_learns_and_repeats(points):
    df, x, y = points
    a, b = AdaBoost(rounds=12).fit(df), AdaBoost(rounds=12, flush=5).fit(df)
    assert len(a.stumps) == 12 and [(s.feature, s.left, s.right) for s in a.stumps] == [(s.feature, s.left, s.right) for s in b.stumps]
    p = {r.customerID: r.p for r in a.predict(df).collect()}
    assert np.mean([(p[i] > 0.5) == y[i] for i in p]) > 0.7


def pav(pairs):
    """(x, y) -> fitted value by x, by plain pooling."""
    groups = {}
    for x, y in pairs:
        groups.setdefault(x, []).append(y)
    out = []
    for x in sorted(groups):
        out.append([[x], float(sum(groups[x])), len(groups[x])])
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            xs, t, n = out.pop()
            out[-1][0] += xs
            out[-1][1] += t
            out[-1][2] += n
    return {x: t / n for xs, t, n in out for x in xs}


@pytest.mark.parametrize("buckets", [1, 5, 40])
def test_isotonic_equals_brute_force(spark, buckets, monkeypatch):
    monkeypatch.setattr(I, "FAN", 3)
    rng = random.Random(8)
    rows = []
    for g, shape in (("up", lambda v: v), ("down", lambda v: 1 - v), (None, lambda v: abs(v - 0.5))):
        for _ in range(400):
            v = rng.random()
            rows.append((g, v, float(rng.random() < shape(v))))
        rows += [(g, 0.5, float(i % 2)) for i in range(200)]  # a third of the points in one place
    rows += [("up", None, 1.0), ("up", float("nan"), 1.0), ("up", 0.1, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    blocks = I.isotonic_blocks(df, "x", "y", ["g"], buckets=buckets).collect()
    for g in ("up", "down", None):
        own = sorted((b.low, b.high, b.mean) for b in blocks if b.g == g)
        want = pav([(x, y) for h, x, y in rows if h == g and x is not None and x == x and y is not None])
        assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(own, own[1:], strict=False))
        assert all(any(lo <= x <= hi and abs(m - v) < 1e-9 for lo, hi, m in own) for x, v in want.items())
        assert {x for lo, hi, _ in own for x in (lo, hi)} <= set(want)


def test_folds_of_a_logistic_share_passes_and_equal_single_fits(spark):
    train = s_treated(spark, SF001).drop("p_score").persist()

    # a learner of another class, so its fits run fold by fold
    models = {"logistic": catalogue()["logistic"], "single": ChurnModel("single", type("One", (), {"fit": Logistic().fit})())}
    rows = {(r["model"], r["repeat"], r["fold"]): r for r in EV.cross_validate(train, models, n_splits=3, n_repeats=2).collect()}
    assert len(rows) == 12
    for (name, r, k), a in rows.items():
        b = rows["single", r, k]
        assert all(abs(a[m] - b[m]) < 1e-6 for m in ("roc_auc", "pr_auc", "brier")) and a["seconds"] > 0


class Breaks(ContractRule):
    """Fails at the n-th fit."""

    left = 0

    def fit(self, df, label="Churn", tag="rule"):
        Breaks.left -= 1
        if Breaks.left == 0:
            raise RuntimeError("broken")
        return ContractRule.fit(self, df, label, tag)


def test_a_broken_run_goes_on(spark, tmp_path):
    train = s_treated(spark, SF001).drop("p_score").persist()
    models = {"logistic": catalogue()["logistic"], "rule": ChurnModel("rule", Breaks(), prepared=False)}
    run = f"{tmp_path}/{EV.run_id(train, seed=1)}"
    assert EV.run_id(train, seed=1) == EV.run_id(train.repartition(3), seed=1) != EV.run_id(train, seed=2)
    Breaks.left = 4
    with pytest.raises(RuntimeError, match="broken"):
        EV.cross_validate(train, models, 3, 2, parallelism=1, run=run)
    done = EV.Ledger(spark, f"{run}/fits").done
    ready = sum(name == "rule" for name, _, _ in done)  # fits under way when one breaks may still end
    assert sum(name == "logistic" for name, _, _ in done) == 6 and 3 <= ready <= 5
    Breaks.left = 100
    again = EV.cross_validate(train, models, 3, 2, parallelism=1, run=run).collect()
    assert Breaks.left == 100 - (6 - ready)  # those that were missing
    whole = {(r["model"], r["repeat"], r["fold"]): r["roc_auc"] for r in EV.cross_validate(train, models, 3, 2, parallelism=1).collect()}
    assert {(r["model"], r["repeat"], r["fold"]): r["roc_auc"] for r in again} == whole
    assert {(r["model"], r["repeat"], r["fold"]): r["seconds"] for r in again if (r["model"], r["repeat"], r["fold"]) in done} == done
