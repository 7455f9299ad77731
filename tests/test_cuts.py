"""Exact selection against sorting, on every kind of key."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from churnlens.operators import cuts as C
from churnlens.operators.ranking import decile_ends, deciles, with_decile
from churnlens.operators.splits import stratified_split
from churnlens.operators.stats import exact_quantiles
from churnlens.plans.inputs import s_scored, s_treated

from .conftest import SF001


def exchanges(df) -> list[str]:
    """Exchanges of the rows' own plan (a scalar subquery's are its own)."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    return [line for line in plan.splitlines() if "Exchange" in line]


def keys_of(spark, kind):
    rng = random.Random(9)
    values = {
        "double": [None, float("nan"), float("inf"), -0.5, 0.0, *[round(rng.random(), 2) for _ in range(300)], *[0.25] * 200],
        "string": [None, "", "a", "aa", "é", "漢", *["".join(rng.choice("abc") for _ in range(3)) for _ in range(300)]],
        "int": [None, *[rng.randrange(-5, 5) for _ in range(300)]],
        "date": [None, *[dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(40)) for _ in range(200)]],
        "boolean": [None, *[rng.random() < 0.3 for _ in range(100)]],
    }[kind]
    rows = [(v, rng.choice(["x", "y", None]), i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"v {kind}, g string, id int").repartition(5)


@pytest.mark.parametrize("kind", ["double", "string", "int", "date", "boolean"])
@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("sizes", [(1024, 20_000), (7, 3)])
def test_keys_equal_spark_sort(spark, kind, desc, sizes):
    df = keys_of(spark, kind)
    order = [("v", desc), ("id", False)]
    cuts = C.Cuts(df, order, ["g"], sample=sizes[0], most=sizes[1])
    per = {}
    col = F.col("v").desc_nulls_last() if desc else F.col("v").asc_nulls_first()
    for r in df.orderBy(F.col("g").asc_nulls_first(), col, "id").collect():
        per.setdefault((r.g,), []).append((r.v, r.id))
    assert cuts.sizes == {g: len(v) for g, v in per.items()} and list(cuts.sizes) == list(per)
    ranks = {g: sorted({1, 2, len(v) // 3 + 1, len(v)}) for g, v in per.items()}
    assert {g: repr(k) for g, k in cuts.at(ranks).items()} == {g: repr([per[g][r - 1] for r in rs]) for g, rs in ranks.items()}


def test_ties_without_a_tiebreak_are_never_taken_apart(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 50_000.0).alias("x"))
    cuts = C.Cuts(df, [("x", False)], sample=64, most=10)
    want = [r.x for r in df.orderBy("x").collect()]
    assert [k[0] for k in cuts.at({(): [1, 25_000, 30_000, 50_000]})[()]] == [want[0], want[24_999], want[29_999], want[-1]]


def test_classes_by_comparison(spark):
    sc = s_scored(spark, SF001)
    cut, ranked = with_decile(sc), deciles(sc)
    assert cut.select("customerID", "decile").exceptAll(ranked.select("customerID", "decile")).isEmpty()
    assert exchanges(cut) == []
    for n in (1, 2, 9, 10, 11, 95, 1409):
        rows = spark.range(n).select(F.col("id").cast("string").alias("customerID"), F.rand(3).alias("p"))
        got = [r["count"] for r in with_decile(rows).groupBy("decile").count().orderBy("decile").collect()]
        assert got == [r["count"] for r in deciles(rows).groupBy("decile").count().orderBy("decile").collect()]
        assert all(1 <= e <= n for e in decile_ends(n))


def test_split_moves_no_row(spark):
    sp = stratified_split(s_treated(spark, SF001))
    assert exchanges(sp) == [] and sp.where("split = 'test'").count() > 0


def test_quantiles_with_more_groups_than_the_driver_holds(spark, monkeypatch):
    df = spark.range(600).selectExpr("id % 50 as g", "cast(hash(id) % 100 as double) as x")
    few = {(r.g, r.q): r.value for r in exact_quantiles(df, "x", [0.25, 0.5], ["g"]).collect()}
    monkeypatch.setattr(C, "GROUPS", 0)
    monkeypatch.setattr(C, "SAMPLE", 4)
    monkeypatch.setattr(C.Cuts.__init__, "__defaults__", ((), 11, 4, 10))
    with pytest.raises(C.TooManyGroups):
        C.Cuts(df, [("x", False)], ["g"])
    many = {(r.g, r.q): r.value for r in exact_quantiles(df, "x", [0.25, 0.5], ["g"]).collect()}
    assert many == few and len(few) == 100


def test_empty_table(spark):
    df = spark.range(0).selectExpr("cast(id as double) as x", "'a' as g")
    cuts = C.Cuts(df, [("x", False)], ["g"])
    assert cuts.sizes == {} and cuts.at({}) == {}
    assert exact_quantiles(df, "x", [0.5], ["g"]).count() == 0
    with pytest.raises(ValueError):
        cuts.at({("a",): [1]})


def searches(df) -> int:
    """How often the rows' own plan looks for a row's interval."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("bucketizer_") + plan.count("aggregate([")


@pytest.mark.parametrize("order", [[("x", False), ("id", False)], [("id", True), ("x", False)]])
def test_an_interval_is_looked_for_once_a_row(spark, order):
    """in the pass over open intervals the search was done five times a row, interpreted."""
    df = spark.range(40_000).selectExpr("cast(id as string) as id", "id % 3 as g", "rand(1) as x")
    seen = []
    within = C.Cuts._within
    cuts = C.Cuts(df, order, ["g"], sample=64, most=100)
    try:
        C.Cuts._within = staticmethod(lambda *a: seen.append(within(*a)) or seen[-1])
        got = cuts.at({(g,): [1000, 5000] for g in range(3)})
    finally:
        C.Cuts._within = staticmethod(within)
    assert searches(cuts.first.placed) == 1 and searches(seen[0]) == 2  # the place in the filter, and the place itself
    per = {(g,): sorted((tuple(r[c] for c, _ in order) for r in df.where(F.col("g") == g).collect()), reverse=order[0][1]) for g in range(3)}
    assert got == {g: [ks[999], ks[4999]] for g, ks in per.items()}


def test_edges_of_numbers(spark):
    """Bins of the first column: ties, the greatest doubles, infinities, zeros, whole numbers, ties broken by a text."""
    big = 1.7976931348623157e308
    values = [None, float("nan"), float("inf"), -float("inf"), big, -big, 0.0, -0.0, 5e-324, 1.0, 1.0000000000000002]
    rows = [(v, i % 2, f"k{i * k % 97:03d}-{i}") for i in range(60) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "v double, g int, id string").repartition(4)
    for c, desc in (("v", False), ("v", True), ("g", True)):
        order = [(c, desc), ("id", False)]
        want = [(r[c], r.id) for r in df.orderBy(F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_first(), "id").collect()]
        for sizes in ((1024, 20_000), (5, 4)):
            ranks = [1, 60, 61, 333, len(rows)]
            got = C.Cuts(df, order, sample=sizes[0], most=sizes[1]).at({(): ranks})[()]
            assert [repr((k[0] + 0.0 if k[0] is not None else None, k[1])) for k in got] == [
                repr((want[r - 1][0] + 0.0 if want[r - 1][0] is not None else None, want[r - 1][1])) for r in ranks]


def counting(spark, rows, schema):
    """A table that counts how often its rows are worked out."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return spark.createDataFrame(rows, schema).repartition(3).mapInArrow(run, schema), seen


def test_queues_are_worked_out_once(spark):
    """F1: every pass of the selection read the scored table anew."""
    from churnlens.operators.decision import profit_at_budget, queue_curves, queue_profits

    rng = random.Random(4)
    rows = [(f"{i:05d}", round(rng.random(), 3), 20 + 100 * rng.random(), rng.randrange(2)) for i in range(1500)]
    df, seen = counting(spark, rows, "customerID string, p double, mc double, m2m int")
    got = {r.queue: r.profit_at_n for r in queue_profits(df, 400).collect()}
    assert seen.value == 1500
    assert got == pytest.approx({r.queue: r.profit_at_n for r in profit_at_budget(queue_curves(df), 400).collect()})


def test_columns_are_worked_out_once(spark):
    """every pass of the quantiles, and the fences, read the source anew."""
    from churnlens.operators.distributions import box_table
    from churnlens.operators.explore import describe, medians_by_class

    rng = random.Random(5)
    rows = [(rng.randrange(2), rng.randrange(70), None if i % 50 == 0 else round(100 * rng.random(), 2)) for i in range(1200)]
    schema, cols = "Churn int, tenure int, mc double", ["tenure", "mc"]
    for run in (lambda d: medians_by_class(d, cols), lambda d: box_table(d, cols, "Churn"), lambda d: describe(d, cols)):
        df, seen = counting(spark, rows, schema)
        assert run(df).count() in (2, 4)
        assert seen.value == 1200
    df, _ = counting(spark, rows, schema)
    got = {(r["column"], r.Churn): (r.q1, r.median, r.q3) for r in box_table(df, cols, "Churn").collect()}
    for i, c in enumerate(cols, 1):
        for y in (0, 1):
            xs = [float(r[i]) for r in rows if r[0] == y and r[i] is not None]
            assert got[c, y] == pytest.approx(tuple(statistics.quantiles(xs, n=4, method="inclusive")))


def test_scores_are_ordered_without_a_search(spark):
    """the order of distinct scores looked for a row's bucket in an interpreted search."""
    from churnlens.operators.metrics import cumulative_scores, evaluate

    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randrange(2), p) for p in [None, float("nan"), float("inf"), 0.0, -0.0, 1.0, *[round(rng.random(), 2) for _ in range(900)]]]
    df = spark.createDataFrame(rows, "g string, y int, p double").repartition(3)
    cum = cumulative_scores(df, by=["g"])
    assert searches(cum) > 0 and "aggregate([" not in cum._jdf.queryExecution().optimizedPlan().toString()
    for g in "ab":
        own = [(p, y) for h, y, p in rows if h == g]
        key = lambda p: (p is None, p == p, -(p or 0.0) if p == p else 0.0)  # noqa: E731 - null last, NaN greatest
        order = sorted({key(p) for p, _ in own})
        want = [(sum(y for p, y in own if key(p) <= k), sum(1 - y for p, y in own if key(p) <= k)) for k in order]
        assert [(r.tps, r.fps) for r in cum.where(F.col("g") == g).orderBy("rn").collect()] == want
    good = [r for r in rows if r[2] is not None and r[2] == r[2] and r[2] <= 1]
    for r in evaluate(spark.createDataFrame(good, df.schema), by=["g"]).collect():
        pos, neg = ([p for g, y, p in good if g == r.g and y == k] for k in (1, 0))
        assert r.roc_auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))


@pytest.mark.parametrize("name", ["_x", "_X", "_bin"])
def test_columns_named_as_the_binning_names_its_own(spark, name):
    """the binning wrote over a column of the name of its own and dropped it, so that a pass over open
    intervals found no column."""
    rng = random.Random(7)
    xs = [rng.random() for _ in range(6000)]
    df = spark.createDataFrame([(x,) for x in xs], f"{name} double").repartition(3)
    got = sorted((r.q, r.value) for r in exact_quantiles(df, name, [0.1, 0.5, 0.9]).collect())
    deciles_of = statistics.quantiles(xs, n=10, method="inclusive")
    assert got == [(q, pytest.approx(deciles_of[i], abs=1e-15)) for i, q in ((0, 0.1), (4, 0.5), (8, 0.9))]
    assert C.Cuts(df, [(name, True)], sample=16, most=50).at({(): [1, 3000, 6000]})[()] == [(sorted(xs)[-r],) for r in (1, 3000, 6000)]


def test_calibration_of_more_scores_than_the_sample(spark):
    """F1: with more distinct scores than the selection's sample has rows, the edges lie inside its intervals."""
    from churnlens.operators.charts import calibration_series
    from churnlens.operators.metrics import calibration_curve

    rng = random.Random(8)
    rows = [(m, int(rng.random() < p), p) for m in ("a", "b") for p in [rng.random() ** 2 for _ in range(5000)]]
    df = spark.createDataFrame(rows, "model string, y int, p double").repartition(3)

    def points(own):
        edges = statistics.quantiles([p for _, p in own], n=10, method="inclusive")
        for b in range(10):
            held = [(y, p) for y, p in own if sum(e < p for e in edges) == b]
            yield b, pytest.approx(statistics.fmean(p for _, p in held)), pytest.approx(statistics.fmean(y for y, _ in held)), len(held)

    got = sorted(tuple(r) for r in calibration_series(df).select("model", "bin", "predicted", "observed", "n", "brier").collect())
    want = []
    for m in ("a", "b"):
        own = [(y, p) for g, y, p in rows if g == m]
        brier = pytest.approx(statistics.fmean((p - y) ** 2 for y, p in own))
        want += [(m, *point, brier) for point in points(own)]
    assert got == want
    got = sorted(tuple(r) for r in calibration_curve(df).select("bin", "predicted", "observed", "n").collect())
    assert got == list(points([r[1:] for r in rows]))
