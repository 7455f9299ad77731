import hashlib

import numpy as np
import pytest

from churnlens.llm import centroids as C
from churnlens.llm.centroids import Simplex, bounds, candidates, centroid_clusters, nearest, squares


def lloyd(rows, k, rounds, dim, salt="3:"):
    """Plain Python twin: exact integers, every vector against every centroid."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))
    means = [list(v) for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(means)) for _, v in kept]

    for _ in range(rounds):
        of = assign()
        for c in range(len(means)):
            mine = [v for (_, v), (_, n) in zip(kept, of, strict=True) if n == c]
            if mine:
                means[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    of = assign()
    per = [sum(d for d, n in of if n == c) for c in range(len(means))]
    return [(i, n, d, per[n], sum(per), hashlib.sha256(",".join(map(str, means[n])).encode()).hexdigest())
            for (i, _), (d, n) in zip(kept, of, strict=True)]


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distances string")


def test_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(60)]
    rows += [(i, rows[3][1]) for i in range(100, 130)]  # copies of one vector: a third of the rows
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (200, None), (201, []), (202, [1.0] * 5), (203, [1.0] * 7),
             (204, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (205, [float("nan")] * 6), (206, [float("inf")] + [0.0] * 5), (207, [-float("inf")] + [0.0] * 5),
             (208, [0.0] * 6), (209, [-0.0] * 6), (210, [1e4] * 6)]
    got = result(centroid_clusters(frame(spark, rows), k=8, rounds=10, dim=6))
    assert got == sorted(lloyd(rows, 8, 10, 6), key=repr)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = [(i, [float(i // 2), 1.0]) for i in range(n)]
    got = centroid_clusters(frame(spark, rows), k=8, rounds=3, dim=2)
    assert result(got) == sorted(lloyd(rows, 8, 3, 2), key=repr)


def test_equal_vectors_leave_centroids_empty(spark):
    rows = [(i, [0.5, -0.5]) for i in range(50)]
    assert result(centroid_clusters(frame(spark, rows), k=4, rounds=2, dim=2)) == sorted(lloyd(rows, 4, 2, 2), key=repr)


def test_components_beyond_64_bit_distances(spark):
    rows = [(i, [float(x)] * 2) for i, x in enumerate([1e6, -1e6, 3e13, 2.0, 5.0, -3e13])]
    got = {r.vec_id: r for r in centroid_clusters(frame(spark, rows), k=2, rounds=3, dim=2).collect()}
    want = {w[0]: w for w in lloyd([(i, np.array(v, np.float32).tolist()) for i, v in rows], 2, 3, 2)}
    for i, w in want.items():
        assert got[i].cluster == w[1] and got[i].distance == (w[2] if w[2] < 1 << 63 else None) and got[i].centroid_sha256 == w[5]


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    middles = rng.normal(scale=900, size=(12, 16))
    points = np.floor(middles[rng.integers(0, 12, 400)] + rng.normal(scale=60, size=(400, 16))).astype(np.int64)
    centroids = np.floor(middles).astype(np.int64)
    simplex = Simplex.over(points[:40], 8)
    assert len(simplex.pivots) == 8
    d = simplex.distances(points)
    apexes, others = simplex.apexes(d), simplex.apexes(simplex.distances(centroids))
    for c, apex in enumerate(others):
        low, high = bounds(apexes, apex)
        true = squares(points, centroids[c])
        assert (low <= true * (1 + 1e-9) + 1e-3).all() and (high >= true * (1 - 1e-9) - 1e-3).all()
    may = candidates(apexes, others, d[:, 0], simplex.distances(centroids)[:, 0])
    assert may.mean() < 0.3  # most centroids are ruled out
    every = np.column_stack([squares(points, c) for c in centroids])
    number, best = nearest(points, d, simplex, centroids, True)
    assert (number == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert (nearest(points, d, simplex, centroids)[0] == number).all()


def test_pivots_in_one_line_span_one_edge():
    pool = np.array([[0, 0, 0], [2, 0, 0], [4, 0, 0], [4, 0, 0]], np.int64)
    assert len(Simplex.over(pool, 8).pivots) == 2 and len(Simplex.over(pool[:1], 8).pivots) == 1


def test_exact_comparison_runs_only_where_bounds_leave_a_choice(monkeypatch):
    rng = np.random.default_rng(2)
    centroids = np.array([[-5000] * 8, [5000] * 8], np.int64)
    points = centroids[rng.integers(0, 2, 200)] + rng.integers(-50, 50, (200, 8))
    simplex = Simplex.over(points[:20], 4)
    d = simplex.distances(points)
    compared = []
    monkeypatch.setattr(C, "squares", lambda v, p: compared.append(len(v)) or squares(v, p))
    nearest(points, d, simplex, centroids)
    assert 200 not in compared  # the centroids' own distances to the pivots only
