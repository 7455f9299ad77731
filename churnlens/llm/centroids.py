"""Centroid clustering (Lloyd's rounds over integer vectors) filtered by n-simplex projection.

Vectors become integers, so every sum, mean and distance below is exact and does not depend on how Spark
deals the rows. What would cost is comparing each vector with each centroid in all dimensions, each round:

1. A few pivots are chosen, and each vector's squared distances to them are computed once and cached in
   the table that every round reads.
2. n points span a simplex. A further point's distances to them place it as the apex over that base: its
   coordinates inside the base, found by solving a small triangular system, and its altitude above it.
   Of two apexes the Euclidean distance is a lower bound of the points' true distance, and the distance
   with one altitude turned over is an upper bound (the points may stand on either side of the base).
3. A centroid whose lower bound is over the least upper bound of a vector can't be its nearest. Those left
   are compared by exact integer distance. If one is left, a round needs no distance at all.

The bounds are float, so the filter leaves a margin far over their rounding error (pivots that nearly
lie in the span of those before are not used); only the exact comparison decides, and ties go to the
smaller number.

A round is one pass over the cached table: tasks add up their vectors per centroid in numpy, Spark adds the
tasks' sums per (centroid, component), and the driver holds ``k * dim`` sums, never a vector. Nothing grows
with the rows but the cached table, the last pass's result (written once, since its sums are read before
its rows) and the tasks' own sums.

Defined results: a vector with another number of components, a null, NaN or infinite one, or null itself
is not kept and not in the result; null ids are kept, their hash coming last; repeated ids and rows are
vectors of their own (starts that tie in hash are taken by their components); with fewer than ``k``
vectors there are as many centroids, some empty if vectors repeat; no vectors give no rows. Components
whose scaled value is beyond 64 bits saturate like Spark's own cast; where a squared distance could leave
64 bits exact Python integers are used, and a distance or inertia that does leave them is null. Only the
two named columns are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import written

PIVOTS = 8
PIVOT_POOL = 64  # vectors of least hash among which the pivots are chosen
MARGIN = 1e-6  # of the squared distances' size: rounding is about 1e-12 of it
INDEPENDENT = 1e-3  # a pivot's squared altitude over the base so far, against its squared distance to the first
SAFE = 1 << 26  # components up to this: (2 * SAFE) ** 2 * dim stays in 64 bits for up to 512 components
LONGEST = (1 << 63) - 1


def squares(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to one point: 64-bit, or Python integers where these don't fit."""
    if vectors.size and (vectors.shape[1] > 512 or max(abs(int(vectors.max())), abs(int(vectors.min())), int(np.abs(point.astype(object)).max())) > SAFE):
        d = vectors.astype(object) - point.astype(object)
        return (d * d).sum(axis=1)
    d = vectors.astype(np.int64) - point.astype(np.int64)
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Simplex:
    """Pivots in general position, and the base they span: the first is the origin."""

    pivots: np.ndarray  # int64 [n, dim]
    base: np.ndarray  # lower triangular [n - 1, n - 1]: pivot i + 1 in coordinates of the base
    edges: np.ndarray  # squared distances of the other pivots to the first

    @classmethod
    def over(cls, pool: np.ndarray, most: int) -> Simplex:
        """Chosen from the pool one by one, each time the one that stands highest over the base so far."""
        chosen, rows = [0], []
        origin = pool[0]
        d0 = squares(pool, origin).astype(float)
        coordinates = np.zeros((len(pool), 0))
        while len(chosen) < most:
            height = d0 - (coordinates * coordinates).sum(axis=1)
            height[d0 * INDEPENDENT >= height] = 0
            top = int(height.argmax())
            if height[top] <= 0:
                break
            dots = (d0 + d0[top] - squares(pool, pool[top]).astype(float)) / 2
            new = (dots - coordinates @ coordinates[top]) / np.sqrt(height[top])
            rows.append(np.append(coordinates[top], np.sqrt(height[top])))
            coordinates = np.column_stack([coordinates, new])
            chosen.append(top)
        n = len(rows)
        base = np.zeros((n, n))
        for i, r in enumerate(rows):
            base[i, :i + 1] = r
        return cls(pool[chosen], base, d0[chosen[1:]])

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots, exact until they are turned into floats."""
        return np.column_stack([squares(vectors, p).astype(float) for p in self.pivots])

    def apexes(self, distances: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots -> coordinates in the base, then the altitude over it."""
        d0 = distances[:, :1]
        at = np.zeros((len(distances), len(self.base)))
        for i in range(len(self.base)):  # forward substitution
            dots = (d0[:, 0] + self.edges[i] - distances[:, i + 1]) / 2
            at[:, i] = (dots - at[:, :i] @ self.base[i, :i]) / self.base[i, i]
        return np.column_stack([at, np.sqrt(np.maximum(d0[:, 0] - (at * at).sum(axis=1), 0))])


def bounds(apexes: np.ndarray, apex: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances between points, from their apexes."""
    inside = apexes[:, :-1] - apex[:-1]
    flat = (inside * inside).sum(axis=1)
    return flat + (apexes[:, -1] - apex[-1]) ** 2, flat + (apexes[:, -1] + apex[-1]) ** 2


def candidates(apexes: np.ndarray, centroids: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """True where a centroid (column) may be the nearest of a vector (row)."""
    both = [bounds(apexes, a) for a in centroids]
    low, high = (np.column_stack([b[i] for b in both]) for i in (0, 1))
    margin = MARGIN * (sizes[:, None] + own[None, :] + 1)
    return low - margin <= (high + margin).min(axis=1)[:, None]


def nearest(vectors: np.ndarray, distances: np.ndarray, simplex: Simplex, centroids: np.ndarray,
            exact: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(number of the nearest centroid, its squared distance if ``exact``) of each vector."""
    to_pivots = simplex.distances(centroids)
    may = candidates(simplex.apexes(distances), simplex.apexes(to_pivots), distances[:, 0], to_pivots[:, 0])
    number = may.argmax(axis=1)
    open_rows = np.flatnonzero(np.ones(len(vectors), bool) if exact else may.sum(axis=1) > 1)
    best: np.ndarray | None = None
    for k in range(len(centroids)):
        rows = open_rows[may[open_rows, k]]
        if not len(rows):
            continue
        d = squares(vectors[rows], centroids[k])
        if best is None:
            best = np.full(len(vectors), -1, d.dtype)
        elif d.dtype != best.dtype:
            best, d = best.astype(object), d.astype(object)
        better = (best[rows] < 0) | (d < best[rows])  # a tie stays with the smaller number
        best[rows[better]] = d[better]
        number[rows[better]] = k
    return number, best


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def integers(vector, scale: int):
    """floor(scale * x) of each component, x as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(vec_key, ints) of the vectors with ``dim`` finite components."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    return vectors.where((F.size(v) == dim) & finite).select(
        F.col(id_col).cast("long").alias("vec_key"), integers(v, scale).alias("ints"))


def _least(kept: DataFrame, text, n: int) -> list[list[int]]:
    """The vectors whose text hashes least (bounded by n; Spark keeps n a task, not a sorted table)."""
    rows = kept.orderBy(F.sha2(text, 256).asc_nulls_last(), "ints").limit(n).select("ints")
    return [list(r[0]) for r in rows.collect()]


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:", id_col: str = "vec_id",
                      vector_col: str = "embedding", dim: int = 64, scale: int = 1024, pivots: int = PIVOTS,
                      pool: int = PIVOT_POOL) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid.

    Starts are the ``k`` vectors with the least sha256 of salt and id. ``pivots`` of the ``pool`` vectors
    of least sha256 of another salted text are the simplex; both bound what the driver holds.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_col, vector_col, dim, scale)
    digits = F.col("vec_key").cast("string")
    first = _least(kept, F.concat(F.lit(salt), digits), k)
    if not first:
        return kept.select(F.col("vec_key").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"),
            ("centroid_sha256", "string"), ("centroid", "array<long>"))])
    centroids = np.array(first, np.int64)
    simplex = Simplex.over(np.array(_least(kept, F.concat(F.lit("pivot:" + salt), F.coalesce(digits, F.lit(""))), pool), np.int64), pivots)

    def with_distances(batches):
        for b in batches:
            if b.num_rows:
                d = simplex.distances(_matrix(b.column("ints"), dim))
                cached = pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), d.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column("vec_key"), b.column("ints"), cached], ["vec_key", "ints", "distances"])

    cached = written(kept.mapInArrow(with_distances, "vec_key long, ints array<long>, distances array<double>"), "centroid-cache")

    def held(b, now, exact):
        vectors = _matrix(b.column("ints"), dim)
        return vectors, *nearest(vectors, _matrix(b.column("distances"), len(simplex.pivots)), simplex, now, exact)

    def summed(now):
        def run(batches):
            sums, counts = [[0] * dim for _ in now], [0] * len(now)
            for b in batches:
                if not b.num_rows:
                    continue
                vectors, number, _ = held(b, now, False)
                wide = bool(max(abs(int(vectors.max())), abs(int(vectors.min()))) > 1 << 40)
                for c in np.unique(number).tolist():
                    mine = vectors[number == c]
                    total = (mine.astype(object) if wide else mine).sum(axis=0)
                    sums[c] = [int(a) + int(x) for a, x in zip(sums[c], total.tolist(), strict=True)]
                    counts[c] += len(mine)
            for c, n in enumerate(counts):
                if n:
                    yield pa.RecordBatch.from_pydict({
                        "cluster": pa.array([c] * dim, pa.int32()), "component": pa.array(range(dim), pa.int32()),
                        "total": pa.array([str(x) for x in sums[c]], pa.string()), "n": pa.array([n] * dim, pa.int64())})
        return run

    for _ in range(rounds):
        sums = cached.select("ints", "distances").mapInArrow(summed(centroids), "cluster int, component int, total string, n long")
        found = sums.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        moved = centroids.copy()
        for r in found.collect():  # at most k * dim rows
            moved[r.cluster, r.component] = int(r.total) // r.n
        if (moved == centroids).all():  # every further round would give the same
            break
        centroids = moved

    def assigned(batches):
        for b in batches:
            if b.num_rows:
                _, number, best = held(b, centroids, True)
                yield pa.RecordBatch.from_arrays([b.column("vec_key"), pa.array(number.astype(np.int32)), pa.array(
                    [x if x <= LONGEST else None for x in best.tolist()], pa.int64())], ["vec_key", "cluster", "distance"])

    last = written(cached.mapInArrow(assigned, "vec_key long, cluster int, distance long"), "centroid-last")
    per = {r.cluster: (r.total, r.all) for r in last.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), (F.count("distance") == F.count(F.lit(1))).alias("all")).collect()}
    inertias = [int(per[c][0]) if c in per and per[c][1] else 0 if c not in per else LONGEST + 1 for c in range(len(centroids))]

    def fit(x: int):
        return x if x <= LONGEST else None

    rows = [(c, fit(inertias[c]), fit(sum(inertias)), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest(), v)
            for c, v in enumerate(centroids.tolist())]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return last.join(F.broadcast(of_cluster), "cluster").select(  # k rows
        F.col("vec_key").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
