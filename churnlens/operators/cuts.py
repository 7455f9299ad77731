"""Exact selection: the keys at given ranks of a total order, without sorting, shuffling or writing rows.

A quota, a decile, a quantile or a campaign cut needs a few keys of an order, not the order itself. They are
found by narrowing a histogram:

1. a bounded random sample of keys cuts the order into intervals (one job, ``SAMPLE`` keys reach the driver);
2. one aggregate counts the rows per group and interval, and those equal to a boundary apart (one row per
   interval and group is shuffled); running sums on the driver name the interval of each rank wanted. A rank
   that falls on a boundary's own rows is found, whatever their number: a giant tie is never looked into,
   unless a next column of the order breaks it;
3. the rows inside the other intervals, about a ``SAMPLE``-th of the rows per rank, are read once more: at most
   ``MOST`` keys are taken to the driver, more are sampled and counted again by the same steps.

So 150,000 rows take three narrow passes and 10**11 rows five. A row's class is then a comparison
with the keys: a pure function of the row, in the stage that reads it.

What a pass costs is the search for a row's interval. With few groups and numbers in the order's first column,
intervals are of that column alone and ``Bucketizer`` finds them, once a row; rows equal in it are an order of
their own, of the other columns. Keys of any other kind are compared whole, in a binary search over the sample.

Keys are composite (group columns, order columns, an id to break ties), of any type that Spark orders;
nulls come first when ascending and last when descending, NaN is the greatest number.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cmp_to_key

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType, FloatType, IntegerType, ShortType, StructField, StructType

from churnlens.operators.ordered import _bucket, _precedes, binned

SAMPLE = 1024
MOST = 20_000
GROUPS = 10_000  # groups whose sizes the driver holds at most
FEW = 16  # groups whose rows are counted per interval of the first column
DOUBLES = (DoubleType, FloatType, IntegerType, ShortType, ByteType)  # types whose values are doubles, none rounded


class TooManyGroups(ValueError):
    """More groups than the driver is to hold the sizes of."""


Key = tuple
Order = Sequence[tuple[str, bool]]


def _before(a: Key, b: Key, order: Order) -> int:
    """Spark's order of two keys: negative, 0 or positive."""
    for x, y, (_, desc) in zip(a, b, order, strict=True):
        u, v = ((z is not None, isinstance(z, float) and math.isnan(z)) for z in (x, y))
        if u == v and (not u[0] or u[1] or x == y):
            continue
        less = u < v if u != v else x < y
        return 1 if less == desc else -1
    return 0


@dataclass
class Counted:
    """Rows per group and place. Places follow the order; rows at a place in ``known`` are equal in the order's
    leading columns, which have the values given there."""

    counts: list[tuple[Key, int, int]]
    known: dict[int, Key]
    placed: DataFrame


class Cuts:
    """The order (group columns, then ``order``) of a table, from which keys at ranks can be asked.

    ``sizes`` has the number of rows of every group, counted by the same job as the first intervals.
    """

    def __init__(self, df: DataFrame, order: Order, by: Sequence[str] = (), seed: int = 11, sample: int = SAMPLE, most: int = MOST) -> None:
        self.by, self.own = list(by), list(order)
        self.seed, self.sample, self.most = seed, sample, most
        self.rows = df.select(*self.by, *[c for c, _ in self.own])
        self.types = {f.name: f.dataType for f in self.rows.schema.fields}
        self.first = self._counted(self.rows, self.by, self.own)
        per: dict[Key, int] = {}
        for group, _, n in self.first.counts:
            per[group] = per.get(group, 0) + n
        groups = [(c, False) for c in self.by]
        self.sizes = dict(sorted(per.items(), key=cmp_to_key(lambda a, b: _before(a[0], b[0], groups))))

    def _counted(self, rows: DataFrame, by: list[str], order: Order) -> Counted:
        keys = [*by, *[c for c, _ in order]]
        picked = list(dict.fromkeys(tuple(r) for r in rows.select(*keys).orderBy(F.rand(self.seed)).limit(self.sample).collect()))
        if isinstance(rows.schema[order[0][0]].dataType, DOUBLES) and len({k[:len(by)] for k in picked}) <= FEW:
            found = self._binned(rows, by, order[0], {k[len(by)] for k in picked})
            if found:
                return found
        return self._searched(rows, by, order, picked)

    def _binned(self, rows: DataFrame, by: list[str], first: tuple[str, bool], values: set) -> Counted | None:
        """Places of the first column alone. A boundary and the next double are both splits: between them is
        the boundary's own place. None: there are more groups than the sample had, or values no split follows."""
        (c, desc), most = first, sys.float_info.max
        finite = {float(v) + 0.0 for v in values if v is not None and v == v}
        if any(v >= most for v in finite):
            return None
        finite |= {-math.inf}
        splits = sorted(finite | {math.nextafter(v, math.inf) for v in finite} | {math.inf})
        side = -1 if desc else 1
        placed = binned(rows, c, splits, desc, "_place")
        most_rows = FEW * (len(splits) + 1)
        got = placed.groupBy(*by, "_place").agg(F.count(F.lit(1)).alias("_n")).limit(most_rows + 1).collect()
        if len(got) > most_rows or (by and len({tuple(r[:len(by)]) for r in got}) > GROUPS):
            return None
        back = float if isinstance(rows.schema[c].dataType, (DoubleType, FloatType)) else int
        known = {i: (a if math.isinf(a) else back(a),) for i, (a, b) in enumerate(zip(splits, splits[1:])) if math.nextafter(a, math.inf) == b < math.inf}
        known |= {-1: (None,), len(splits) - 1: (math.nan,)}
        return Counted([(tuple(r[:len(by)]), r["_place"], r["_n"]) for r in got], {side * i: v for i, v in known.items()}, placed)

    def _searched(self, rows: DataFrame, by: list[str], order: Order, picked: list[Key]) -> Counted:
        """Places of whole keys. 2 i: between boundaries i - 1 and i; 2 i + 1: equal to boundary i."""
        whole = [*((c, False) for c in by), *order]
        bounds: list[Key] = []
        for k in sorted(picked, key=cmp_to_key(lambda a, b: _before(a, b, whole))):
            if not bounds or _before(bounds[-1], k, whole):
                bounds.append(k)
        fields = [StructField("i", IntegerType())] + [StructField(f"f{i}", rows.schema[c].dataType) for i, (c, _) in enumerate(whole)]
        table = rows.sparkSession.createDataFrame([(i, *b) for i, b in enumerate(bounds)], StructType(fields))
        held = rows.withColumn("_bounds", table.agg(F.array_sort(F.collect_list(F.struct(*table.columns)))).scalar())

        def place(at: Column) -> Column:
            same = F.lit(True)
            for i, (c, _) in enumerate(whole):
                same = same & F.get(F.col("_bounds"), at)[f"f{i}"].eqNullSafe(F.col(c))
            return at * 2 + ((at < len(bounds)) & same).cast("int")

        # as the variable of a lambda the search is done once, wherever Spark puts the expression
        found = F.transform(F.array(_bucket(whole, "_bounds", len(bounds))), place)[0]
        placed = held.withColumn("_place", found).drop("_bounds")
        counts = placed.groupBy(*by, "_place").agg(F.count(F.lit(1)).alias("_n"))
        most = GROUPS + 2 * self.sample + 1  # a group begins in one place, and a place ends
        got = counts.limit(most + 1).collect()
        if len(got) > most:
            raise TooManyGroups(f"more than {GROUPS} groups of {', '.join(by)}")
        return Counted([(tuple(r[:len(by)]), r["_place"], r["_n"]) for r in got], {2 * i + 1: b[len(by):] for i, b in enumerate(bounds)}, placed)

    def at(self, ranks: dict[Key, Sequence[int]]) -> dict[Key, list[Key]]:
        """Per group, the order columns of its rows at the 1-based ranks."""
        for group, wanted in ranks.items():
            if any(not 1 <= r <= self.sizes.get(group, 0) for r in wanted):
                raise ValueError(f"ranks of {group or 'the table'} must be 1 to {self.sizes.get(group, 0)}")
        found = self._keys(self.rows, self.by, self.own, {g: sorted(set(rs)) for g, rs in ranks.items() if rs}, self.first)
        return {g: [found[g, r] for r in rs] for g, rs in ranks.items()}

    def _keys(self, rows: DataFrame, by: list[str], order: Order, ranks: dict[Key, list[int]], counted: Counted | None = None) -> dict[tuple[Key, int], Key]:
        """(group, rank) -> the order columns there."""
        if not ranks:
            return {}
        c = counted or self._counted(rows, by, order)
        per: dict[Key, list[tuple[int, int]]] = {}
        for group, place, n in c.counts:
            per.setdefault(group, []).append((place, n))
        found, inside, ties = {}, {}, {}  # the latter: (group, place) -> [(rank, rank in the place)]
        for group, wanted in ranks.items():
            start, at = 0, 0
            for place, n in sorted(per[group]):
                while at < len(wanted) and wanted[at] <= start + n:
                    if len(c.known.get(place, ())) == len(order):
                        found[group, wanted[at]] = c.known[place]
                    else:
                        (ties if place in c.known else inside).setdefault((group, place), []).append((wanted[at], wanted[at] - start))
                    at += 1
                start += n
        if ties:
            # rows equal in the first column: its place is a group, ordered by the other columns
            groups = {(*g, place): [r for _, r in rs] for (g, place), rs in ties.items()}
            tie = f"_tie{len(order)}"
            left = self._within(c, by, set(ties)).withColumnRenamed("_place", tie)
            deeper = self._keys(left, [*by, tie], order[1:], groups)
            found |= {(g, whole): c.known[place] + deeper[(*g, place), r] for (g, place), rs in ties.items() for whole, r in rs}
        if inside:
            # a group's intervals that are still open, one after another, are an order of their own
            places = {p for _, p in inside}
            taken = set(inside) if len({g for g, _ in inside}) <= FEW else {(g, p) for g, p, _ in c.counts if p in places}
            left = self._within(c, by, taken).drop("_place")
            moved, before = {}, 0
            for group in {g for g, _ in taken}:
                mine = 0
                for place, n in sorted(per[group]):
                    if (group, place) in taken:
                        moved.update({(group, whole): mine + r for whole, r in inside.get((group, place), ())})
                        mine += n
                before += mine
            if before <= self.most:
                keys: dict[Key, list[Key]] = {}
                for r in left.select(*by, *[x for x, _ in order]).collect():
                    keys.setdefault(tuple(r[:len(by)]), []).append(tuple(r[len(by):]))
                deeper = {(g, i): k for g, ks in keys.items() for i, k in enumerate(sorted(ks, key=cmp_to_key(lambda a, b: _before(a, b, order))), 1)}
            else:
                again: dict[Key, list[int]] = {}
                for (group, _), r in sorted(moved.items(), key=lambda m: m[1]):
                    again.setdefault(group, []).append(r)
                deeper = self._keys(left, by, order, {g: sorted(set(rs)) for g, rs in again.items()})
            found |= {(g, whole): deeper[g, r] for (g, whole), r in moved.items()}
        return found

    @staticmethod
    def _within(c: Counted, by: list[str], taken: set[tuple[Key, int]]) -> DataFrame:
        """The rows of these groups and places; of the places, if there are many groups."""
        groups = list(dict.fromkeys(g for g, _ in taken))
        places = sorted({p for _, p in taken})
        if not by or len(groups) > FEW:
            return c.placed.where(F.col("_place").isin(places))
        number = F.lit(None).cast("int")
        for i, group in enumerate(groups):
            number = F.when(_is(by, group, [c.placed.schema[x].dataType for x in by]), i).otherwise(number)
        every = [p for _, p, _ in c.counts]
        width = max(every) - min(every) + 1
        # one expression, so that a row's place is found once
        return c.placed.where((number * width + F.col("_place")).isin([groups.index(g) * width + p for g, p in taken]))


def _is(by: Sequence[str], group: Key, types: Sequence) -> Column:
    out = F.lit(True)
    for c, v, t in zip(by, group, types, strict=True):
        out = out & F.col(c).eqNullSafe(F.lit(v).cast(t))
    return out


def _literal(key: Key, types: Sequence) -> Column:
    return F.struct(*[F.lit(v).cast(t).alias(f"f{i}") for i, (v, t) in enumerate(zip(key, types, strict=True))])


def cuts_before(cuts: Cuts, keys: Sequence[Key]) -> Column:
    """How many of the keys stand strictly before a row, as an expression of the row."""
    types = [cuts.types[c] for c, _ in cuts.own]
    out = F.lit(0)
    for k in keys:
        out = out + _precedes(_literal(k, types), cuts.own).cast("int")
    return out


def group_is(cuts: Cuts, group: Key) -> Column:
    return _is(cuts.by, group, [cuts.types[c] for c in cuts.by])


def cuts_before_in(cuts: Cuts, column: str) -> Column:
    """The same, of the keys that a row holds in an array of ``cut_table``."""
    return F.size(F.filter(column, lambda k: _precedes(k, cuts.own)))


def cut_table(df: DataFrame, cuts: Cuts, keys: dict[Key, list[Key]], name: str = "_cuts") -> DataFrame:
    """(group columns, keys in order) for a lookup: one row per group."""
    inner = StructType([StructField(f"f{i}", cuts.types[c]) for i, (c, _) in enumerate(cuts.own)])
    schema = StructType([*[StructField(c, cuts.types[c]) for c in cuts.by], StructField(name, ArrayType(inner))])
    return df.sparkSession.createDataFrame([(*g, list(ks)) for g, ks in keys.items()], schema)
