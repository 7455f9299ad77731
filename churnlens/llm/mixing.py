"""Mixing sources to target weights by hash-threshold histograms, without sorting a row.

Each source has a budget of tokens: its target. A document's copies are nested: the mix takes every document
``floor(target / size of the source)`` times, and once more those whose hash stands before a threshold, the
place where the sizes in hash order add up to what is left of the budget. No row is sorted to find it:

1. One pass over the texts writes a narrow table (id, source, size, hash key, row key).
2. Sizes are added up per (source, bucket), a bucket being the key's first ``bits`` bits: a histogram of
   bounded length per source, summed map-side, so a source with a third of all rows shuffles no more than
   another one per task. Its running sum names the bucket in which the budget ends.
3. Only the rows of these boundary buckets go on to the next level, with the next bits of the key, until
   each boundary is a single place of the hash order: about ``log2(rows of a source) / bits`` levels, each
   ``2 ** bits`` times smaller than the one before.
4. The documents before a boundary are taken, so a target is never exceeded. What is left of it, less than the
   size of the document at the boundary, is a budget again for documents that are no larger, and gets a
   threshold of its own among them, until at most ``near`` of the target is left or nothing fits. On large
   sources the first threshold does; small ones with long documents need two or three.
5. One filter over the narrow table compares sizes and keys with the source's thresholds.

The key hashes id and size, all that shows in the result, so reruns agree whatever the partitions. Rows
equal in both (repeated rows) are told apart by a second key from their place in the written narrow
table: which of them is taken can't be seen. A source that consists of repeats of one row is split, too.

Targets: sources in code point order, null last, weigh 5, 2, 1, 5, ...; a source's target ends at ``most`` times
its size, and the excess goes to the others by weight until none is above. Only scalars reach the
driver: the share per weight unit is found by repeated aggregates over the table of sources, which is itself
written, counted and broadcast up to 100,000 rows, shuffled beyond.

Defined results: null or blank texts have size 0 and are taken 0 times; a null source is a source of its own;
null ids and repeated rows are documents of their own; sources without words have target 0; an empty
table gives no rows. Only the three named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import written
from churnlens.operators.lookup import BROADCAST_ROWS
from churnlens.operators.ordered import ordered_prefix

WEIGHTS = (5, 2, 1)
MOST = 3
BITS = 10
KEY_BITS = 60
BEHIND = (1 << 62) - 1  # behind every key
NEAR = 0.001  # of a target: what may be left of it
FILLS = 8  # thresholds a source may have
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(text: Column) -> Column:
    """The first 60 bits of a text's md5, as a number that isn't negative."""
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_key, src, size, key, row): the narrow table. ``src`` orders like the source, null last."""
    source = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_key"),
                       F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("src"),
                       word_count(F.col(text_col).cast("string")).alias("size"))
    text = F.concat(F.coalesce(F.col("doc_key").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string"))
    return rows.select("*", hash_key(text).alias("key"), hash_key(F.monotonically_increasing_id().cast("string")).alias("row"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(src, source_size) -> src, source_size, weight, target."""
    place = F.pmod(F.col("rn") - 1, F.lit(len(weights))).cast("int")
    ranked = written(ordered_prefix(sizes, [("src", False)]).select(
        "src", "source_size", F.get(F.array(*[F.lit(w) for w in weights]), place).alias("weight")), "mix-sources")
    size, weight = F.col("source_size").cast("double"), F.col("weight").cast("double")
    share = 0.0
    while True:  # the share per unit of weight only grows, and with it the sources that are full
        full = size * most <= weight * share
        row = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("source_size"))).alias("full"),
                         F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        new = float((row["all"] or 0) - most * (row["full"] or 0)) / float(row["open"])
        if new <= share:
            break
        share = new
    return ranked.select("src", "source_size", "weight", F.least(size * most, weight * F.lit(share)).alias("target"))


def _bucket(column: str, level: int, bits: int) -> Column:
    return F.shiftright(F.col(column), KEY_BITS - bits * (level + 1)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A stored table of one row per source, of counted size: broadcast if it is small enough."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def thresholds(rows: DataFrame, budgets: DataFrame, bits: int = BITS) -> DataFrame:
    """Where each source's budget ends in the order of (key, row): src, at_key, at_row, rest.

    ``rows`` is a stored table of (src, size, key, row), ``budgets`` one row (src, budget) per source. The row
    at that place is the first that goes beyond the budget, ``rest`` what all rows before it leave of it;
    where all rows fit, the place is behind the last possible key.
    """
    if KEY_BITS % bits:
        raise ValueError(f"bits must divide {KEY_BITS}")
    levels = [(c, i) for c in ("key", "row") for i in range(KEY_BITS // bits)]
    left, state, done = rows, budgets.select("src", "budget"), None
    for step, (column, level) in enumerate(levels):
        bars = left.groupBy("src", _bucket(column, level, bits).alias("bar")).agg(
            F.sum("size").alias("held"), F.count(F.lit(1)).alias("n"), F.max(F.struct("key", "row")).alias("top"))
        # up to 2 ** bits bars of a source: the running sum is an aggregate over one short sorted array
        lined = bars.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("bar", "held", "n", "top"))).alias("bars")).join(state, "src")
        start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast(
            "struct<bar:int,held:bigint,n:bigint,top:struct<key:bigint,row:bigint>>").alias("at"))
        found = F.aggregate("bars", start, lambda a, x: F.when(a["at"].isNotNull(), a).when(
            F.col("budget") < a["before"] + x["held"], F.struct(a["before"].alias("before"), x.alias("at"))).otherwise(
            F.struct((a["before"] + x["held"]).alias("before"), a["at"].alias("at"))))
        last = step == len(levels) - 1
        ends = written(lined.select("src", "budget", found.alias("f")).select(
            "src", (F.col("budget") - F.col("f.before")).alias("rest"), F.col("f.at.bar").alias("bar"),
            F.coalesce("f.at.top.key", F.lit(BEHIND)).alias("at_key"), F.coalesce("f.at.top.row", F.lit(BEHIND)).alias("at_row"),
            (F.lit(last) | F.col("f.at").isNull() | (F.col("f.at.n") == 1)).alias("settled")), "mix-ends")
        settled = ends.where("settled").select("src", "at_key", "at_row", "rest")
        done = settled if done is None else done.unionAll(settled)
        more = ends.where("NOT settled")
        n = more.count()
        if not n:
            return done
        left = written(left.join(_small(more.select("src", "bar"), n), "src").where(
            _bucket(column, level, bits) == F.col("bar")).drop("bar"), "mix-boundary")
        state = more.select("src", F.col("rest").alias("budget"))
    return done


def once_more(rows: DataFrame, plan: DataFrame, bits: int, near: float, fills: int) -> DataFrame:
    """(src, places): a document is taken once more if, at one of its source's places, its size is at most
    ``limit`` and its (key, row) stands before (at_key, at_row).

    The first place has no size limit. What it leaves, less than the first document beyond it, is a budget
    again, for the documents not yet taken that are no larger; and so on, until a source's rest is at most
    ``near`` of its target, none is small enough, or ``fills`` places are found.
    """
    kind = "array<struct<limit:double,at_key:bigint,at_row:bigint>>"
    state = plan.where((F.col("source_size") > 0) & (F.col("budget") > 0)).select(
        "src", "target", F.col("budget").alias("rest"), F.array().cast(kind).alias("places"))
    open_rows = rows.where(F.col("size") > 0).select("src", "size", "key", "row")
    done = None
    for fill in range(fills):
        limit = F.lit(float("inf")) if not fill else F.col("rest")
        found = thresholds(open_rows, state.select("src", F.col("rest").alias("budget")), bits).withColumnRenamed("rest", "left")
        after = state.join(found, "src", "left")
        state = written(after.select("src", "target", F.coalesce("left", "rest").alias("rest"), F.when(F.col("at_key").isNull(), F.col("places")).otherwise(
            F.concat("places", F.array(F.struct(limit.alias("limit"), "at_key", "at_row")))).alias("places"),
            (F.col("at_key").isNotNull() & (F.coalesce("left", "rest") > F.col("target") * near)).alias("open")), "mix-places")
        shut = state.where("NOT open" if fill < fills - 1 else "true").select("src", "places")
        done = shut if done is None else done.unionAll(shut)
        state = state.where("open").drop("open")
        n = state.count() if fill < fills - 1 else 0
        if not n:
            return done
        open_rows = written(open_rows.join(_small(state, n), "src").where(
            ~is_before(F.element_at("places", -1)) & (F.col("size") <= F.col("rest"))).select("src", "size", "key", "row"), "mix-open")
    return done


def is_before(place: Column) -> Column:
    """A row of (size, key, row) is small enough for the place and stands before it."""
    return (F.col("size") <= place["limit"]) & (
        (F.col("key") < place["at_key"]) | ((F.col("key") == place["at_key"]) & (F.col("row") < place["at_row"])))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST, bits: int = BITS, near: float = NEAR, fills: int = FILLS) -> DataFrame:
    """One row per document: id, source, size, source_size, target (of its source), copies, taken (size * copies)."""
    rows = written(sized(docs, id_col, text_col, source_col), "mix-sizes")
    sizes = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = written(targets.select("src", "source_size", "target", whole.alias("whole"), (
        F.col("target") - whole * F.col("source_size")).alias("budget")), "mix-plan")
    known = written(plan.join(once_more(rows, plan, bits, near, fills), "src", "left").select(
        "src", "source_size", "target", "whole", "places"), "mix-known")
    joined = rows.join(_small(known, known.count()), "src")
    extra = F.coalesce(F.exists("places", is_before).cast("int"), F.lit(0))
    copies = F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(0)
    return joined.select(F.col("doc_key").alias(id_col), F.when(F.col("src") != "1", F.expr("substring(src, 2)")).alias(source_col),
                         "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
