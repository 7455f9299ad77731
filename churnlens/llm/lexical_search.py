"""Ranked lexical search: term-at-a-time over short lists, document-at-a-time with skipping over long ones.

All documents are ranked for each item of a query table by an integer score with saturating term counts
and a length norm. No index of the whole vocabulary is kept: only terms of the items can score.

1. A pass over the texts writes a forward table: per document its length and the counts of those of its
   terms that occur in the items. The corpus statistics (documents, terms, documents holding each item
   term) are Spark aggregates over it; the driver holds scalars and one number per item term.
2. Each task of the second pass cuts its documents into blocks of bounded size, turns a block into
   posting lists (documents and integer impacts by term) and runs every item over the block:

   * term at a time: the item's lists of at most ``short`` postings are merged into one sorted list of
     accumulators, each the sum of a document's impacts. From then on they are one more iterator, whose bound
     is known: the accumulators' largest value, over all and within each range of ``RANGE`` documents;
   * document at a time: ranges are walked in document order over this iterator and the long lists
     together. The bound of a range is the sum of the iterators' bounds in it; a range whose bound can't
     reach the item's current ``top``-th score is skipped in all lists at once. Documents of a range that
     isn't are scored completely, in exact integers, before the next ranges are looked at.

   The ``top`` best of an item and their threshold are carried from block to block, so later blocks skip more.
3. A task gives ``top`` rows per item at most. They are merged in two steps, first in salted groups, so
   that no task gets the rows of all tasks at once.

Items are taken in blocks of ``item_bytes`` of text (a stated query set against all rows, in blocks); each block's
vocabulary, at most that many bytes, is what is sent to the workers. A block is a pass of its own.

Defined results: terms are runs of ``[0-9A-Za-z]`` and characters beyond ASCII, A-Z lower-cased and nothing
else; null, empty and term-less texts count nowhere and match nothing; repeated documents are ranked
one by one, repeated items too (their rows repeat); of equal scores the smaller id comes first and null ids
last; items whose terms occur nowhere, and empty tables, give no rows. Documents are read whole, and
only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from churnlens.llm.common import written

TOP = 20
RANGE = 64  # documents of a range
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 15, 1 << 21  # what a block holds at most (a document more, in postings)
SHORT = 256  # postings of a list that is summed into the accumulators
FIRST_RANGES = 4  # looked at together before the threshold is asked again; doubled each time
ITEM_BYTES = 4 << 20
SALTS = 32

_KEPT = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_KEPT).split() if text else []


def item_terms(items: list[str | None]) -> tuple[dict[bytes, int], list[dict[int, int]]]:
    """Numbers of all terms of the items, and each item's terms with their repeats."""
    numbers: dict[bytes, int] = {}
    return numbers, [{numbers.setdefault(t, len(numbers)): n for t, n in Counter(terms(x)).items()} for x in items]


def _forward(numbers: dict[bytes, int]):
    def run(batches):
        for b in batches:
            sizes, lists, counts = [], [], []
            for text in b.column("body").to_pylist():
                held = Counter(terms(text))
                sizes.append(held.total())
                known = sorted((numbers[t], n) for t, n in held.items() if t in numbers)
                lists.append([t for t, _ in known])
                counts.append([n for _, n in known])
            yield pa.RecordBatch.from_arrays([
                b.column("doc_key"), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int32())),
                pa.array(counts, pa.list_(pa.int64()))], ["doc_key", "n", "terms", "counts"])
    return run


class Block:
    """Posting lists over consecutive documents, with impacts and, for long lists, their largest by range."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, rows: np.ndarray, numbers: np.ndarray, counts: np.ndarray,
                 n_docs: int, n_terms: int, vocabulary: int, short: int = SHORT) -> None:
        self.ids, self.short = ids, short
        norm = 75 + (25 * sizes * n_docs) // n_terms
        impacts = (1_000_000_000 * counts) // (1000 * counts + 12 * norm[rows])
        order = np.argsort(numbers, kind="stable")  # postings stay in document order within a term
        self.rows, self.impacts = rows[order], impacts[order]
        self.edges = np.concatenate(([0], np.cumsum(np.bincount(numbers, minlength=vocabulary))))
        self.ranges = -(-len(ids) // RANGE)
        self.long: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.edges[term], self.edges[term + 1])
        return self.rows[at], self.impacts[at]

    def skips(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each range begins in the term's list, and the largest impact in each: made once, for all items."""
        if term not in self.long:
            self.long[term] = bounded(*self.postings(term), self.ranges)
        return self.long[term]


def bounded(rows: np.ndarray, values: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each range and the end, largest value of each range) of a list in document order."""
    edges = np.searchsorted(rows, np.arange(ranges + 1) * RANGE)
    most = np.zeros(ranges, np.int64)
    full = np.flatnonzero(np.diff(edges))
    if len(full):
        most[full] = np.maximum.reduceat(values, edges[full])
    return edges, most


def accumulators(block: Block, weights: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Short lists added up term at a time: (documents in order, sums)."""
    if not weights:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = [(block.postings(t), w) for t, w in weights]
    rows = np.concatenate([r for (r, _), _ in lists])
    values = np.concatenate([v * w for (_, v), w in lists])
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, np.int64)
    return rows[first], np.add.reduceat(values, first) if len(first) else values


class Best:
    """The best (score, id) pairs so far; null ids stand last among equals."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        """What a document must reach at least (a tie may win by its id)."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def take(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -scores))[:self.top]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


def search_block(block: Block, null: np.ndarray, query: dict[int, int], best: Best) -> int:
    """One item over one block; returns how many ranges were scored."""
    sizes = {t: int(block.edges[t + 1] - block.edges[t]) for t in query}
    short = [(t, w) for t, w in query.items() if 0 < sizes[t] <= block.short and w]
    long = [(t, w) for t, w in query.items() if sizes[t] > block.short and w]
    summed, sums = accumulators(block, short)
    # iterators, the accumulators first: (documents, values, weight, range edges), and the bound of each range
    iterators = [(summed, sums, 1, *bounded(summed, sums, block.ranges))] if len(summed) else []
    iterators += [(*block.postings(t), w, *block.skips(t)) for t, w in long]
    if not iterators:
        return 0
    bound = sum(w * most for *_, w, _, most in iterators)
    at, step, scored = 0, FIRST_RANGES, 0
    while at < block.ranges:
        ahead = np.flatnonzero(bound[at:] >= best.threshold)[:step] + at
        if not len(ahead):
            break
        cuts = np.flatnonzero(np.diff(ahead) > 1) + 1
        for run in np.split(ahead, cuts):  # neighbouring ranges: one slice of each list
            low, high = int(run[0]), int(run[-1]) + 1
            scores = np.zeros((high - low) * RANGE, np.int64)
            for rows, values, w, edges, _ in iterators:
                part = slice(edges[low], edges[high])
                scores[rows[part] - low * RANGE] += w * values[part]
            good = np.flatnonzero(scores >= best.threshold)
            if len(good):
                docs = good + low * RANGE
                best.take(scores[good], block.ids[docs], null[docs])
        scored += len(ahead)
        at, step = int(ahead[-1]) + 1, step * 2
    return scored


def _blocks(batches, n_docs: int, n_terms: int, vocabulary: int, short: int) -> Iterator[tuple[Block, np.ndarray]]:
    held, docs, postings = [], 0, 0

    def block():
        ids, sizes, lists, numbers, counts = (np.concatenate(x) for x in zip(*[p[:5] for p in held], strict=True))
        null = np.concatenate([p[5] for p in held])
        return Block(ids, sizes, np.repeat(np.arange(len(ids)), lists), numbers, counts, n_docs, n_terms, vocabulary, short), null

    for b in batches:
        at = 0
        edges = b.column("terms").offsets.to_numpy().astype(np.int64)
        numbers, counts = b.column("terms").values.to_numpy(), b.column("counts").values.to_numpy()
        ids = b.column("doc_key")
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids, sizes = ids.fill_null(0).to_numpy(), b.column("n").to_numpy()
        while at < b.num_rows:
            room = int(np.searchsorted(edges, edges[at] + BLOCK_POSTINGS - postings, "right")) - 1
            to = min(max(room, at + 1), at + BLOCK_DOCS - docs, b.num_rows)
            cut = slice(edges[at], edges[to])
            held.append((ids[at:to], sizes[at:to], np.diff(edges[at:to + 1]), numbers[cut].astype(np.int64), counts[cut], null[at:to]))
            docs, postings, at = docs + to - at, postings + int(edges[to] - edges[at]), to
            if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                yield block()
                held, docs, postings = [], 0, 0
    if held:
        yield block()


def _searched(queries: list[dict[int, int]], n_docs: int, n_terms: int, vocabulary: int, top: int, short: int):
    def run(batches):
        best = [Best(top) for _ in queries]
        for block, null in _blocks(batches, n_docs, n_terms, vocabulary, short):
            for q, b in zip(queries, best, strict=True):
                search_block(block, null, q, b)
        for number, b in enumerate(best):
            if len(b.scores):
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(b.scores), pa.int32()), pa.array(b.ids, mask=b.null),
                                                  pa.array(b.scores)], ["item", "doc_key", "score"])
    return run


def _best_of(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_key").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def item_blocks(items: DataFrame, text_col: str, most: int) -> Iterator[list]:
    """Rows of the query table, in blocks of at most ``most`` bytes of text (or one row)."""
    held, size = [], 0
    for r in items.toLocalIterator():
        n = len((r[text_col] or "").encode())
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(r)
        size += n
    if held:
        yield held


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", top: int = TOP, short: int = SHORT, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_col, rank, id_col, score: each item's ``top`` highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_key"), F.col(text_col).cast("string").alias("body"))
    items = items.select(F.col(item_col), F.col(item_text).cast("string").alias(item_text))
    kind = items.schema[item_col].dataType
    out = None
    for block in item_blocks(items, item_text, item_bytes):
        numbers, counted = item_terms([r[item_text] for r in block])
        forward = written(base.mapInArrow(_forward(numbers), "doc_key long, n long, terms array<int>, counts array<long>"), "search-forward")
        n_docs, n_terms = forward.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        if not n_terms or not numbers:
            continue
        holding = forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
        weights = {r.t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1))) for r in holding.collect()}  # item terms only
        queries = [{t: n * weights[t] for t, n in q.items() if t in weights} for q in counted]
        found = forward.where(F.size("terms") > 0).mapInArrow(
            _searched(queries, n_docs, n_terms, len(numbers), top, short), "item int, doc_key long, score long")
        found = _best_of(found.withColumn("salt", F.pmod(F.xxhash64("doc_key"), F.lit(SALTS))), ["item", "salt"], top).drop("rank", "salt")
        found = _best_of(found, ["item"], top)
        named = spark.createDataFrame([(i, r[item_col]) for i, r in enumerate(block)], StructType([StructField("item", IntegerType()), StructField(item_col, kind)]))
        rows = found.join(F.broadcast(named), "item").select(  # at most item_bytes of items
            item_col, "rank", F.col("doc_key").alias(id_col), "score")
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        return items.limit(0).select(item_col, F.lit(0).alias("rank"), F.lit(0).cast("long").alias(id_col), F.lit(0).cast("long").alias("score"))
    return out
