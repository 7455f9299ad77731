"""Exact dedup by Grace hashing: spill files and an open-addressing table over complete content.

1. Local pass, one task per input partition: texts go into an open-addressing table that compares
   complete content. Once the distinct contents held reach the memory budget, texts not in the table
   go to spill files by the next bits of their hash; each file is treated the same way, recursively,
   until its distinct contents fit. Each row comes out with its local leader (the largest id of
   its text in the partition); only a leader carries the text. A text in the table holds one id and a
   count: of two ids the lesser goes out at once, so copies take no memory, however many there are.
2. The leaders, at most one per text and input partition, are dealt by content hash and go through
   the same Grace step, which merges counts and gives the global keeper; it holds 8 bytes per leader.
3. Rows meet their leader's keeper by leader id.

So a text that fills a third of all rows is one row per input partition before the shuffle. The
spill files are the task's own, like a sort's: nobody else reads them, a repeated task writes its own
again, and they are gone when the task ends. The result of pass 1 is written to the shared folder.

``exact_survivors`` holds one (id, row number) per text; the other columns of its rows wait in a file
of the task's own, too, so a task holds no more than its table.

Defined results: null text counts as empty; of equal texts exactly one row is kept, one with the
largest id; a null id loses against any other; repeated rows come back as often as they came; an
empty table gives an empty result. Only the id and the text are read, so other columns play no part.
"""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import pickle
import tempfile
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import carried, restored, written

TABLE_BYTES = 64 << 20  # distinct content a table holds before the rest is spilled
FANOUT = 32  # spill files a level
BLOCK = 1 << 20  # bytes gathered before a spill file is written to
ROWS_OUT = 4096


class ContentTable:
    """Open addressing with linear probing; a slot holds an entry's number, compared by content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find(self, h: int, content: bytes) -> int:
        """The entry's number, or -1 minus the free slot."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (e := slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e
            at = (at + 1) & mask
        return -1 - at

    def add(self, slot: int, h: int, content: bytes) -> int:
        self.slots[slot] = e = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 120
        if 3 * len(self.contents) > 2 * len(self.slots):
            self._grow()
        return e

    def _grow(self) -> None:
        slots = [-1] * (4 * len(self.slots))
        mask = len(slots) - 1
        for e, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = e
        self.slots = slots


class Spill:
    """One spill file, written and read in pickled blocks of records."""

    def __init__(self, folder: str) -> None:
        self.file = tempfile.TemporaryFile(dir=folder)
        self.block: list[tuple] = []
        self.held = 0

    def put(self, record: tuple) -> None:
        self.block.append(record)
        self.held += len(record[0]) + 64
        if self.held > BLOCK // 4:
            self.flush()

    def flush(self) -> None:
        if self.block:
            pickle.dump(self.block, self.file, protocol=5)
            self.block, self.held = [], 0

    def records(self) -> Iterator[tuple]:
        self.flush()
        self.file.seek(0)
        with contextlib.suppress(EOFError):
            while True:
                yield from pickle.load(self.file)

    def close(self) -> None:
        self.file.close()


class Rests:
    """Arrow values of the rows read, in a file; given back by row number once all are written."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/rest"
        self.writer = self.reader = None
        self.starts: list[int] = []
        self.rows = 0

    def put(self, values: pa.Array) -> range:
        """The values' row numbers."""
        if len(values):
            batch = pa.RecordBatch.from_arrays([values], ["rest"])
            if self.writer is None:
                self.writer = pa.ipc.new_file(self.path, batch.schema)
            self.writer.write_batch(batch)
            self.starts.append(self.rows)
        self.rows += len(values)
        return range(self.rows - len(values), self.rows)

    def take(self, rows: tuple[int, ...]) -> pa.Array:
        if self.reader is None:
            self.writer.close()
            self.reader = pa.ipc.open_file(pa.memory_map(self.path))
        at = np.array(rows, np.int64)
        starts = np.array(self.starts)
        batch = np.searchsorted(starts, at, "right") - 1
        order = np.argsort(batch, kind="stable")
        found, first = np.unique(batch[order], return_index=True)
        parts = [self.reader.get_batch(int(k)).column(0).take(pa.array(at[i] - starts[k]))
                 for k, i in zip(found, np.split(order, first[1:]), strict=True)]
        return pa.concat_arrays(parts).take(pa.array(np.argsort(order, kind="stable")))


def grace(records: Iterable[tuple], budget: int, folder: str, fold: Callable, level: int = 0) -> Iterator[tuple]:
    """Folds (content, key, n) records by content: yields (content, state) per distinct content once its
    bucket is read, and before that (None, row) for every row that ``fold`` lets go at once.

    ``fold(state, key, n)`` gives (new state, bytes that it grew by, row or None); a new content's state is None.
    Each table takes ``budget`` bytes before records of further contents are spilled, so every level leaves
    less to do, whatever the hashes.
    """
    table, states, spills = ContentTable(), [], []
    for content, key, n in records:
        h = xxhash.xxh3_64_intdigest(content, seed=level)
        e = table.find(h, content)
        if e < 0:
            if table.bytes >= budget:
                if not spills:
                    spills = [Spill(folder) for _ in range(FANOUT)]
                spills[(h >> 40) % FANOUT].put((content, key, n))
                continue
            e = table.add(-1 - e, h, content)
            states.append(None)
        states[e], grown, row = fold(states[e], key, n)
        table.bytes += grown
        if row is not None:
            yield None, row
    yield from zip(table.contents, states, strict=True)
    del table, states
    for spill in spills:
        yield from grace(spill.records(), budget, folder, fold, level + 1)
        spill.close()


def _order(key) -> tuple:
    return (key is not None, key if key is not None else 0)


STATE_BYTES = 200  # of a text's state: a few small objects


def leading(first_group: int) -> Callable:
    """Fold of (id, 1) records; state (group, largest id, count). The lesser of two ids goes out as (id, group)."""
    groups = itertools.count(first_group)

    def fold(state, key, n):
        if state is None:
            return (next(groups), key, n), STATE_BYTES, None
        group, best, held = state
        if _order(key) > _order(best):
            return (group, key, held + n), 0, (best, group)
        return (group, best, held + n), 0, (key, group)

    return fold


def merging(state, key, n):
    """Fold of ((id, group), n) leaders; state [largest (id, group), count, all groups]."""
    if state is None:
        return [key, n, array("q", [key[1]])], STATE_BYTES, None
    state[2].append(key[1])
    state[1] += n
    if (_order(key[0]), key[1]) > (_order(state[0][0]), state[0][1]):
        state[0] = key
    return state, 8, None


def best_key(state, key, n):
    """Fold that keeps one (id, row), the first with the largest id."""
    if state is None:
        return key, STATE_BYTES, None
    return (key if _order(key[0]) > _order(state[0]) else state), 0, None


def _folded(batches: Iterable[pa.RecordBatch], budget: int, fold: Callable) -> Iterator[tuple]:
    """``grace`` over Arrow batches with the columns content, id[, group or row, n]."""
    def records():
        for b in batches:
            content = b.column(0).cast(pa.binary()).to_pylist()
            ids, *more = (b.column(i).to_pylist() for i in range(1, b.num_columns))
            for i, text in enumerate(content):
                yield text or b"", ids[i] if not more else (ids[i], more[0][i]), more[1][i] if more else 1

    with tempfile.TemporaryDirectory() as folder:
        yield from grace(records(), budget, folder, fold)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    out, size = [], 0
    for r in rows:
        out.append(r)
        size += 64 + sum(len(x) for x in r if isinstance(x, bytes))
        if len(out) >= ROWS_OUT or size > BLOCK * 8:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


LOCAL = pa.schema([("id", pa.int64()), ("grp", pa.int64()), ("first", pa.bool_()), ("content", pa.binary()), ("n", pa.int64())])
MERGED = pa.schema([("grp", pa.int64()), ("wins", pa.bool_()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. Ids are integers."""
    def local(batches):
        def rows():
            for content, found in _folded(batches, table_bytes, leading(TaskContext.get().partitionId() << 40)):
                if content is None:
                    yield (*found, False, None, None)
                else:
                    yield (found[1], found[0], True, content, found[2])

        yield from _batches(rows(), LOCAL)

    def merged(batches):
        def rows():
            for content, ((keep, winner), size, groups) in _folded(batches, table_bytes, merging):
                digest = hashlib.sha256(content).hexdigest()
                for g in groups:
                    yield (g, g == winner, keep, size, digest)

        yield from _batches(rows(), MERGED)

    members = written(docs.select(F.col(text_col), F.col(id_col).cast("long")).mapInArrow(
        local, "id long, grp long, first boolean, content binary, n long"), "exact-local")
    leaders = members.where("first").select("content", "id", "grp", "n")
    groups = leaders.repartition(F.xxhash64("content")).mapInArrow(
        merged, "grp long, wins boolean, keep_id long, group_size long, text_sha256 string")
    return members.select("id", "grp", "first").join(groups, "grp").select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("first") & F.col("wins")).alias("kept"), "text_sha256")


def surviving(batches: Iterable[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Of (doc_key, body, rest) rows one per text, with the largest id; null texts as empty."""
    with tempfile.TemporaryDirectory() as folder:
        rests = Rests(folder)

        def seen():
            for b in batches:
                # columns of a batch share one buffer, so none is held: rest goes to the file
                where = pa.array(rests.put(b.column("rest")), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("body"), b.column("doc_key"), where, pa.array([1] * b.num_rows, pa.int64())], ["body", "id", "at", "n"])

        kept, size = [], 0
        for content, key in _folded(seen(), budget, best_key):  # all input is read before the first group
            kept.append((*key, content))
            size += len(content)
            if size > BLOCK * 8 or len(kept) >= ROWS_OUT:
                yield _rows(kept, rests)
                kept, size = [], 0
        if kept:
            yield _rows(kept, rests)


def exact_survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, with all their columns: ``exact_dedup``'s kept ones, texts as they were but null as empty.

    Only survivors of a partition are shuffled, once, and nothing is written in between.
    """
    def survivors(batches):
        return surviving(batches, table_bytes)

    base = carried(docs, id_col, text_col, True)
    local = base.mapInArrow(survivors, base.schema)
    merged = local.repartition(F.xxhash64("body")).mapInArrow(survivors, base.schema)
    return restored(merged, docs, text_col)


def _rows(kept: list[tuple], rests: Rests) -> pa.RecordBatch:
    ids, at, content = zip(*kept, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(content, pa.binary()).cast(pa.string()), rests.take(at)], ["doc_key", "body", "rest"])
