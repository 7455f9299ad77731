"""Substring dedup: a merged count-min sketch in front of exact window grouping.

A window is ``window`` consecutive words of one document; every word covered by a window that also
starts anywhere else is removed. Documents are dealt to chunks of a few MB, and the hash space to
shards of a few million windows; both numbers follow from the input's size, so what one task holds
stays the same. Everything that travels is packed: a chunk sends each shard one row.

1. Each chunk sends, per shard, its partial count-min sketch in sparse form: four bytes per distinct
   window (from which the cell in each row of the sketch follows) and one bit for "twice here".
2. A shard adds its partial sketches up and answers each chunk with a bit per window: estimated
   repeated or not. Counts in a sketch are never too low, so no repeated window is lost.
3. Each chunk sends the 128-bit hashes of only those windows to be grouped exactly per shard, and
   gets a bit for each back.
4. Each chunk drops the covered words.

The dealt documents (step 1, 3, 4) are one shuffle that Spark reuses. A window that fills the corpus
is one entry per chunk, so no shard gets more of it than there are chunks. Rows equal in id and text would
go to one chunk: a task counts them before they are dealt, one row per batch that it reads, and they are
repeated again at the end.

A window's hash is 128 bits, two polynomials over the two halves of each word's 128-bit hash: the halves
are independent, so two words that agree in one don't agree in the other. "Exactly" means by these 128 bits.

Defined results: null, empty or wordless text: no words, nothing removed, kept text empty; documents
shorter than a window lose nothing; repeated rows repeat each other's windows; empty table: empty
result. Only the id and the text are read, so other columns play no part.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import text_bytes

WINDOW = 35
CHUNK_BYTES = 4 << 20
SHARD_WINDOWS = 2 << 20
CELLS_PER_WINDOW = 4  # width of a sketch row; two rows then pass about one in 20 of the unrepeated

_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)  # odd, so they have inverses modulo 2^64
_ROWS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))


def word_list(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: what bytes.split() separates."""
    return text.split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _rolling(words: np.ndarray, base: int, window: int) -> np.ndarray:
    """Polynomial hash of each window, modulo 2^64, from one running sum."""
    n = len(words)
    up, down = np.full(n, base, np.uint64), np.full(n - window + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)))
    return _mixed((total[window:] - total[:-window]) * down)


def window_hashes(docs: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, place of the first word) of all windows of the documents, places counted through all."""
    sizes = np.array([len(d) for d in docs], np.int64)
    n = int(sizes.sum())
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for d in docs for w in d]), "<u8").reshape(-1, 2)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # words from here to the document's end
    at = np.flatnonzero(left[:n - window + 1] >= window)
    return _rolling(words[:, 0], _BASES[0], window)[at], _rolling(words[:, 1], _BASES[1], window)[at], at


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _slices(h: np.ndarray, shards: int):
    """(shard, from, to) of sorted hashes."""
    of = _shard(h, shards)
    cuts = [*(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else []
    for s, e in zip([0, *cuts[:-1]], cuts, strict=False):
        yield int(of[s]), s, e


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


BLOBS = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("held", pa.binary()), ("twice", pa.binary())])
BLOBS_SQL = "chunk long, shard long, held binary, twice binary"
ANSWER = pa.schema([("chunk", pa.int64()), ("step", pa.int32()), ("shard", pa.int64()), ("bits", pa.binary())])
ANSWER_SQL = "chunk long, step int, shard long, bits binary"
KEPT = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                  ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_text", pa.binary())])
KEPT_SQL = "id long, n long, n_words long, n_removed long, removed array<struct<start: long, stop: long>>, kept_text binary"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


class Chunk:
    """A chunk's documents and windows; every pass makes the same sorted hashes of it."""

    def __init__(self, rows: pa.Table, window: int) -> None:
        self.number = rows.column("chunk")[0].as_py() if rows.num_rows else None
        self.ids = rows.column("id").to_pylist()
        self.docs = [word_list(t) for t in rows.column("body").to_pylist()]
        self.copies = rows.column("n").to_numpy()
        self.h1, self.h2, self.at = window_hashes(self.docs, window)
        sizes = np.array([len(d) for d in self.docs], np.int64)
        self.times = self.copies[np.searchsorted(np.cumsum(sizes), self.at, "right")]  # rows that a window's document stands for

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        h, place = np.unique(self.h1, return_inverse=True)
        return h, np.bincount(place, self.times, len(h))

    def repeated(self, answers: pa.Table, step: int, h: np.ndarray, shards: int) -> np.ndarray:
        """The answers' bits for sorted hashes ``h``."""
        bits = {r["shard"]: r["bits"] for r in answers.to_pylist() if r["step"] == step}
        out = np.zeros(len(h), bool)
        for shard, s, e in _slices(h, shards):
            out[s:e] = _unbits(bits[shard], e - s)
        return out

    def candidates(self, answers: pa.Table, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows estimated repeated: (their numbers, ordered by hash pair; first of each pair; times)."""
        h, _ = self.distinct()
        passed = self.repeated(answers, 1, h, shards)
        which = np.flatnonzero(passed[np.searchsorted(h, self.h1)])
        which = which[np.lexsort((self.h2[which], self.h1[which]))]
        a, b = self.h1[which], self.h2[which]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(which) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        return which, first, np.diff(np.append(first, len(which)))

    def repeated_here(self, which: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each pair of ``candidates``, whether it starts more than once in this chunk's rows."""
        return np.add.reduceat(self.times[which], first) > 1 if len(first) else np.zeros(0, bool)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    chunk_bytes: int = CHUNK_BYTES, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """One row per document: id, n_words, n_removed, removed (word ranges), kept_text (UTF-8). Ids are integers."""
    size = text_bytes(docs, text_col)
    chunks = max(1, math.ceil(size / chunk_bytes))
    shards = max(1, math.ceil(size / 6 / shard_windows))  # about six bytes a word

    def counted(batches):
        for b in batches:
            number = {}
            place = np.array([number.setdefault(r, len(number)) for r in zip(b.column("id").to_pylist(), b.column("body").to_pylist(), strict=True)], np.int64)
            first = np.unique(place, return_index=True)[1]
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(first)).columns, pa.array(np.bincount(place), pa.int64())], ["id", "body", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body")).mapInArrow(counted, "id long, body binary, n long")
    dealt = rows.select(F.pmod(F.xxhash64("id", "body"), F.lit(chunks)).alias("chunk"), "id", "body", "n")

    def sketched(rows: pa.Table) -> pa.Table:
        c = Chunk(rows, window)
        h, n = c.distinct()
        return _table([(c.number, shard, h[s:e].astype(np.uint32).tobytes(), _bits(n[s:e] > 1))
                       for shard, s, e in _slices(h, shards)], BLOBS)

    def estimated(blobs: pa.Table) -> pa.Table:
        held = [np.frombuffer(x, np.uint32) for x in blobs.column("held").to_pylist()]
        twice = np.concatenate([_unbits(t, len(x)) for t, x in zip(blobs.column("twice").to_pylist(), held, strict=True)])
        every = np.concatenate(held)
        width = max(10, math.ceil(math.log2(CELLS_PER_WINDOW * len(every))))
        passed = np.ones(len(every), bool)
        for odd in _ROWS:  # the sketch's rows: sums of the partial sketches, looked up again
            cell = (every * odd) >> np.uint32(32 - width)
            sums = np.bincount(cell, minlength=1 << width)
            sums += np.bincount(cell[twice], minlength=1 << width)
            passed &= (sums >= 2)[cell]
        return _answers(blobs, 1, [len(x) for x in held], passed)

    def exact(blobs: pa.Table) -> pa.Table:
        held = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in blobs.column("held").to_pylist()]
        twice = np.concatenate([_unbits(t, x.shape[1]) for t, x in zip(blobs.column("twice").to_pylist(), held, strict=True)])
        a, b = np.concatenate(held, axis=1)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        group = np.cumsum(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) - 1
        times = np.bincount(group) + np.bincount(group, weights=twice[order]).astype(np.int64)
        passed = np.empty(len(order), bool)
        passed[order] = times[group] > 1
        return _answers(blobs, 2, [x.shape[1] for x in held], passed)

    def compared(rows: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(rows, window)
        which, first, _ = c.candidates(answers, shards)
        a, b, more = c.h1[which[first]], c.h2[which[first]], c.repeated_here(which, first)
        return _table([(c.number, shard, a[s:e].tobytes() + b[s:e].tobytes(), _bits(more[s:e]))
                       for shard, s, e in _slices(a, shards)], BLOBS)

    def dropped(rows: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(rows, window)
        which, first, times = c.candidates(answers, shards)
        passed = np.repeat(c.repeated(answers, 2, c.h1[which[first]], shards), times)
        edge = np.zeros(sum(map(len, c.docs)) + 1, np.int64)
        starts = c.at[which[passed]]
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out, begin = [], 0
        for key, n, words in zip(c.ids, c.copies.tolist(), c.docs, strict=True):
            mask = gone[begin:begin + len(words)]
            begin += len(words)
            flips = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))).reshape(-1, 2)
            out.append((key, n, len(words), int(mask.sum()), [{"start": s, "stop": e} for s, e in flips.tolist()],
                        b" ".join(compress(words, (~mask).tolist()))))
        return _table(out, KEPT)

    by_chunk = dealt.groupBy("chunk")
    guess = by_chunk.applyInArrow(sketched, BLOBS_SQL).groupBy("shard").applyInArrow(estimated, ANSWER_SQL)
    pairs = by_chunk.cogroup(guess.groupBy("chunk")).applyInArrow(compared, BLOBS_SQL)
    known = pairs.groupBy("shard").applyInArrow(exact, ANSWER_SQL)
    kept = by_chunk.cogroup(guess.unionAll(known).groupBy("chunk")).applyInArrow(dropped, KEPT_SQL)
    again = kept.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return again.drop("n").withColumnRenamed("id", id_col)


def _answers(blobs: pa.Table, step: int, sizes: list[int], passed: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes).tolist()
    return _table([(chunk, step, shard, _bits(passed[e - n:e])) for chunk, shard, n, e in
                   zip(blobs.column("chunk").to_pylist(), blobs.column("shard").to_pylist(), sizes, ends, strict=True)], ANSWER)
