"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Items and documents are normalised alike: A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
joined by one space. An item's windows are its runs of 13 words (an item of fewer, but not none, is
one window). The automaton holds every distinct window, each between two spaces so that only whole
words match; a document is scanned once, and a match's place is turned into word numbers and, where
asked for, into code points of the original text.

The benchmark is the small side by its nature; its windows are still measured before they are sent
out, and what is bounded is the automaton's own size in a worker, ``NODE_BYTES`` for each character of a
window at most. A worker builds it once and keeps it from task to task. Beyond ``automaton_bytes`` the items
are dealt to shards, each with an automaton of its own that is gathered, sent, scanned and written before the
next: only then is a document scanned more than once.

Defined results: null text or one without words: no words, no hits, not contaminated; items without
words match nothing; repeated rows and items are treated one by one (an item_id counts once per
document); empty tables give no hits or no rows. Only the named columns are read, so others play no
part.
"""

from __future__ import annotations

import math
import re
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from churnlens.llm.common import carried, text_bytes, written

WINDOW = 13
AUTOMATON_BYTES = 256 << 20  # of memory that one automaton may take in a worker
NODE_BYTES = 64  # that a character of a window takes in it at most: a node, its edge and its share of the tables
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

_KEPT = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256))


def normalised(text: str) -> list[bytes]:
    """The text's words in UTF-8: every other ASCII character separates, all beyond ASCII stays."""
    return text.encode().translate(_KEPT).split(b" ") if text else []


def words(text: str) -> list[bytes]:
    return [w for w in normalised(text) if w]


def item_windows(item: list[bytes], window: int) -> set[bytes]:
    return {b" ".join(item[i:i + window]) for i in range(max(1, len(item) - window + 1))} if item else set()


def gathered(items, window: int) -> dict[str, list[str]]:
    """Every distinct window of the items, with the ids of the items that hold it."""
    out: dict[str, list[str]] = {}
    for number, text in items:
        for w in item_windows(words(text or ""), window):
            out.setdefault(w.decode(), []).append(str(number))
    return out


def automaton(windows: dict[str, list[str]]) -> ahocorasick.Automaton | None:
    """The automaton over the windows between spaces; None if there is none."""
    a = ahocorasick.Automaton()
    for text, numbers in windows.items():
        a.add_word(f" {text} ", (len(text) + 2, numbers))
    if not windows:
        return None
    a.make_automaton()
    return a


class Windows:
    """The windows as they are sent; a worker builds the automaton once, when the first task asks for it."""

    def __init__(self, windows: dict[str, list[str]]) -> None:
        self.windows = windows

    @cached_property
    def automaton(self) -> ahocorasick.Automaton | None:
        held = automaton(self.windows)
        self.windows = {}  # the automaton has them
        return held


def hits(a: ahocorasick.Automaton | None, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(words, merged word ranges that are hit, item ids) of one document."""
    got = words(text)
    if a is None or not got:
        return len(got), [], set()
    line = f" {b' '.join(got).decode()} "
    found, numbers = [], set()
    for end, (size, items) in a.iter(line):
        found.append((end - size + 1, end))
        numbers.update(items)
    if not found:
        return len(got), [], numbers
    # a match begins and ends with a space: the n-th space stands before word n
    spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
    at = np.searchsorted(spaces, np.array(found))
    return len(got), merged(map(tuple, at.tolist())), numbers


def merged(ranges) -> list[tuple[int, int]]:
    """Overlapping and touching ranges joined, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def original_offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans of word ranges in the text as it was."""
    if not ranges:
        return []
    spans = [m.span() for m in WORD.finditer(text.translate(_LOWER))]  # places stay: A-Z only
    return [(spans[s][0], spans[e - 1][1]) for s, e in ranges]


RANGES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
FOUND = pa.schema([("doc_key", pa.int64()), ("n_words", pa.int64()), ("ranges", RANGES), ("items", pa.list_(pa.string())), ("spans", RANGES)])
FOUND_SQL = ("doc_key long, n_words long, ranges array<struct<start: long, stop: long>>, items array<string>, "
             "spans array<struct<start: long, stop: long>>")


def _pairs(ranges) -> list[dict]:
    return [{"start": s, "stop": e} for s, e in ranges]


def _scan(sent, keep: list[str]):
    """A pass with one automaton over (doc_key, body, ...) rows; what earlier passes found is merged in."""
    def scan(batches):
        held = sent.value.automaton
        for b in batches:
            texts = b.column("body").to_pylist()
            before = b.select(["ranges", "items"]).to_pylist() if "ranges" in b.schema.names else None
            out = {k: [] for k in FOUND.names[1:]}
            for i, text in enumerate(texts):
                n, ranges, ids = hits(held, text or "")
                if before:
                    ranges = merged([*ranges, *((r["start"], r["stop"]) for r in before[i]["ranges"])])
                    ids = ids.union(before[i]["items"])
                out["n_words"].append(n)
                out["ranges"].append(_pairs(ranges))
                out["items"].append(sorted(ids))
                out["spans"].append(_pairs(original_offsets(text, ranges)))
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in ["doc_key", *keep]} | {
                k: pa.array(v, FOUND.field(k).type) for k, v in out.items()}).select([*FOUND.names, *keep])

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  automaton_bytes: int = AUTOMATON_BYTES, carry: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted as strings), word ranges, spans in the original.

    With ``carry`` the rows' own columns stay in ``body`` and ``rest`` (see ``common.restored``).
    """
    spark = docs.sparkSession
    # a text's windows hold each of its words up to ``window`` times
    shards = max(1, math.ceil(text_bytes(benchmark, item_text) * window * NODE_BYTES / automaton_bytes))
    base = state = carried(docs, id_col, text_col, carry)
    own = [base.schema[k] for k in ("body", "rest") if k in base.columns]
    for k in range(shards):
        part = benchmark.where(F.pmod(F.xxhash64(item_col, item_text), F.lit(shards)) == k) if shards > 1 else benchmark
        sent = spark.sparkContext.broadcast(Windows(gathered(part.select(item_col, item_text).toLocalIterator(), window)))
        last = k == shards - 1
        keep = own if carry or not last else []
        state = state.mapInArrow(_scan(sent, [f.name for f in keep]), StructType([*StructType.fromDDL(FOUND_SQL).fields, *keep]))
        if not last:
            state = written(state, "decontaminate")
            sent.unpersist()
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return state.select(F.col("doc_key").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", "ranges", "spans",
                        *([F.col(f.name) for f in own] if carry else []))


def is_contaminated():
    """The contract's rule: some word is hit, and at least a twentieth of all words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
