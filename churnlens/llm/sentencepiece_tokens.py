"""SentencePiece models on the tokenizers library: rebuild, encode, decode, verify.

The model file (a protobuf) is parsed here; from it come the normaliser (its compiled character map,
the removal of extra spaces, the dummy prefix), the metaspace marker for spaces, the vocabulary with
unigram scores, or for a BPE model the merges that its scores order, and byte fallback. Text is
encoded in batches by the library's threads.

With ``verify`` every text is also encoded and decoded by the sentencepiece library itself, and the
row says whether both agree; the ids and the decoded text are those of the rebuilt tokenizer.

A text is split before each run of markers that follows another character only if no piece of the
vocabulary holds a marker after another character: then no piece can cross such a place, and the
result is that of the whole text. Each worker remembers the ids of a bounded number of such words.

Defined results: null and empty texts have no tokens and decode to an empty text; repeated rows are
encoded one by one; an empty table gives an empty result. Only the id and the text are read, so
other columns play no part.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNIGRAM, BPE = 1, 2  # trainer_spec.model_type
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types
MODEL_BYTES = 64 << 20  # a model is sent to every worker: larger files are refused
BATCH_CHARS = 1 << 20
THREADS = 2
KNOWN_BYTES = 48 << 20  # of runs and their ids in a generation of the table that a worker keeps (it keeps two)
RUNS_TOGETHER = 64  # runs met for the first time that are encoded as one text
RUN_BYTES = 200  # what a run takes beside its characters and ids


def _fields(data: bytes):
    """(number, value) of a protobuf message: integers, 4 or 8 raw bytes, or the bytes of a field."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 2, 5):
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at:at + size]
            at += size
        else:
            raise ValueError(f"not a SentencePiece model: wire type {kind}")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marker: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @property
    def unk_id(self) -> int | None:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)


def parse_model(data: bytes) -> Model:
    """The parts of a ModelProto that decide how a text is encoded."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            m.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            m.kind, m.byte_fallback, m.suffix_marker = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            m.charsmap = spec.get(2, b"")
            m.add_dummy_prefix, m.remove_extra_whitespaces, m.escape_whitespaces = (bool(spec.get(i, 1)) for i in (3, 4, 5))
    if m.kind not in (UNIGRAM, BPE) or m.suffix_marker or not m.escape_whitespaces:
        raise ValueError("only unigram and BPE models with the marker in front of words are rebuilt")
    if any(p[2] == USER_DEFINED for p in m.pieces):
        raise ValueError("models with user-defined pieces are not rebuilt")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, the best-scored piece first."""
    usable = {p for p, _, kind in m.pieces if kind == NORMAL}
    out = []
    for piece, _ in sorted(((p, s) for p, s, kind in m.pieces if kind == NORMAL), key=lambda x: -x[1]):
        out += [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in usable and piece[i:] in usable]
    return out


def build(m: Model):
    """The model as a tokenizers.Tokenizer."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if m.kind == UNIGRAM:
        # only normal pieces may match: the others get names that no text holds, and byte fallback is the codec's
        least = min((s for _, s, kind in m.pieces if kind == NORMAL), default=0.0)
        t = Tokenizer(models.Unigram([(p, s) if kind == NORMAL else (f"\x00{MARK}\x00{i}", least) for i, (p, s, kind) in enumerate(m.pieces)], m.unk_id, False))
    else:
        t = Tokenizer(models.BPE(
            {p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m), fuse_unk=True, byte_fallback=m.byte_fallback,
            unk_token=None if m.unk_id is None else m.pieces[m.unk_id][0]))
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    steps += [normalizers.Prepend(MARK)] * m.add_dummy_prefix + [normalizers.Replace(" ", MARK)]
    t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
                                  + [decoders.Strip(" ", 1, 0)] * m.add_dummy_prefix)
    return t


class _Known:
    """Ids of runs met before: two generations, bounded in bytes.

    Runs are numbered in the order they are first met. Once the young generation is full it becomes the old
    one, and the old one is dropped: a run asked for again in between has moved to the young one by then, so
    frequent runs stay however many rare ones pass.
    """

    def __init__(self, most: int = KNOWN_BYTES) -> None:
        self.most = most
        self.numbers, self.ids, self.sizes, self.bytes = {}, np.zeros(0, np.int32), np.zeros(0, np.int64), 0
        self.old = self.numbers, self.ids, self.sizes

    def age(self) -> None:
        """Called between batches: numbers given within a batch stay valid."""
        if self.bytes > self.most:
            self.old = self.numbers, self.ids, self.sizes
            self.numbers, self.ids, self.sizes, self.bytes = {}, np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    def find(self, runs: list[str], encode) -> np.ndarray:
        """The runs' numbers; those met nowhere yet go to ``encode`` together."""
        out = np.fromiter(map(self.numbers.get, runs, repeat(-1)), np.int64, len(runs))
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out
        new: dict[str, int] = {}
        first = len(self.numbers)
        out[missing] = [new.setdefault(runs[i], first + len(new)) for i in missing.tolist()]
        texts = list(new)
        numbers, ids, sizes = self.old
        before = np.fromiter(map(numbers.get, texts, repeat(-1)), np.int64, len(texts))
        there = before >= 0
        held = np.zeros(len(texts), np.int64)
        held[there] = sizes[before[there]]
        fresh = np.flatnonzero(~there)
        if len(fresh):
            fresh_ids, held[fresh] = encode([texts[i] for i in fresh.tolist()])
        starts = np.cumsum(held) - held
        moved = np.zeros(int(held.sum()), np.int32)
        moved[_flat(starts[there], held[there])] = ids[_flat((np.cumsum(sizes) - sizes)[before[there]], held[there])]
        if len(fresh):
            moved[_flat(starts[fresh], held[fresh])] = fresh_ids
        self.numbers.update(new)
        self.ids, self.sizes = np.concatenate((self.ids, moved)), np.concatenate((self.sizes, held))
        self.bytes += RUN_BYTES * len(texts) + 2 * sum(map(len, texts)) + 4 * len(moved)
        return out


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... (sizes[i] of them) one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Codec:
    """Encodes and decodes batches of texts with a rebuilt tokenizer, as Arrow arrays.

    Where no piece can cross into a run of markers, a text is encoded run by run: those not met
    before go to the library in one multithreaded batch, and their ids are remembered.
    """

    RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def __init__(self, m: Model) -> None:
        self.tokenizer = build(m)
        self.normalizer = self.tokenizer.normalizer
        self.plain = not m.charsmap and not m.remove_extra_whitespaces
        self.prefix = MARK if m.add_dummy_prefix else ""
        self.trim = m.remove_extra_whitespaces
        self.tokenizer.normalizer = None
        self.bytes_of_unknown = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE} if m.kind == UNIGRAM and m.byte_fallback else {}
        self.unk_id = m.unk_id
        self.by_run = not any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind == NORMAL)
        pieces = [b"" if kind == CONTROL else " \u2047 ".encode() if kind == UNKNOWN else bytes([int(p[3:5], 16)]) if kind == BYTE
                  else p.replace(MARK, " ").encode() for p, _, kind in m.pieces]
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_sizes = np.array([len(p) for p in pieces], np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.begins = np.array([kind == NORMAL and p.startswith(MARK) for p, _, kind in m.pieces], bool)
        self.joins = not self.bytes_of_unknown
        self.known = _Known()

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each)."""
        if self.bytes_of_unknown:
            ids = [self._with_bytes(t, e) if self.unk_id in e.ids else e.ids
                   for t, e in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True)]
        else:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes

    def _encoded_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs. Runs with one marker are put together to longer texts: no piece crosses into a
        marker, so a text's pieces that begin with one tell where its runs begin."""
        alone = np.array([r[0] != MARK or MARK in r[1:] for r in runs], bool) | (not self.joins)
        sizes, ids = np.zeros(len(runs), np.int64), [np.zeros(0, np.int32)] * 2
        single, joined = np.flatnonzero(alone), np.flatnonzero(~alone)
        if len(joined):
            groups = ["".join(runs[i] for i in joined[at:at + RUNS_TOGETHER].tolist()) for at in range(0, len(joined), RUNS_TOGETHER)]
            ids[0], _ = self._encoded(groups)
            begins = np.flatnonzero(self.begins[ids[0]])
            if len(begins) != len(joined):  # a marker that the model doesn't know: one by one
                return self._encoded(runs)
            sizes[joined] = np.diff(np.append(begins, len(ids[0])))
        if len(single):
            ids[1], sizes[single] = self._encoded([runs[i] for i in single.tolist()])
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        for which, own in ((joined, ids[0]), (single, ids[1])):
            out[_flat(starts[which], sizes[which])] = own
        return out, sizes

    def _with_bytes(self, text: str, encoded) -> list[int]:
        """Ids with the UTF-8 bytes' pieces in the place of unknown characters."""
        out: list[int] = []
        for i, (s, e) in zip(encoded.ids, encoded.offsets, strict=True):
            out += [self.bytes_of_unknown[b] for b in text[s:e].encode()] if i == self.unk_id else [i]
        return out

    def _normal(self, text: str) -> str:
        if not text:
            return ""
        line = self.prefix + text.replace(" ", MARK) if self.plain else self.normalizer.normalize_str(text)
        return line.rstrip(MARK) if self.trim else line  # a marker in the text itself counts as a space

    def _words(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct runs, their numbers in the order of the texts, runs of each text), of words between single spaces."""
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        places = words.flatten().dictionary_encode()
        marked = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), places.dictionary, pa.scalar("", pa.large_string()))
        return marked.to_numpy(zero_copy_only=False).tolist(), places.indices.to_numpy(), np.diff(words.offsets.to_numpy())

    def _runs(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The same, of any texts."""
        lists = [self.RUN.findall(self._normal(t)) if t else [] for t in texts]
        numbers: dict[str, int] = {}
        places = [numbers.setdefault(r, len(numbers)) for runs in lists for r in runs]
        return list(numbers), np.array(places, np.int64), np.array([len(x) for x in lists], np.int64)

    def encode(self, texts: list[str]) -> pa.ListArray:
        if not self.by_run:
            return _lists(*self._encoded([self._normal(t) for t in texts]))
        self.known.age()
        single = np.array([bool(t) and t[0] != " " and t[-1] != " " and "  " not in t and MARK not in t for t in texts], bool)
        single &= self.plain and bool(self.prefix)
        order = np.concatenate((np.flatnonzero(single), np.flatnonzero(~single)))
        runs, counts = [], []
        for part, cut in ((self._words, order[:single.sum()]), (self._runs, order[single.sum():])):
            if len(cut):
                distinct, places, each = part([texts[i] for i in cut.tolist()])
                runs.append(self.known.find(distinct, self._encoded_runs)[places])
                counts.append(each)
        runs, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (runs, counts))
        starts, sizes = np.cumsum(self.known.sizes) - self.known.sizes, self.known.sizes[runs]
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        edge = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
        ids = _lists(self.known.ids[_flat(starts[runs], sizes)], np.diff(total[edge]))
        return ids if single.all() or not single.any() else ids.take(pa.array(np.argsort(order)))

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """Pieces joined, byte pieces as UTF-8, without the space of the dummy prefix."""
        flat, edge = ids.values.to_numpy(), ids.offsets.to_numpy().astype(np.int64)
        sizes = self.piece_sizes[flat]
        data = self.piece_bytes[_flat(self.piece_starts[flat], sizes)]
        at = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))[edge]
        starts, stops = at[:-1], at[1:]
        if self.prefix:
            padded = np.append(data, 0)
            starts = starts + ((starts < stops) & (padded[starts] == 32))
        raw = data.tobytes()
        return pa.array([raw[s:e].decode(errors="replace") for s, e in zip(starts.tolist(), stops.tolist(), strict=True)], pa.string())


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    edge = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(ids, pa.int32()))


def agreement(ids: pa.ListArray, decoded: pa.StringArray, own_ids: list[list[int]], own_texts: list[str]) -> pa.BooleanArray:
    """Of each text, whether both libraries gave the same ids and the same text back."""
    sizes = np.array([len(x) for x in own_ids], np.int64)
    flat = np.fromiter(chain.from_iterable(own_ids), np.int32, int(sizes.sum()))
    edge = ids.offsets.to_numpy().astype(np.int64)
    if np.array_equal(np.diff(edge), sizes) and np.array_equal(ids.values.to_numpy(), flat):
        same = np.ones(len(sizes), bool)
    else:
        same = np.array([x == y for x, y in zip(ids.to_pylist(), own_ids, strict=True)])
    return pc.and_(pa.array(same), pc.equal(decoded, pa.array(own_texts, pa.string())))


def _parts(texts: list[str]):
    """Runs of texts of about a MB together: one call to the library each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


@lru_cache(1)
def _libraries(model: bytes):
    """The rebuilt codec and the sentencepiece library's own: kept by a worker from task to task."""
    from sentencepiece import SentencePieceProcessor

    return Codec(parse_model(model)), SentencePieceProcessor(model_proto=model)


OUT_SQL = "doc_key long, ids array<int>, decoded string, same boolean"


def read_model(path: str) -> bytes:
    if os.path.getsize(path) > MODEL_BYTES:
        raise ValueError(f"{path} is over {MODEL_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text",
           verify: bool = True, threads: int = THREADS) -> DataFrame:
    """One row per document: id, ids, decoded text, same (both libraries agree on ids and text; null if not verified)."""
    parse_model(model)  # a model that can't be rebuilt fails here, not in a task
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        codec, own = _libraries(sent.value)
        for b in batches:
            done, texts = 0, [t or "" for t in b.column(1).to_pylist()]
            for part in _parts(texts):
                ids = codec.encode(part)
                decoded = codec.decode(ids)
                same = pa.nulls(len(part), pa.bool_())
                if verify:
                    exact = own.encode(part, num_threads=threads)
                    same = agreement(ids, decoded, exact, own.decode(exact, num_threads=threads))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(part)), ids, decoded, same], ["doc_key", "ids", "decoded", "same"])
                done += len(part)

    return docs.select(F.col(id_col).cast("long").alias("doc_key"), text_col).mapInArrow(run, OUT_SQL).withColumnRenamed("doc_key", id_col)
