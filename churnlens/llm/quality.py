"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text that resembles the good sample compresses better with the good dictionary. Each piece of a
text is compressed with both; (bad size - good size) / larger size is its normalised difference.
The mean and the least difference of the pieces, the share of pieces nearer to the bad dictionary,
and the least plain compression ratio (text that repeats itself leaves no difference to see) go
through a logistic curve fitted on labelled documents that aren't in the dictionaries.

Training uses a bounded sample of whole labelled documents: at most ``per_class`` of each label and
``sample_chars`` characters of them, in the order of their ids' hash (a text longer than ``sample_chars`` isn't
used); half of them make the dictionaries, each whole, in pieces, half the curve. Every document is scored
whole, piece by piece.

Defined results: null and empty texts are one empty piece and get that piece's score; repeated rows
are scored one by one; without labels of both classes, or with too little text for a dictionary, the
score is the share of good labels (0 if there are none); an empty table gives an empty result. Only
the id and the text are read, so other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.labelled import labelled_sample, logistic

PER_CLASS = (3000, 2000)  # good and bad documents in the sample, at most
SAMPLE_CHARS = (10_000_000, 7_000_000)  # of good and bad texts in the sample, at most
DICT_BYTES = 112 << 10
DICT_PIECE = 8192  # bytes of the pieces that a dictionary is trained on
PIECE = 1024
LEVEL = 3


class Compressors:
    """The good, the bad and no dictionary at one level, with no frame extras."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        extras = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.good, self.bad = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **extras) for d in (good, bad))
        self.plain = zstandard.ZstdCompressor(**extras)

    def evidence(self, text: str) -> list[float]:
        """[mean difference, least difference, share of bad pieces, least plain ratio]."""
        raw = text.encode()
        out = []
        for i in range(0, max(1, len(raw)), PIECE):
            piece = raw[i:i + PIECE]
            if i and len(piece) < PIECE // 16:
                piece = raw[i - PIECE // 2:]  # a short rest is judged with what stands before it
            g, b, n = (len(c.compress(piece)) for c in (self.good, self.bad, self.plain))
            out.append(((b - g) / max(g, b), n / max(1, len(piece))))
        diff, ratio = np.array(out).T
        return [diff.mean(), diff.min(), (diff < 0).mean(), ratio.min()]


def dict_pieces(text: str) -> list[bytes]:
    """The whole text in consecutive pieces."""
    raw = text.encode()
    return [raw[i:i + DICT_PIECE] for i in range(0, max(1, len(raw)), DICT_PIECE)]


class Model:
    """Dictionaries and curve; ``share`` alone if there was too little to train on."""

    def __init__(self, texts: list[tuple[str, int]]) -> None:
        self.share = sum(y for _, y in texts) / max(1, len(texts))
        self.dicts = None
        by = [list(dict.fromkeys(t for t, y in texts if y == want)) for want in (1, 0)]
        try:
            dicts = [zstandard.train_dictionary(DICT_BYTES, [p for t in x[::2] for p in dict_pieces(t)]).as_bytes() for x in by]
        except (zstandard.ZstdError, ValueError):  # too few samples, or too little in them
            return
        rest = [(t, y) for x, y in zip(by, (1, 0), strict=True) for t in x[1::2]]
        c = Compressors(*dicts)
        x, y = np.array([c.evidence(t) for t, _ in rest]), np.array([y for _, y in rest], float)
        if 0 < y.mean() < 1:
            self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
            self.curve, self.dicts = logistic((x - self.mean) / self.spread, y), dicts

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + (x - self.mean) / self.spread @ self.curve[1:], -30, 30)))


SCORED = pa.schema([("doc_key", pa.int64()), ("score", pa.float64()), ("difference", pa.float64())])


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
            per_class: tuple[int, int] = PER_CLASS, train_docs: DataFrame | None = None,
            sample_chars: tuple[int, int] = SAMPLE_CHARS) -> DataFrame:
    """One row per document: id, score (0 to 1), difference (mean normalised difference, null without dictionaries)."""
    model = Model(labelled_sample(docs if train_docs is None else train_docs, labels, id_col, text_col, label_col, per_class, sample_chars))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries

    def run(batches):
        model = sent.value
        c = Compressors(*model.dicts) if model.dicts else None
        for b in batches:
            n = b.num_rows
            score, diff = np.full(n, model.share), [None] * n
            if c and n:
                x = np.array([c.evidence(t or "") for t in b.column(1).to_pylist()])
                score, diff = model.score(x), x[:, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(diff, pa.float64())], schema=SCORED)

    return docs.select(F.col(id_col).cast("long").alias("doc_key"), text_col).mapInArrow(
        run, "doc_key long, score double, difference double").withColumnRenamed("doc_key", id_col)
