"""Toxicity: a linear-chain CRF tags toxic words; forward-backward marginals give scores and spans.

Training, on a bounded sample of whole labelled documents (``per_class`` and ``sample_chars`` of each label,
in the order of their ids' hash, so the same at every run; a text longer than ``sample_chars`` isn't used):

1. near copies in the sample are left out, so that a copied text counts once;
2. words of toxic documents are labelled toxic if one of their features (the word, its first three
   to eight letters) is bound to toxic documents: a likelihood ratio beyond what the best of so many
   features would reach by chance, or, for documents still without such a word, the feature that
   accounts for most of them;
3. the CRF is trained on two thirds of these documents, ``fit_per_class`` at most, with such token labels;
4. on those held back, ``curve_per_class`` at most, a logistic curve turns a document's evidence into a
   probability.

A document's evidence is the log odds of its surest toxic word and how many toxic words are
expected. Words are what white space separates, all of them, in one chain per document.

Defined results: null, empty and wordless texts get the score of no evidence and have no spans;
repeated rows are scored one by one; documents, not labels, decide the rows; without labels of both
classes the score is the share of toxic labels (0 if there are none); an empty table gives an empty
result. Only the id and the text are read, so other columns play no part.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from churnlens.llm import crf
from churnlens.llm.common import carried, with_rest
from churnlens.llm.labelled import labelled_sample, logistic

PER_CLASS = (1500, 3000)  # toxic and clean documents in the sample, at most
SAMPLE_CHARS = (6_000_000, 10_000_000)  # of toxic and clean texts in the sample, at most
FIT_PER_CLASS = (600, 400)  # of these, the CRF is trained on so many clean and toxic ones
CURVE_PER_CLASS = 1000  # and the curve on so many of each label
GROUP_WORDS = 100_000  # words whose chains are swept together
KNOWN_WORDS = 150_000  # words whose emissions a worker remembers
WORD = re.compile(r"\S+")
BEGINNINGS = 7  # of a word's features, so many are the word and its beginnings
EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
LEAST_WEIGHT = 0.2  # features that move the log odds less aren't sent to the workers
LEAST_RATIO = 7.5  # how many times the share of clean documents a feature's share of toxic ones must be
LEAST = 0.5  # a word is toxic from this marginal on


def word_features(word: str) -> list[str]:
    w = word.strip(EDGES).lower()
    shape = "a" if w.isalpha() else "-"
    return ["w=" + w, "8=" + w[:8], "7=" + w[:7], "6=" + w[:6], "5=" + w[:5], "4=" + w[:4], "3=" + w[:3], "e=" + w[-3:], "s=" + shape]


def _signatures(words: list[str]) -> set[int]:
    """Least hashes of the runs of three words: near copies have at least one in common, others hardly ever."""
    runs = {" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
    return {min(xxhash.xxh3_64_intdigest(r, seed) for r in runs) for seed in range(4)} if runs else set()


def _ratio(p: int, n: int, pos: int, neg: int) -> float:
    """Log likelihood ratio of a feature in p of pos toxic and n of neg clean documents."""
    def term(k, total, rate):
        return k * math.log(k / (total * rate)) if k else 0.0

    rate = (p + n) / (pos + neg)
    return 2 * (term(p, pos, rate) + term(n, neg, rate) + term(pos - p, pos, 1 - rate) + term(neg - n, neg, 1 - rate))


def toxic_features(docs: list[tuple[list[str], int]]) -> set[str]:
    """Features (words and word beginnings) bound to toxic documents.

    The purest come first; a feature is judged by those of its words that no earlier one covers, so
    that a short beginning isn't taken for the sake of one toxic word.
    """
    pos = sum(y for _, y in docs)
    neg = len(docs) - pos
    held: dict[str, list[int]] = {}  # toxic documents of each word
    for i, (words, y) in enumerate(docs):
        for w in set(words) if y else ():
            held.setdefault(w, []).append(i)
    # features of at least three toxic documents; most are in one
    met, often = {}, set()
    for w, where in held.items():
        for f in word_features(w)[:BEGINNINGS]:
            if len(f) > 4 and f not in often:
                met[f] = seen = met.get(f, 0) + len(where)
                if seen >= 3:
                    often.add(f)
    del met
    of_feature: dict[str, list[str]] = {f: [] for f in often}
    for w in held:
        for f in word_features(w)[:BEGINNINGS]:
            if f in often:
                of_feature[f].append(w)
    toxic = {f: len(set().union(*(held[w] for w in ws))) for f, ws in of_feature.items()}
    clean = dict.fromkeys(often, 0)
    for words, y in docs:
        if not y:
            for f in {f for w in set(words) for f in word_features(w)[:BEGINNINGS] if f in often}:
                clean[f] += 1

    def purity(p: int, n: int) -> float:
        return (p / pos) / (max(n, 0.5) / neg)

    order = [(purity(p, clean[f]), len(f), f) for f, p in toxic.items() if p >= 3]
    chance, chosen, covered, weak = 2 * math.log(max(2, len(toxic))) + 8, set(), set(), []
    for _, _, f in sorted((x for x in order if x[0] >= LEAST_RATIO), reverse=True):
        left = [w for w in of_feature[f] if w not in covered]
        p, n = len(set().union(*(held[w] for w in left))), clean[f]
        if p >= 3 and purity(p, n) >= LEAST_RATIO:
            if _ratio(p, n, pos, neg) >= chance:
                chosen.add(f)
                covered.update(left)
            else:
                weak.append(f)
    known = set().union(*(held[w] for w in covered))
    for f in weak:  # for toxic documents without a toxic word so far
        found = set().union(*(held[w] for w in of_feature[f] if w not in covered)) - known
        if len(found) >= 3:
            chosen.add(f)
            covered.update(of_feature[f])
            known |= found
    return chosen


class Scorer:
    """Evidence and spans of documents under a trained model."""

    def __init__(self, model: crf.Crf) -> None:
        self.model = model
        # of two states only the difference counts
        self.weight = dict(zip(model.features, (model.weights[:, 1] - model.weights[:, 0]).tolist(), strict=True))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.odds = np.zeros(0)

    def _kinds(self, words: list[str]) -> np.ndarray:
        get, known = self.weight.get, self.known
        new = [w for w in set(words) if w not in known]
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        self.odds = np.append(self.odds, [sum(get(f, 0.0) for f in word_features(w)) for w in new])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _group(self, docs: list[list[str]]) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
        kinds = self._kinds(list(chain.from_iterable(docs)))
        lengths = [len(d) for d in docs]
        odds = self.odds[kinds]
        p = crf.marginals(np.column_stack([np.zeros(len(odds)), odds]), lengths, self.model.trans, self.model.start)[:, 1]
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        out, at = [], 0
        for n in lengths:
            own = p[at:at + n]
            at += n
            which = np.flatnonzero(own >= LEAST)
            out.append((float(own.max(initial=0.0)), float(own[own > 0.1].sum()), which, own[which]))
        return out

    def evidence(self, texts: list[str]):
        """(surest marginal, expected toxic words, numbers and marginals of toxic words) of each text."""
        docs, size = [], 0
        for t in texts:
            docs.append(t.split())
            size += len(docs[-1])
            if size >= GROUP_WORDS:
                yield from self._group(docs)
                docs, size = [], 0
        if docs:
            yield from self._group(docs)

    def score(self, surest: float, expected: float) -> float:
        c = self.model.extra["curve"]
        return float(1 / (1 + np.exp(-(c[0] + c[1] * _logit(surest) + c[2] * math.log1p(expected)))))


def _logit(p) -> float:
    return float(np.clip(np.log(max(p, 1e-9)) - np.log(max(1 - p, 1e-9)), -12, 12))


def train(texts: list[tuple[str, int]], fit_per_class: tuple[int, int] = FIT_PER_CLASS, curve_per_class: int = CURVE_PER_CLASS) -> crf.Crf | None:
    """The model from labelled texts; None if one of the classes is missing."""
    seen, docs = (set(), set()), []
    for text, y in texts:
        words = text.split()
        marks = _signatures(words)
        if marks.isdisjoint(seen[y]):
            docs.append((words, y, text))
        seen[y].update(marks)
    if len({y for _, y, _ in docs}) < 2:
        return None
    bound = toxic_features([(w, y) for w, y, _ in docs])
    by = [[d for d in docs if d[1] == y] for y in (0, 1)]
    cut = [min(most, -(-len(x) * 2 // 3)) for x, most in zip(by, fit_per_class, strict=True)]
    fit = [d for x, c in zip(by, cut, strict=True) for d in x[:c]]
    kinds, names = {}, []
    items, gold, lengths = [], [], []
    for words, y, _ in fit:
        lengths.append(len(words))
        for w in words:
            k = kinds.get(w)
            if k is None:
                k = kinds[w] = len(names)
                names.append(word_features(w))
            items.append(k)
            gold.append(y and not bound.isdisjoint(names[k]))
    model = crf.train(names, np.array(items, np.int64), lengths, np.array(gold, np.int64), 2, rounds=40, min_count=4)
    heavy = {n: i for n, i in model.features.items() if abs(model.weights[i, 1] - model.weights[i, 0]) > LEAST_WEIGHT}
    model.weights, model.features = model.weights[list(heavy.values())], {n: i for i, n in enumerate(heavy)}
    back = [d for x, c in zip(by, cut, strict=True) for d in (x[c:c + curve_per_class] or x)]
    found = list(Scorer(model).evidence([t for _, _, t in back]))
    x = np.array([[_logit(a), math.log1p(b)] for a, b, _, _ in found])
    model.extra["curve"] = logistic(x, np.array([y for _, y, _ in back], float))
    return model


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             per_class: tuple[int, int] = PER_CLASS, train_docs: DataFrame | None = None, carry: bool = False,
             sample_chars: tuple[int, int] = SAMPLE_CHARS, fit_per_class: tuple[int, int] = FIT_PER_CLASS,
             curve_per_class: int = CURVE_PER_CLASS) -> DataFrame:
    """One row per document: id, score (0 to 1), spans (code points and marginal of each toxic word).

    ``train_docs``: the table that has the labelled texts, if not ``docs``. With ``carry`` the rows'
    own columns stay in ``body`` and ``rest`` (see ``common.restored``).
    """
    texts = labelled_sample(docs if train_docs is None else train_docs, labels, id_col, text_col, label_col, per_class, sample_chars)
    model, share = train(texts, fit_per_class, curve_per_class), sum(y for _, y in texts) / max(1, len(texts))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        # a worker keeps the scorer, and the words it knows, with the model from task to task
        scorer = sent.value and (sent.value.extra.get("scorer") or sent.value.extra.setdefault("scorer", Scorer(sent.value)))
        for b in batches:
            texts = [t or "" for t in b.column("body").to_pylist()]
            if scorer is None:
                scores, spans = [share] * len(texts), [[] for _ in texts]
            else:
                scores, spans = [], []
                for text, (surest, expected, which, p) in zip(texts, scorer.evidence(texts), strict=True):
                    scores.append(scorer.score(surest, expected))
                    places = [m.span() for m in WORD.finditer(text)] if len(which) else []
                    spans.append([{"start": places[i][0], "stop": places[i][1], "p": float(q)} for i, q in zip(which.tolist(), p, strict=True)])
            own = {"body": b.column("body"), "rest": b.column("rest")} if b.num_columns > 2 else {}
            yield pa.RecordBatch.from_pydict({"doc_key": b.column("doc_key"), "score": pa.array(scores, pa.float64()), "spans": pa.array(spans, SPANS)} | own)

    base = carried(docs, id_col, text_col, carry)
    ddl = "doc_key long, score double, spans array<struct<start: long, stop: long, p: double>>"
    return base.mapInArrow(run, with_rest(ddl, base)).withColumnRenamed("doc_key", id_col)
