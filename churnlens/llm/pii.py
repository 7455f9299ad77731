"""Personal data: exact base patterns, and a linear-chain CRF over word shapes that adds spans.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of their patterns that
pass their check; they always stay. The CRF, trained from a small labelled table (``pii_labels``, or
one of one's own), tags the words of a line by their shapes and those of their neighbours, decoded
by Viterbi for many lines at once in numpy. Runs of words with one tag that touch no base span are
added; the CRF also knows the kind ``secret``.

Words made of letters and punctuation have one shape and look at no cue, so a line without any of
``0-9 @ = +`` is the same item over and over. If under the trained weights staying outside is then
the best step everywhere (``plain_lines_are_empty``), such lines are decoded without being looked at;
if not, every line is.

Defined results: null and empty texts have no spans; repeated rows are searched one by one; an empty
table gives an empty result. Only the id and the text are read, so other columns play no part.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import crf
from churnlens.llm.pii_labels import KINDS, labelled_lines

STATES = ["", *KINDS]
GROUP_WORDS = 100_000  # words decoded side by side

# fixed values: the contract's patterns
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a run of digits is entered at its start only
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str):
    """Matches of ``[A-Za-z0-9._%+-]+@`` and a domain, from each @ outwards: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        m, start = DOMAIN.match(text, at + 1), at
        while m and start > done and text[start - 1] in LOCAL:
            start -= 1
        if m and start < at:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    ds = [int(c) for c in reversed(digits)]
    return (sum(ds[::2]) + sum(d * 2 - 9 * (d > 4) for d in ds[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = NO_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NO_DIGIT.sub("", m.group())) <= 15]
    return out


WORD = re.compile(r"\S+")
MARKED = re.compile(r"[0-9@=+]")
_SHAPE = [(re.compile(r"[0-9]"), "9"), (re.compile(r"[a-z]"), "a"), (re.compile(r"[^\W\d_a-z]"), "A")]
_LONG = re.compile(r"(.)\1{4,}")
HEX = re.compile(r"[^0-9A-Za-z]*(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{12,}[^0-9A-Za-z]*")


def shape(word: str) -> str:
    """Digits 9, lower case a, other letters A; runs over four are marked by their length's bits."""
    for rx, c in _SHAPE:
        word = rx.sub(c, word)
    return _LONG.sub(lambda m: f"{m.group(1)}{{{len(m.group()).bit_length()}}}", word)[:40]


def own_features(word: str) -> list[str]:
    if not MARKED.search(word):
        return ["plain"]
    core = word.strip(".,;:!?\"'")
    digits = sum(c.isdigit() for c in core)
    kinds = re.sub(r"(.)\1+", r"\1", re.sub(r"\{\d+\}", "", shape(core)))
    out = ["marked", f"shape={shape(core)}", f"kinds={kinds[:20]}", f"digits={min(digits, 20)}", f"size={min(len(core), 63).bit_length()}",
           f"head={core[:1] if not core[:1].isalnum() else shape(core[:1])}"]
    return out + ["hex"] * bool(HEX.fullmatch(word)) + [f"sign={c}" for c in "@=+" if c in core] + [f"key={core.partition('=')[0].lower()}"] * ("=" in core)


def near_features(word: str, other: str | None, side: str) -> list[str]:
    """Of a marked word: what stands beside it. Of a plain one: only that a marked word does."""
    if other is None or not MARKED.search(other):
        if not MARKED.search(word):
            return []
        return [f"{side}={'' if other is None else other.lower().strip('.,;:')}"]
    if not MARKED.search(word):
        return [f"{side}:beside"]
    return [f"{side}:shape={shape(other.strip('.,;:'))}", f"{side}:marked"]


def features(words: list[str], i: int) -> list[str]:
    return (own_features(words[i]) + near_features(words[i], words[i - 1] if i else None, "before")
            + near_features(words[i], words[i + 1] if i + 1 < len(words) else None, "after"))


def train(lines: list[list[tuple[str, str]]]) -> crf.Crf:
    kinds = [features([w for w, _ in line], i) for line in lines for i in range(len(line))]
    gold = [STATES.index(k) for line in lines for _, k in line]
    return crf.train(kinds, np.arange(len(kinds)), [len(x) for x in lines], np.array(gold), len(STATES), rounds=120, l2=0.02)


def plain_lines_are_empty(model: crf.Crf) -> bool:
    """Whether "outside" is the best first and the best next step of a line of plain words."""
    e = model.emission(["plain"])
    first, step = model.start + e, model.trans + e
    return bool(first.argmax() == 0 and step.argmax() == 0)


class Finder:
    def __init__(self, model: crf.Crf) -> None:
        self.model = model
        self.skip = plain_lines_are_empty(model)
        self.own = lru_cache(50_000)(lambda w: model.emission(own_features(w)))
        self.near = lru_cache(50_000)(lambda w, o, side: model.emission(near_features(w, o, side)))

    def _lines(self, text: str):
        """(start, end) of the lines to decode."""
        at = 0
        while at < len(text):
            if self.skip:
                m = MARKED.search(text, at)
                if not m:
                    return
                at = text.rfind("\n", at, m.start()) + 1 or at
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            yield at, end
            at = end + 1

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
        """(kind, start, end, base) of each text, by kind, then start."""
        out, held, size = [], [], 0
        for t in texts:
            lines = [[(m.group(), m.start(), m.end()) for m in WORD.finditer(t, s, e)] for s, e in self._lines(t)]
            held.append((base_spans(t), lines))
            size += sum(map(len, lines))
            if size > GROUP_WORDS:
                out += self._decode(held)
                held, size = [], 0
        return out + self._decode(held)

    def _decode(self, held) -> list[list[tuple[str, int, int, bool]]]:
        e, lengths = [], []
        for _, lines in held:
            for line in lines:
                words = [w for w, _, _ in line]
                lengths.append(len(words))
                for i, w in enumerate(words):
                    e.append(self.own(w) + self.near(w, words[i - 1] if i else None, "before")
                             + self.near(w, words[i + 1] if i + 1 < len(words) else None, "after"))
        path = crf.viterbi(np.array(e).reshape(-1, len(STATES)), lengths, self.model.trans, self.model.start)
        at, out = 0, []
        for base, lines in held:
            added = []
            for line in lines:
                tags = path[at:at + len(line)].tolist()
                at += len(line)
                added += _runs(line, tags)
            spans = [(*s, True) for s in base]
            spans += [(*s, False) for s in added if not any(s[1] < e and b < s[2] for _, b, e in base)]
            out.append(sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))
        return out


def _runs(line, tags):
    """(kind, start, end) of runs of one tag, without punctuation at the ends."""
    i = 0
    while i < len(line):
        j = i + 1
        if tags[i]:
            while j < len(line) and tags[j] == tags[i]:
                j += 1
            first, last = line[i][0], line[j - 1][0]
            start = line[i][1] + len(first) - len(first.lstrip(".,;:!?\"'"))
            end = line[j - 1][2] - (len(last) - len(last.rstrip(".,;:!?\"'")))
            if start < end:
                yield STATES[tags[i]], start, end
        i = j


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             labelled: list[list[tuple[str, str]]] | None = None) -> DataFrame:
    """One row per document: id, spans (kind, start, stop in code points, base)."""
    sent = docs.sparkSession.sparkContext.broadcast(train(labelled_lines() if labelled is None else labelled))

    def run(batches):
        finder = Finder(sent.value)
        for b in batches:
            found = finder.spans([t or "" for t in b.column(1).to_pylist()])
            spans = [[{"kind": k, "start": s, "stop": e, "base": x} for k, s, e, x in doc] for doc in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(SPAN))], ["doc_key", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_key"), text_col).mapInArrow(
        run, "doc_key long, spans array<struct<kind: string, start: long, stop: long, base: boolean>>").withColumnRenamed("doc_key", id_col)


def joined(spans):
    """``kind:start:stop`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
