"""HTML main-text extraction: a linear-chain CRF over a page's leaf blocks, decoded by Viterbi.

A page is parsed into leaf blocks: runs of text between the starts and ends of block tags, each with
the tags, classes and ids that it stands in. Features of a block are its ancestors (tag names, the
words of classes and ids, the nearest block tag) and its text (length, share of link text, how it
ends). Two states, main text or not, form a chain in page order; the model is trained on labelled
pages (``html_labels``, or a table of one's own with marked main blocks).

Character references are decoded, white space in a block becomes one space, blocks are joined by
one line feed. What is no text of the page (head, script, style, comments, templates) isn't read. A
head that isn't closed ends where HTML ends it: before the first tag, or text that isn't blank, that
can't stand in a head. Formulas belong to the block they stand in; the text of drawings (svg), and
what stands in object, iframe and noscript, are blocks like others, left to the CRF.

Defined results: null or empty html, or a page without main text: empty text; broken markup is read
as far as it goes; repeated rows are extracted one by one; an empty table gives an empty result.
Only the named columns are read, so others play no part.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import crf
from churnlens.llm.html_labels import MARK, labelled_pages

# fixed values: HTML's element kinds
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr tspan textpath "
                   "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mpadded "
                   "mphantom menclose mfenced merror mtable mtr mtd mlabeledtr mmultiscripts mprescripts none semantics annotation "
                   "annotation-xml maction maligngroup malignmark".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("head script style template title".split())  # an svg's title isn't the head's and is read
IN_HEAD = frozenset("head html base basefont bgsound link meta noframes noscript script style template title".split())
FOREIGN = ("svg", "math")
PHRASE = ("svg", "object", "iframe")  # blocks that close no paragraph
APART = ("mtd", "annotation", "annotation-xml")  # inline, with a space before and after
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "optgroup": {"option", "optgroup"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
         "option": {"select"}, "optgroup": {"select"}}
NAME = re.compile(r"[a-z]+")
GROUP_BLOCKS = 50_000  # blocks decoded side by side


class Blocks(HTMLParser):
    """Leaf blocks of a page: (text, ancestors as (tag, names), characters in links)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.unread = self.heads = self.svgs = self.links = 0
        self.parts: list[str] = []
        self.link_chars = 0
        self.blocks: list[tuple[str, tuple, int]] = []

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((text, tuple(x for x in self.stack if x[0] not in INLINE), self.link_chars))
            self.parts, self.link_chars = [], 0

    def _pop(self, at: int) -> None:
        for tag, _ in self.stack[at:]:
            self.unread -= tag in UNREAD
            self.heads -= tag == "head"
            self.svgs -= tag == "svg"
            self.links -= tag == "a"
        del self.stack[at:]

    def end_head(self) -> None:
        """Ends an open head, unless something else unread (its title, a script) is still open."""
        if self.heads and self.heads == self.unread:
            self.stack = [x for x in self.stack if x[0] != "head"]
            self.unread = self.heads = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag not in IN_HEAD:
            self.end_head()
        if tag == "title" and self.svgs:
            tag = "svg:title"
        if tag in ("br", "wbr"):
            self.parts.append(" " if tag == "br" else "")
            return
        block = tag not in INLINE
        if block:
            self.end_block()
            if tag == "body":  # whatever is still open of a head ends here
                self._pop(next((i for i, x in enumerate(self.stack) if x[0] in ("head", "noscript")), len(self.stack)))
            ends = CLOSED_BY.get(tag, ())
            for i in range(len(self.stack) - 1, -1, -1):
                at = self.stack[i][0]
                if at in ends or at == "p" and tag != "p" and not ends and tag not in PHRASE or at == tag == "p":
                    self._pop(i)
                    if at not in ends or tag not in ("tr", "dt", "dd"):
                        break
                elif at in SCOPE.get(tag, ()) or not ends and at not in INLINE:
                    break
        if tag in VOID:
            return
        if tag in APART:
            self.parts.append(" ")
        names = " ".join(f"{v}" for k, v in attrs if k in ("class", "id", "role", "itemprop") and v).lower() if block else ""
        self.stack.append((tag, names))
        self.unread += tag in UNREAD
        self.heads += tag == "head"
        self.svgs += tag == "svg"
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag in ("svg", "math", "iframe", "object") or any(x[0] in FOREIGN for x in self.stack)):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in APART:
            self.parts.append(" ")
        if tag == "title" and self.svgs:
            tag = "svg:title"
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is None:
            return
        if tag not in INLINE:
            self.end_block()
        elif any(x[0] not in INLINE for x in self.stack[at + 1:]):
            return  # an inline end tag closes no block
        self._pop(at)

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA[") and any(x[0] in FOREIGN for x in self.stack):
            self.handle_data(data.removeprefix("CDATA["))

    def handle_data(self, data: str) -> None:
        if self.heads and data.strip(" \t\n\f\r"):
            self.end_head()
        if not self.unread:
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data)


def leaf_blocks(html: str) -> list[tuple[str, tuple, int]]:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.end_block()
    return parser.blocks


def place_features(ancestors: tuple) -> list[str]:
    tags = [t for t, _ in ancestors if t not in ("html", "body")]
    words = {w for _, names in ancestors for w in NAME.findall(names)}
    near = tags[-1] if tags else "-"
    return ["bias", f"near={near}", f"pair={'/'.join(tags[-2:])}", f"depth={min(len(tags), 6)}",
            *sorted({f"in={t}" for t in tags}), *sorted(f"name={w}" for w in words)]


def text_features(text: str, link_chars: int) -> tuple[str, ...]:
    n = len(text)
    return (f"size={min(n, 2000).bit_length()}", f"links={min(4, 5 * link_chars // max(1, n))}",
            f"end={text[-1] if text[-1] in '.!?:|' else 'w' if text[-1].isalnum() else '-'}",
            f"mark={'c' if '©' in text else '-'}{'p' if '|' in text or '»' in text else '-'}")


class Extractor:
    def __init__(self, model: crf.Crf) -> None:
        self.model = model
        self.place = lru_cache(50_000)(lambda ancestors: model.emission(place_features(ancestors)))
        self.text = lru_cache(50_000)(model.emission)

    def pages(self, htmls: list[str]) -> list[list[str]]:
        """The main blocks of each page."""
        out, held, size = [], [], 0
        for html in htmls:
            held.append(leaf_blocks(html) if html else [])
            size += len(held[-1])
            if size > GROUP_BLOCKS:
                out += self._decode(held)
                held, size = [], 0
        return out + self._decode(held)

    def _decode(self, pages: list[list[tuple]]) -> list[list[str]]:
        if not any(pages):
            return [[] for _ in pages]
        e = np.array([self.place(a) + self.text(text_features(t, k)) for blocks in pages for t, a, k in blocks])
        lengths = [len(b) for b in pages]
        path, at, out = crf.viterbi(e, lengths, self.model.trans, self.model.start), 0, []
        for blocks in pages:
            out.append([b[0] for b, y in zip(blocks, path[at:at + len(blocks)].tolist(), strict=True) if y])
            at += len(blocks)
        return out


def train(pages: list[str]) -> crf.Crf:
    """The model from pages whose main blocks begin with ``MARK``."""
    kinds, items, gold, lengths = [], [], [], []
    for html in pages:
        blocks = leaf_blocks(html)
        lengths.append(len(blocks))
        for text, ancestors, links in blocks:
            gold.append(int(text.startswith(MARK)))
            items.append(len(kinds))
            kinds.append([*place_features(ancestors), *text_features(text.removeprefix(MARK) or "-", links)])
    return crf.train(kinds, np.array(items), lengths, np.array(gold), 2, rounds=150, l2=0.02)


OUT = pa.schema([("page_key", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            labelled: list[str] | None = None) -> DataFrame:
    """One row per page: id, url, text."""
    sent = pages.sparkSession.sparkContext.broadcast(train(labelled_pages() if labelled is None else labelled))

    def run(batches):
        extractor = Extractor(sent.value)
        for b in batches:
            texts = ["\n".join(x) for x in extractor.pages(b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), pa.array(texts, pa.string())], schema=OUT)

    return pages.select(F.col(id_col).cast("long").alias("page_key"), F.col(url_col).cast("string"), html_col).mapInArrow(
        run, "page_key long, url string, text string").withColumnsRenamed({"page_key": id_col, "url": url_col})
