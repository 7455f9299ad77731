import math
import re
from collections import Counter

import numpy as np
import pytest

from churnlens.llm import lexical_search as L
from churnlens.llm.lexical_search import Best, Block, item_terms, ranked_search, search_block, terms
from tests.llm.helpers import awkward, documents, text

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def plain(x):
    return [w.translate(LOWER) for w in TERM.findall(x or "")]


def brute(docs, items, top=20):
    held = [(i, Counter(plain(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, x in items:
        found = []
        for i, c in held:
            m = 100 - 25 + (25 * c.total() * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in plain(x) if t in c)
            if score > 0:
                found.append((-score, i is None, i, score))
        out += [(item, r, i, score) for r, (_, _, i, score) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, doc_id string")


ITEMS = [(0, text(30, 1)), (1, "ALPHA0 alpha0 beta31, one-two"), (2, None), (3, ""), (4, "zzzz nowhere"), (5, "漢字 \U0001f642 éàü"), (None, "one two"), (1, "row")]


def test_terms():
    assert [t.decode() for t in terms("A-b_c dİ 9\x85")] == plain("A-b_c dİ 9\x85")
    assert terms(None) == terms("") == terms(" ,.") == []


@pytest.mark.parametrize("short", [0, 2, 10**9])
def test_equals_brute_force(spark, short, monkeypatch):
    docs = awkward() + [(100 + i, text(20 + i % 30, i % 9)) for i in range(150)]
    got = result(ranked_search(documents(spark, docs), items_frame(spark, ITEMS), short=short))
    assert got == brute(docs, ITEMS)


def test_item_blocks_give_the_same(spark):
    docs = [(i, text(15, i % 7)) for i in range(40)]
    got = result(ranked_search(documents(spark, docs), items_frame(spark, ITEMS), item_bytes=50, top=3))
    assert got == brute(docs, ITEMS, 3)


def test_copies_tie_by_id(spark):
    """A group of copies that is a third of all rows: the least ids come first."""
    docs = [(i, "same old words") for i in range(300)] + [(1000 + i, text(12, i)) for i in range(600)]
    got = result(ranked_search(documents(spark, docs).repartition(6), items_frame(spark, [(1, "old same")])))
    assert got == brute(docs, [(1, "old same")]) and [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(20))


def test_empty_tables(spark):
    docs = documents(spark, [(1, "a b")])
    assert ranked_search(docs.limit(0), items_frame(spark, ITEMS)).count() == 0
    assert ranked_search(docs, items_frame(spark, [])).count() == 0
    assert ranked_search(documents(spark, [(1, None), (2, "")]), items_frame(spark, ITEMS)).count() == 0


def block_of(docs, numbers, short):
    held = [Counter(terms(t)) for t in docs]
    rows, known, counts = zip(*[(r, numbers[t], n) for r, c in enumerate(held) for t, n in sorted(c.items()) if t in numbers], strict=True)
    sizes = np.array([c.total() for c in held])
    return Block(np.arange(len(docs)), sizes, np.array(rows), np.array(known), np.array(counts), len(docs), int(sizes.sum()), len(numbers), short)


def test_ranges_are_skipped_and_the_result_stays():
    """Most documents hold the common word only; a few at the front hold the rare ones, too."""
    docs = ["common rare scarce"] * 30 + ["common filler"] * 5000 + ["rare other"] * 3
    numbers, queries = item_terms(["common rare scarce"])
    query = {t: 1000 if t == numbers[b"common"] else 5000 for t in queries[0]}
    seen = {}
    for short in (0, 100):
        block, best = block_of(docs, numbers, short), Best(20)
        assert block.ranges == -(-len(docs) // L.RANGE)
        scored = search_block(block, np.zeros(len(docs), bool), query, best)
        assert scored < block.ranges / 4
        seen[short] = (best.ids.tolist(), best.scores.tolist())
    assert seen[0] == seen[100] and seen[0][0] == list(range(20))


def test_thresholds_are_carried_from_block_to_block():
    numbers, queries = item_terms(["common rare"])
    best, query = Best(20), {t: 1000 for t in queries[0]}
    first, later = (block_of(d, numbers, 5) for d in (["common rare"] * 64, ["common filler filler"] * 1000))
    assert search_block(first, np.zeros(64, bool), query, best) == 1
    assert search_block(later, np.zeros(1000, bool), query, best) == 0


def test_blocks_cut_inside_batches(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_DOCS", 16)
    monkeypatch.setattr(L, "BLOCK_POSTINGS", 40)
    docs = [(i, text(5 + i % 40, i % 3)) for i in range(100)]
    numbers, queries = item_terms([t for _, t in ITEMS])
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_key": pa.array([i for i, _ in docs]), "body": [t for _, t in docs]})
    blocks = list(L._blocks(L._forward(numbers)([batch]), 100, 2000, len(numbers), 3))
    assert sum(len(b.ids) for b, _ in blocks) == 100 and max(len(b.ids) for b, _ in blocks) <= 16 and len(blocks) > 6
    assert sum(len(b.rows) for b, _ in blocks) == sum(len(set(terms(t)) & set(numbers)) for _, t in docs)
