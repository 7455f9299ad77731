import hashlib
import tempfile
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from churnlens.llm import exact_dedup as E
from churnlens.llm import simhash as S
from churnlens.llm import substring_dedup as D
from churnlens.llm.components import components
from tests.llm.helpers import awkward, documents, rows, sha, text

EMPTY = "doc_id long, text string"


# exact


def exact_twin(data):
    groups = defaultdict(list)
    for k, t in data:
        groups[t or ""].append(k)
    keep = {t: max((k for k in ks if k is not None), default=None) for t, ks in groups.items()}
    return sorted(((k, keep[t or ""], len(groups[t or ""]), sha(t or "")) for k, t in data), key=repr), len(groups)


@pytest.mark.parametrize("budget", [64 << 20, 300])
def test_exact_equals_brute_force(spark, budget):
    data = awkward() + [(100 + i, text(5, i % 7)) for i in range(200)]
    got = E.exact_dedup(documents(spark, data).repartition(5), table_bytes=budget).cache()
    want, groups = exact_twin(data)
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert got.where("kept").count() == groups
    assert got.where("kept and doc_id is not null and doc_id <> keep_id").count() == 0


def test_survivors_are_the_kept_rows(spark):
    data = awkward() + [(100 + i, text(5, i % 7)) for i in range(200)]
    docs = documents(spark, data)
    got = E.exact_survivors(docs.repartition(5), table_bytes=500)
    assert got.columns == docs.columns
    want = rows(E.exact_dedup(docs).where("kept"), "keep_id", "text_sha256")
    assert sorted(((r.doc_id, sha(r.text)) for r in got.collect()), key=repr) == want


def test_survivors_hold_no_batch(tmp_path):
    rest = pa.array([{"_": 1, "lang": "en", "tags": ["a"]}, None])
    base = pa.RecordBatch.from_pydict({"doc_key": [0, 0], "body": ["x" * (1 << 20), "y" * (1 << 20)], "rest": rest})
    with pa.OSFile(f"{tmp_path}/one", "wb") as file, pa.ipc.new_stream(file, base.schema) as out:
        out.write_batch(base)
    start, held = pa.total_allocated_bytes(), []

    def batches():  # the columns of each share one buffer, as those that Spark sends do
        for i in range(40):
            b = pa.ipc.open_stream(pa.OSFile(f"{tmp_path}/one")).read_next_batch()
            yield pa.RecordBatch.from_arrays([pa.array([2 * i, 2 * i + 1]), b.column("body"), b.column("rest")], names=base.schema.names)
            del b
            held.append(pa.total_allocated_bytes() - start)

    for budget in (64 << 20, 1):
        got = [r for b in E.surviving(batches(), budget) for r in b.to_pylist()]
        assert sorted((r["doc_key"], r["body"][0]) for r in got) == [(78, "x"), (79, "y")]
        assert sorted((r["doc_key"], r["rest"]) for r in got) == [(78, {"_": 1, "lang": "en", "tags": ["a"]}), (79, None)]
    assert max(held) < 20 << 20


def test_exact_empty(spark):
    none = spark.createDataFrame([], EMPTY)
    assert E.exact_dedup(none).count() == 0 and E.exact_survivors(none).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 60)), max_size=300), st.integers(200, 2000))
def test_grace_groups_everything_once(data, budget):
    records = [(b"x" * n + bytes([c]), i, 1) for i, (c, n) in enumerate(data)]
    gone, groups = defaultdict(list), {}
    with tempfile.TemporaryDirectory() as folder:
        for content, found in E.grace(iter(records), budget, folder, E.leading(100)):
            if content is None:
                gone[found[1]].append(found[0])
            else:
                assert content not in groups
                groups[content] = found
    want = defaultdict(list)
    for content, i, _ in records:
        want[content].append(i)
    assert {c: (best, n) for c, (_, best, n) in groups.items()} == {c: (max(ids), len(ids)) for c, ids in want.items()}
    assert {c: sorted([*gone[g], best]) for c, (g, best, _) in groups.items()} == want


def traced_peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_copies_of_a_held_text_take_no_memory():
    """400,000 rows of one text and as many leaders of one text: budget 1 MB."""
    with tempfile.TemporaryDirectory() as folder:
        def local():
            seen = sum(1 for _ in E.grace(((b"", i, 1) for i in range(400_000)), 1 << 20, folder, E.leading(0)))
            assert seen == 400_000

        def merged():
            found = list(E.grace(((b"", (i, i), 1) for i in range(400_000)), 1 << 20, folder, E.merging))
            assert found[0][1][0] == (399_999, 399_999) and len(found[0][1][2]) == 400_000

        assert traced_peak(local) < 1 << 20
        assert traced_peak(merged) < 8 << 20


def test_exact_with_a_hot_text(spark):
    """One text that is a third of all rows, under ids that repeat, and an empty one."""
    docs = spark.range(30_000).selectExpr("id % 9000 as doc_id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then '' else cast(id as string) end as text")
    got = E.exact_dedup(docs.repartition(11), table_bytes=1 << 16)
    assert got.count() == 30_000 and got.where("kept").count() == 10_002
    assert {tuple(r) for r in got.where("group_size > 1").select("keep_id", "group_size").distinct().collect()} == {(8997, 10_000), (8998, 10_000)}
    assert got.where("group_size > 1 and kept").count() == 2


def test_table_compares_content_under_equal_hashes():
    t = E.ContentTable()
    for c in (b"a", b"b", b"c"):
        t.add(-1 - t.find(5, c), 5, c)
    assert [t.find(5, c) for c in (b"a", b"b", b"c")] == [0, 1, 2] and t.find(5, b"d") < 0


# substrings


def substring_twin(data, window):
    words = [t.encode().split() if t else [] for _, t in data]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (k, _), w in zip(data, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(4 << 20, 2 << 20), (2000, 100)])
@pytest.mark.parametrize("window", [35, 3])
def test_substrings_equal_brute_force(spark, sizes, window):
    data = awkward() + [(200 + i, text(20, i) + " " + text(50, 3) + " " + text(i, 2)) for i in range(30)] + [(300, "same " * 100)]
    got = D.substring_dedup(documents(spark, data), window=window, chunk_bytes=sizes[0], shard_windows=sizes[1]).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text).hexdigest()) for r in got), key=repr) == substring_twin(data, window)
    assert all(sum(x.stop - x.start for x in r.removed) == r.n_removed for r in got)


def test_equal_rows_are_one_row_of_a_chunk(spark):
    """A row that comes 600 times, a third of all: its chunk gets one row per batch, the result all of them."""
    data = [(1, text(60, 1))] * 600 + [(2, text(20, 2))] * 3 + [(i, text(40, i)) for i in range(10, 30)] + [(None, None)] * 4
    got = D.substring_dedup(documents(spark, data).repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text).hexdigest()) for r in got), key=repr) == substring_twin(data, 35)
    assert sum(r.n_removed == 60 for r in got) == 600 and sum(r.n_removed for r in got if r.doc_id == 2) == 0


def test_substrings_empty(spark):
    assert D.substring_dedup(spark.createDataFrame([], EMPTY)).count() == 0
    assert rows(D.substring_dedup(documents(spark, [(1, None), (2, "a b")])), "doc_id", "n_words", "n_removed") == [(1, 0, 0), (2, 2, 0)]


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"cc"]), max_size=40), max_size=6), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_rolling_hashes_are_equal_just_for_equal_windows(docs, window):
    h1, h2, at = D.window_hashes(docs, window)
    flat = [w for d in docs for w in d]
    windows = [tuple(flat[i:i + window]) for i in at.tolist()]
    assert len(windows) == sum(max(0, len(d) - window + 1) for d in docs)
    assert len(set(windows)) == len(set(h1.tolist())) == len(set(zip(h1.tolist(), h2.tolist(), strict=True)))


# SimHash


def simhash_twin(data, shingle=4, radius=4):
    prints = []
    for _, t in data:
        import xxhash

        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0)
    return prints, linked(prints, radius)


def linked(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def near_copies(n, seed):
    """Texts with a few words changed: fingerprints a few bits apart, in chains."""
    rng = np.random.default_rng(seed)
    words, out = text(300, 11).split(), []
    for i in range(n):
        words = list(words)
        for j in rng.integers(0, 300, 2):
            words[j] = f"new{rng.integers(1000)}"
        out.append((1000 + i, " ".join(words)))
    return out


@pytest.mark.parametrize("nodes", [100_000, 5])
def test_simhash_equals_brute_force(spark, nodes):
    data = awkward() + near_copies(80, 3) + [(2000 + i, text(50, i)) for i in range(100)]
    prints, roots = simhash_twin(data)
    least = {r: min((data[i][0] for i, x in enumerate(roots) if x == r and data[i][0] is not None), default=None) for r in set(roots)}
    want = sorted(((data[i][0], f"{prints[i]:016x}", least[r]) for i, r in enumerate(roots)), key=repr)
    docs = documents(spark, data)
    assert rows(S.simhash_groups(docs, tree_nodes=nodes), "doc_id", "fingerprint", "component_id") == want
    assert len(set(roots)) < len(data) - 20
    kept = S.simhash_survivors(docs, tree_nodes=nodes)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    # one row per component, but rows equal in id and text go together
    assert len(set(got)) == len(set(roots))
    assert {roots[data.index(x)] for x in got} == {roots[data.index(data[r])] for r in set(roots)}


def test_simhash_empty(spark):
    none = spark.createDataFrame([], EMPTY)
    assert S.simhash_groups(none).count() == 0 and S.simhash_survivors(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1).map(lambda x: x & 0xF0F00000000000FF), max_size=60, unique=True), st.integers(1, 6), st.integers(0, 59))
def test_tree_links_join_what_is_within_the_radius(values, radius, cut):
    held, queries = values[:cut], values[cut:]
    links = list(S.tree_links(held, queries, radius))
    assert all((a ^ b).bit_count() <= radius for a, b in links)
    at = {v: i for i, v in enumerate(values)}
    # queries aren't compared with each other
    want = linked_pairs(values, [(i, j) for i in range(len(values)) for j in range(min(i, len(held))) if (values[i] ^ values[j]).bit_count() <= radius])
    assert linked_pairs(values, [(at[a], at[b]) for a, b in links]) == want


def linked_pairs(values, pairs):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("n", [1, 10**6, 10**8, 10**11])
def test_blocks_leave_no_pair_out(n):
    blocks = S.blocks_for(n)
    masks = S.block_masks(blocks, S.RADIUS)
    rng = np.random.default_rng(n)
    for _ in range(200):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(64, S.RADIUS, replace=False):
            b ^= 1 << int(bit)
        assert any(a & m == b & m for m in masks)


def test_components_of_chains_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(200, 100 + i) for i in range(40)] + [(7, 7), (None, 3), (1, 0), (0, 1), (-5, 300)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in [*range(101, 140), 200]} | {300: -5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hot_shard_is_never_held_whole():
    """A third of all fingerprints in one shard: no more rows than a tree's are read ahead of what is given back."""
    read, given = [0], [0]

    def rows():
        for key, n in ((1, 50), (2, 3000), (3, 50)):
            for fp in range(n):
                read[0] += 1
                assert read[0] - given[0] < 300  # 50 + 101 and a run's links
                yield key, fp * 0x9E3779B97F4A7C15 % (1 << 63)

    off = 0
    for a, b, key in S._shard_links(rows(), 4, 100):
        given[0] += 1 if key is not None else 0
        if key is None:
            assert b is not None
            continue
        assert key == 2 and b is None
        off += 1
        if given[0] == 1:
            given[0] += 51  # the first shard's rows gave links only
    assert off == 3000


@pytest.mark.parametrize("tree_nodes", [5, 40])
def test_links_of_hot_shards_join_the_same(spark, tree_nodes, monkeypatch):
    """Fingerprints that agree in all shards' blocks: trees, parts and queries give the components of all pairs."""
    monkeypatch.setattr(S, "QUERIES", 2)
    rng = np.random.default_rng(4)
    values = {int(base) ^ sum(1 << int(b) for b in rng.choice(20, 3, replace=False)) for base in rng.integers(0, 1 << 14, 60) * 7919 for _ in range(4)}
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    links = [tuple(r) for r in S.fingerprint_links(prints, shard=1 << 40, tree_nodes=tree_nodes).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)

    def parts(pairs):
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = defaultdict(set)
        for v in values:
            groups[find(v)].add(v)
        return sorted(map(sorted, groups.values()))

    held = sorted(values)
    assert parts(links) == parts((a, b) for i, a in enumerate(held) for b in held[:i] if (a ^ b).bit_count() <= 4)
