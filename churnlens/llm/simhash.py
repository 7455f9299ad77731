"""SimHash near-dedup: fingerprints linked through BK-trees, then connected components.

A fingerprint bit is 1 if it is set in over half of the hashes (XXH64, seed 42) of the text's word
shingles. Equal fingerprints are one node. Two fingerprints at most ``radius`` bits apart, cut into
``blocks`` blocks, agree on at least ``blocks - radius`` of them, so for every choice of that many
blocks the fingerprints that agree there form a shard: every link lies in some shard. The number of
blocks follows from the number of fingerprints, so that a shard holds about ``SHARD`` random ones.

In a shard a BK-tree (children keyed by their Hamming distance to the parent) is searched along the
edges within the radius only. Since components are wanted, a subtree that is already in the
component of the fingerprint in hand isn't entered: a large group of near copies costs about as much
as its nodes, and gives a spanning forest of links instead of all its pairs. A shard over
``tree_nodes`` is put off while it is read, no more than that many nodes being held, and dealt out: its
nodes to several trees of about that size, every node as a query to the trees of other numbers. A task
builds its tree and streams ``QUERIES`` times as many queries past it; further queries go to further tasks
with the same tree. Trees are sent to nobody and nothing is gathered on the driver.

Defined results: null, empty or wordless texts have fingerprint zero and are linked like any others;
a text of fewer words than a shingle is one shingle; component_id is the least non-null id of the
component (null if it has none); repeated rows come back as often as they came; an empty table gives
an empty result. Only the id and the text are read, so other columns play no part.
"""

from __future__ import annotations

from itertools import chain, combinations, groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import carried, restored, with_rest, written
from churnlens.llm.components import components

SHINGLE = 4
RADIUS = 4
SHARD = 32
TREE_NODES = 100_000
QUERIES = 16  # queries, in trees' sizes, that one task streams past its tree
SALTS = 32  # parts that the members of one component are dealt to where its least id is looked up
PIECE = 1 << 15  # shingles whose bits are counted at once

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; zero if there are no words."""
    words = text.encode().translate(_LOWER).split() if text else []  # bytes split at \\x20 and \\x09-\\x0D
    if not words:
        return 0
    line, size, digest = b" ".join(words), min(shingle, len(words)), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:len(words) - size].tolist()]
    stops = (ends[size - 1:] - 1).tolist()
    n, counts = len(starts), np.zeros(64, np.int64)
    for i in range(0, n, PIECE):
        h = np.fromiter((digest(line[s:e], 42) for s, e in zip(starts[i:i + PIECE], stops[i:i + PIECE], strict=True)), np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


class BKTree:
    """Nodes are numbered; a node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int] | None] = []
        self.parent: list[int] = []  # of the union-find over nodes
        self.whole: list[int] = []  # component that a node's subtree is wholly in, or -1

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j

    def insert(self, value: int, radius: int):
        """Adds a value that isn't held; yields the nodes on its way that are within the radius."""
        new, at = len(self.values), 0
        self.values.append(value)
        self.children.append(None)
        self.parent.append(new)
        while at != new:
            d = (self.values[at] ^ value).bit_count()
            if d <= radius and self.union(at, new):
                yield at
            below = self.children[at]
            if below is None:
                below = self.children[at] = {}
            at = below.setdefault(d, new)

    def settle(self) -> None:
        """Marks the subtrees that lie in one component; marks stay right as components merge."""
        self.whole = [self.find(i) for i in range(len(self.values))]
        for i in range(len(self.values) - 1, -1, -1):  # children have larger numbers
            for c in (self.children[i] or {}).values():
                if self.whole[c] < 0 or self.find(self.whole[c]) != self.find(i):
                    self.whole[i] = -1
                    break

    def search(self, value: int, radius: int, mine):
        """Yields the nodes within the radius; skips subtrees wholly in the component ``mine()``."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            if (w := self.whole[at]) >= 0 and self.find(w) == mine():
                continue
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            for k, c in (self.children[at] or {}).items():
                if d - radius <= k <= d + radius:
                    todo.append(c)


class Linker:
    """Links (value, value) that join what is within the radius: among a tree's values, and of queries to them."""

    def __init__(self, values: list[int], radius: int) -> None:
        self.tree, self.values, self.radius = BKTree(), values, radius

    def own(self):
        tree = self.tree
        for v in self.values:
            for at in tree.insert(v, self.radius):
                yield v, tree.values[at]
        tree.settle()
        for i, v in enumerate(self.values):
            for at in tree.search(v, self.radius, lambda i=i: tree.find(i)):
                if tree.union(at, i):
                    yield v, tree.values[at]

    def query(self, v: int):
        tree, first = self.tree, None
        for at in tree.search(v, self.radius, lambda: -1 if first is None else tree.find(first)):
            if first is None or tree.find(first) != tree.find(at):
                yield v, tree.values[at]
                if first is not None:
                    tree.union(first, at)  # v links the two
            first = at if first is None else first


def tree_links(values: list[int], queries, radius: int):
    linker = Linker(values, radius)
    yield from linker.own()
    for v in queries:
        yield from linker.query(v)


def blocks_for(n: int, radius: int = RADIUS, shard: int = SHARD) -> int:
    """Least number of blocks for which the agreed bits leave about ``shard`` random fingerprints together."""
    for blocks in range(radius + 1, 3 * radius + 1):
        if n / 2 ** (64 * (blocks - radius) / blocks) <= shard:
            break
    return blocks


def block_masks(blocks: int, radius: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (e - s)) - 1) << s for s, e in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _unsigned(xs) -> list[int]:
    return [x & 0xFFFFFFFFFFFFFFFF for x in xs]


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shard", pa.int64())])
LINKS_SQL = "a long, b long, shard long"


def _batched(rows, most: int = 10_000):
    """Arrow batches of (a, b, shard) rows."""
    rows = iter(rows)
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), LINKS.types, strict=True)], schema=LINKS)


def _rows(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _shard_links(rows, radius: int, tree_nodes: int):
    """(a, b, None) links of the shards of sorted (shard, fp) rows; (fp, None, shard) of a shard over ``tree_nodes``."""
    for key, run in groupby(rows, lambda r: r[0]):
        held = [fp for _, fp in islice(run, tree_nodes + 1)]
        if len(held) > tree_nodes:
            for fp in held:
                yield fp, None, key
            for _, fp in run:
                yield fp, None, key
        elif len(held) > 1:
            for a, b in tree_links(_unsigned(held), [], radius):
                yield _signed(a), _signed(b), None


def _dealt_links(rows, radius: int):
    """Links of (shard, tree, part, is a query, fp) rows, a tree's own fingerprints first: those are held, queries pass."""
    for (_, _, part), run in groupby(rows, lambda r: r[:3]):
        linker, own = None, []
        for *_, is_query, fp in chain(run, [(True, None)]):
            if not is_query:
                own.append(fp & 0xFFFFFFFFFFFFFFFF)
                continue
            if linker is None:
                linker = Linker(own, radius)
                for a, b in linker.own():
                    if part == 0:  # the other parts have the same tree
                        yield _signed(a), _signed(b), None
            if fp is not None:
                for a, b in linker.query(fp & 0xFFFFFFFFFFFFFFFF):
                    yield _signed(a), _signed(b), None


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that join all at most ``radius`` bits apart."""
    masks = block_masks(blocks_for(prints.count(), radius, shard), radius)
    keyed = prints.select("fp", F.explode(F.array(*[
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])).alias("shard"))

    def search(batches):
        yield from _batched(_shard_links(_rows(batches), radius, tree_nodes))

    found = written(keyed.repartition("shard").sortWithinPartitions("shard", "fp").select("shard", "fp").mapInArrow(search, LINKS_SQL), "simhash-links")
    links, put_off = found.where("shard is null").select("a", "b"), found.where("shard is not null")
    if put_off.isEmpty():
        return links

    def split(batches):
        yield from _batched(_dealt_links(_rows(batches), radius))

    sizes = put_off.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / tree_nodes).cast("int").alias("trees"))
    own = F.pmod(F.xxhash64("a"), F.col("trees")).cast("int")
    parts = F.ceil(F.col("trees") / QUERIES).cast("int")
    placed = put_off.join(sizes, "shard").select("shard", F.col("a").alias("fp"), own.alias("own"), parts.alias("parts"))
    # a tree's fingerprints go to each of its parts, a query to one
    trees = placed.select("shard", F.col("own").alias("tree"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_query"), "fp")
    queries = placed.where("own > 0").select("shard", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("tree"), F.pmod(
        F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("is_query"), "fp")
    dealt = trees.unionAll(queries).repartition("shard", "tree", "part").sortWithinPartitions("shard", "tree", "part", "is_query")
    return links.unionAll(written(dealt.mapInArrow(split, LINKS_SQL), "simhash-links").select("a", "b"))


def _marked(docs: DataFrame, id_col: str, text_col: str, shingle: int, carry: bool) -> DataFrame:
    """(doc_key, fp[, body, rest]) of the rows, written once."""
    def mark(batches):
        for b in batches:
            prints = [_signed(fingerprint(t, shingle)) for t in b.column("body").to_pylist()]
            own = {"body": b.column("body"), "rest": b.column("rest")} if carry else {}
            yield pa.RecordBatch.from_pydict({"doc_key": b.column("doc_key"), "fp": pa.array(prints, pa.int64())} | own)

    base = carried(docs, id_col, text_col, carry)
    return written(base.mapInArrow(mark, with_rest("doc_key long, fp long", base)), "simhash")


def _grouped(marked: DataFrame, radius: int, shard: int, tree_nodes: int) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint."""
    prints = marked.groupBy("fp").agg(F.min("doc_key").alias("least"))
    roots = components(fingerprint_links(prints.select("fp"), radius, shard, tree_nodes))
    rooted = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # one component may hold a third of all: its members are dealt to SALTS parts, its least id goes to each.
    # A fingerprint without links has its own, so only the least ids of linked ones are repeated.
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    each = least.select("root", "component_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).alias("salt"))
    salted = rooted.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    return salted.join(each, ["root", "salt"], "left").select("fp", "root", F.coalesce("component_id", "least").alias("component_id"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   radius: int = RADIUS, shard: int = SHARD, tree_nodes: int = TREE_NODES) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id. Ids are integers."""
    marked = _marked(docs, id_col, text_col, shingle, False)
    named = _grouped(marked, radius, shard, tree_nodes)
    return marked.join(named.select("fp", "component_id"), "fp").select(
        F.col("doc_key").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                      radius: int = RADIUS, shard: int = SHARD, tree_nodes: int = TREE_NODES) -> DataFrame:
    """One row of each component, with all its columns: the least id's (of rows with that id, the one whose hashes are least).

    Rows equal in id and text, which exact dedup leaves once, stay or go together.
    """
    marked = _marked(docs, id_col, text_col, shingle, True)
    row = F.struct(F.col("doc_key").isNull(), "doc_key", "fp", "th")
    rows = marked.withColumn("th", F.xxhash64("body"))
    # one row per fingerprint, then one per component: both are grouped minima of narrow rows
    best = rows.groupBy("fp").agg(F.min(row).alias("best")).join(_grouped(marked, radius, shard, tree_nodes), "fp")
    first = best.groupBy("root").agg(F.min("best").alias("best")).select(
        F.col("best.doc_key").alias("k"), F.col("best.fp").alias("f"), F.col("best.th").alias("t"))
    kept = rows.join(first, F.col("doc_key").eqNullSafe(F.col("k")) & (F.col("fp") == F.col("f")) & (F.col("th") == F.col("t")), "left_semi")
    return restored(kept, docs, text_col)
