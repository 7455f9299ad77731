import hashlib
import random
import re
from collections import defaultdict

import pytest

from churnlens.llm.mixing import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), most=3):
    """Excess reshared by weight until no source is above ``most`` times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        still = [s for s in order if s not in full]
        if not still:
            return {s: float(most * sizes[s]) for s in order}
        share = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in still)
        new = {s for s in still if weight[s] * share >= most * sizes[s]}
        if not new:
            return {s: float(most * sizes[s]) if s in full else weight[s] * share for s in order}
        full |= new


def brute(rows, near=0.001, fills=8):
    docs = [(i, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    sizes = defaultdict(int)
    for _, s, n in docs:
        sizes[s] += n
    goal, out = targets(sizes), []
    for s in sizes:
        mine = sorted((hashlib.md5(f"{'' if i is None else i}:{n}".encode()).hexdigest()[:15], i if i is not None else -1, n, i) for i, x, n in docs if x == s)
        whole = int(goal[s] // sizes[s]) if sizes[s] else 0
        left, extra = goal[s] - whole * sizes[s], [0] * len(mine)
        for fill in range(fills):
            if left <= 0 or (fill and left <= near * goal[s]):
                break
            limit = float("inf") if not fill else left
            for at, (_, _, n, _) in enumerate(mine):
                if n == 0 or extra[at] or n > limit:
                    continue
                if n > left:
                    break
                extra[at], left = 1, left - n
        out += [(i, n, sizes[s], goal[s], n * (whole + e)) for (_, _, n, i), e in zip(mine, extra, strict=True)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 3, "x") for i, t, s in rows], "doc_id long, text string, source string, size int, key string")


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)


def awkward(n=200):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([1, 5, 30, 90]))), f"s{i % 5}") for i in range(n)]
    return rows + [(900, "a b c", "tiny"), (901, None, "s1"), (902, "", "s2"), (903, " \t\r\n\v\f ", "empty"), (904, "x y z", None), (905, "p q", None),
                   (None, "no id here", "s3"), (None, None, None), (906, "w " * 20_000, "s0"), (907, "café 漢 \U0001f642", "é"), (908, "one", ""), (909, "two", "S1")]


@pytest.mark.parametrize("bits", [2, 10, 20])
def test_equals_running_sums(spark, bits):
    rows = awkward()
    assert result(mix(frame(spark, rows).repartition(7), bits=bits)) == brute(rows)


def test_targets_are_met_and_reruns_agree(spark):
    rows = [(i, "word " * (1 + i % 17), "big" if i % 3 == 0 else f"s{i % 11}") for i in range(3000)]
    one, two = (result(mix(frame(spark, rows).repartition(n))) for n in (1, 9))
    assert one == two
    got, want = defaultdict(int), {}
    docs = {i: s for i, _, s in rows}
    for i, size, held, target, taken in one:
        got[docs[i]] += taken
        want[docs[i]] = target
        assert taken <= 3 * size and target <= 3 * held
    assert all(0 <= want[s] - got[s] <= max(0.001 * want[s], 17) for s in want)
    assert sum(want.values()) == pytest.approx(sum(x[1] for x in one))


def test_repeats_of_one_row_are_split(spark):
    """A source of one row that comes 4,000 times, a third of all rows: no all or nothing."""
    rows = [(1, "a b c", "a")] * 4000 + [(10 + i, "u v", "b") for i in range(8000)]
    got = mix(frame(spark, rows).repartition(5)).groupBy("source").sum("taken", "size").collect()
    goal = targets({"a": 12000, "b": 16000})
    assert all(goal[r.source] - 28 <= r["sum(taken)"] <= goal[r.source] for r in got)


def test_empty_and_wordless(spark):
    assert mix(frame(spark, [])).count() == 0
    got = result(mix(frame(spark, [(1, None, "a"), (2, "", None)])))
    assert got == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
