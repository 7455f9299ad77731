import itertools

import numpy as np
import pytest

from churnlens.llm import crf


@pytest.mark.parametrize("k", [2, 3])
def test_marginals_and_viterbi_equal_enumeration(k):
    rng = np.random.default_rng(k)
    lengths = [3, 1, 0, 5, 4]
    n = sum(lengths)
    em, trans, start = rng.normal(size=(n, k)) * 2, rng.normal(size=(k, k)), rng.normal(size=k)
    p, xi, log_z = crf.marginals(em, lengths, trans, start, pairs=True)
    want, pairs, z_all, best, at = np.zeros((n, k)), np.zeros((k, k)), 0.0, [], 0
    for size in filter(None, lengths):
        score = {y: start[y[0]] + sum(em[at + t, s] for t, s in enumerate(y)) + sum(trans[a, b] for a, b in itertools.pairwise(y))
                 for y in itertools.product(range(k), repeat=size)}
        z = np.logaddexp.reduce(list(score.values()))
        for y, v in score.items():
            for t, s in enumerate(y):
                want[at + t, s] += np.exp(v - z)
                if t:
                    pairs[y[t - 1], s] += np.exp(v - z)
        z_all, at = z_all + z, at + size
        best += max(score, key=score.get)
    assert np.allclose(p, want) and np.allclose(xi, pairs) and np.isclose(log_z, z_all)
    assert crf.viterbi(em, lengths, trans, start).tolist() == best


def test_blocks_carry_over_any_length():
    rng = np.random.default_rng(1)
    lengths = [1000, 64, 65, 128, 1, 3000]
    em, trans, start = rng.normal(size=(sum(lengths), 2)) * 3, rng.normal(size=(2, 2)), rng.normal(size=2)
    p, at = crf.marginals(em, lengths, trans, start), 0
    for size in lengths:
        e = em[at:at + size]
        a, b = np.zeros((size, 2)), np.zeros((size, 2))
        a[0] = start + e[0]
        for t in range(1, size):
            a[t] = np.logaddexp.reduce(a[t - 1][:, None] + trans, axis=0) + e[t]
        for t in range(size - 2, -1, -1):
            b[t] = np.logaddexp.reduce(trans + (e[t + 1] + b[t + 1])[None, :], axis=1)
        g = a + b
        assert np.allclose(np.exp(g - np.logaddexp.reduce(g, axis=1)[:, None]), p[at:at + size])
        at += size


def test_no_items():
    assert crf.marginals(np.zeros((0, 2)), [], np.zeros((2, 2)), np.zeros(2)).shape == (0, 2)
    assert crf.viterbi(np.zeros((0, 2)), [0, 0], np.zeros((2, 2)), np.zeros(2)).tolist() == []


def test_training_learns_a_context():
    """A word is tagged by the word before it, which only the chain can tell."""
    kinds = [["w=open"], ["w=x"], ["w=shut"]]
    lines = [[0, 1, 2, 1], [1, 2, 1], [1, 0, 1, 1], [2, 1, 0, 1]] * 10
    gold = [[1 if i and line[i - 1] == 0 else 2 if w == 0 else 0 for i, w in enumerate(line)] for line in lines]
    m = crf.train(kinds, np.concatenate(lines), [len(x) for x in lines], np.concatenate(gold), 3, rounds=100)
    em = np.array([m.emission(kinds[w]) for line in lines for w in line])
    assert crf.viterbi(em, [len(x) for x in lines], m.trans, m.start).tolist() == [y for g in gold for y in g]
