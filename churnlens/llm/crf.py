"""Linear-chain conditional random field on numpy arrays: training, marginals, Viterbi.

Items (words, blocks of a page) of all sequences stand one after another; ``lengths`` has each
sequence's number of items. An item's emission is the sum of its features' weights. Features are
strings; those seen in training have a row of weights, others none.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

import numpy as np

BLOCK = 64  # items whose transfer matrices are multiplied in one sweep


@dataclass
class Crf:
    features: dict[str, int]
    weights: np.ndarray  # (features, states)
    trans: np.ndarray  # (states, states): from, to
    start: np.ndarray  # (states,)
    extra: dict = field(default_factory=dict)

    @property
    def states(self) -> int:
        return len(self.start)

    def emission(self, names) -> np.ndarray:
        """Emission of one item with these features."""
        get = self.features.get
        rows = [i for n in names if (i := get(n)) is not None]
        return self.weights[rows].sum(axis=0) if rows else np.zeros(self.states)


def _blocks(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item of each block's place or -1, first block of each sequence, blocks of each, sequence order by blocks)."""
    per = -(-lengths // BLOCK)
    first = np.concatenate(([0], np.cumsum(per)[:-1])).astype(np.int64)
    seq = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(seq)) - first[seq]
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))[seq] + nth * BLOCK
    places = begin[:, None] + np.arange(BLOCK)
    left = lengths[seq] - nth * BLOCK
    return np.where(np.arange(BLOCK) < left[:, None], places, -1), first, per, np.argsort(-per, kind="stable")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(emissions: np.ndarray, lengths, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """(items, states) probabilities by forward-backward; with ``pairs`` also (expected transitions, log Z).

    Exact for any length. Sequences are cut into blocks; the blocks' transfer matrices are formed
    side by side, carried from block to block, and then every block is swept from its own start and end.
    """
    lengths = np.asarray(lengths, np.int64)
    lengths, n, k = lengths[lengths > 0], len(emissions), len(start)
    if n == 0:
        return (np.zeros((0, k)), np.zeros((k, k)), 0.0) if pairs else np.zeros((0, k))
    top = emissions.max(axis=1, keepdims=True)
    places, first, per, order = _blocks(lengths)
    held = places >= 0
    e = np.exp(emissions - top)[places.clip(0)].transpose(1, 0, 2)  # (BLOCK, blocks, states)
    held_t = held.T[:, :, None]
    move, begin = np.exp(trans - trans.max()), np.exp(start - start.max())
    opens = np.zeros(len(places), bool)
    opens[first] = True

    m = np.broadcast_to(np.eye(k), (len(places), k, k))
    for t in range(BLOCK):
        new = (m.reshape(-1, k) @ move).reshape(-1, k, k) * e[t][:, None, :]
        if t == 0:
            new[opens] = (begin * e[0][opens])[:, None, :]
        new /= new.max(axis=(1, 2), keepdims=True)
        m = np.where(held_t[t][:, :, None], new, m)

    into, out = np.empty((len(places), k)), np.empty((len(places), k))
    v = np.full((len(lengths), k), 1.0 / k)
    counts = per[order]
    for j in range(int(counts[0])):  # sequences with more than j blocks stand first
        a = np.searchsorted(-counts, -j, side="left")
        b = first[order[:a]] + j
        into[b] = v[:a]
        v[:a] = _unit(np.einsum("nk,nkj->nj", v[:a], m[b]))
    u = np.full((len(lengths), k), 1.0 / k)
    for j in range(int(counts[0])):
        a = np.searchsorted(-counts, -j, side="left")
        b = first[order[:a]] + counts[:a] - 1 - j
        out[b] = u[:a]
        u[:a] = _unit(np.einsum("nkj,nj->nk", m[b], u[:a]))

    alpha, beta = np.empty_like(e), np.empty_like(e)
    scale = np.zeros(len(places))
    v = into
    for t in range(BLOCK):
        new = (v @ move) * e[t]
        if t == 0:
            new[opens] = begin * e[0][opens]
        total = new.sum(axis=1, keepdims=True)
        if pairs:
            scale += np.where(held[:, t], np.log(total[:, 0]), 0)
        v = np.where(held_t[t], new / total, v)
        alpha[t] = v
    v = out
    for t in range(BLOCK - 1, -1, -1):
        beta[t] = v
        v = np.where(held_t[t], _unit((e[t] * v) @ move.T), v)
    at = places[held]
    p = np.empty((n, k))
    p[at] = _unit(alpha * beta).transpose(1, 0, 2)[held]
    if not pairs:
        return p
    # a pair's probability is in proportion to alpha(t) move e(t+1) beta(t+1)
    a, eb = np.empty((n, k)), np.empty((n, k))
    a[at], eb[at] = alpha.transpose(1, 0, 2)[held], (e * beta).transpose(1, 0, 2)[held]
    inner = np.ones(n, bool)
    inner[np.cumsum(lengths) - 1] = False
    i = np.flatnonzero(inner)
    xi = a[i][:, :, None] * move * eb[i + 1][:, None, :]
    xi /= xi.sum(axis=(1, 2), keepdims=True)
    log_z = scale.sum() + top.sum() + (n - len(lengths)) * trans.max() + len(lengths) * start.max()
    return p, xi.sum(axis=0), float(log_z)


def viterbi(emissions: np.ndarray, lengths, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The likeliest state of each item; sequences are decoded side by side, the longest first."""
    lengths = np.asarray(lengths, np.int64)
    n, k = len(emissions), len(start)
    begin = (np.cumsum(lengths) - lengths)[lengths > 0]
    lengths = lengths[lengths > 0]
    path = np.zeros(n, np.int64)
    if n == 0:
        return path
    order = np.argsort(-lengths, kind="stable")
    sizes, at = lengths[order], begin[order]
    back = np.zeros((n, k), np.int8)
    score = start + emissions[at]
    for t in range(1, int(sizes[0])):
        a = int(np.searchsorted(-sizes, -t, side="left"))  # sequences with more than t items
        step = score[:a, :, None] + trans
        back[at[:a] + t] = step.argmax(axis=1)
        score[:a] = step.max(axis=1) + emissions[at[:a] + t]
    state = score.argmax(axis=1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        a = int(np.searchsorted(-sizes, -t, side="left"))
        path[at[:a] + t] = state[:a]
        if t:
            state[:a] = back[at[:a] + t, state[:a]]
    return path


def train(kinds: list[list[str]], items: np.ndarray, lengths, gold: np.ndarray, states: int, rounds: int = 60,
          l2: float = 1e-3, rate: float = 0.3, min_count: int = 1) -> Crf:
    """Fits by Adagrad on the penalised log likelihood of all sequences at once.

    kinds: the features of each kind of item (equal items share one); items: the kind of each item;
    gold: its state. Work in a round is linear in the items.
    """
    items, gold, lengths = np.asarray(items, np.int64), np.asarray(gold, np.int64), np.asarray(lengths, np.int64)
    lengths = lengths[lengths > 0]
    times: dict[str, int] = {}
    for names, c in zip(kinds, np.bincount(items, minlength=len(kinds)).tolist(), strict=True):
        for n in names:
            times[n] = times.get(n, 0) + c
    features = {n: i for i, n in enumerate(n for n, c in times.items() if c >= min_count)}
    del times
    held = [[features[n] for n in names if n in features] for names in kinds]
    of_kind = np.repeat(np.arange(len(kinds)), [len(x) for x in held])
    of_feature = np.fromiter(chain.from_iterable(held), np.int64, len(of_kind))
    del held
    w, trans, start = np.zeros((len(features), states)), np.zeros((states, states)), np.zeros(states)
    sums = [np.full_like(x, 1e-6) for x in (w, trans, start)]
    truth = np.zeros((len(items), states))
    truth[np.arange(len(items)), gold] = 1
    firsts = np.cumsum(lengths) - lengths
    inner = np.ones(len(items), bool)
    inner[firsts] = False
    moved = np.zeros((states, states))
    np.add.at(moved, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    for _ in range(rounds):
        per_kind = np.stack([np.bincount(of_kind, w[of_feature, s], len(kinds)) for s in range(states)], axis=1)
        p, xi, _ = marginals(per_kind[items], lengths, trans, start, pairs=True)
        miss = truth - p
        by_kind = np.stack([np.bincount(items, miss[:, s], len(kinds)) for s in range(states)], axis=1)
        grads = (np.stack([np.bincount(of_feature, by_kind[of_kind, s], len(features)) for s in range(states)], axis=1) - l2 * w,
                 moved - xi - l2 * trans, miss[firsts].sum(axis=0) - l2 * start)
        for x, g, q in zip((w, trans, start), grads, sums, strict=True):
            q += g * g
            x += rate * g / np.sqrt(q)
    return Crf(features, w, trans, start)
