"""The network's steps against a plain form, and what a window's gradient holds."""

from __future__ import annotations

import tracemalloc

import numpy as np

from flowsentry.llm import lm


def tables() -> lm.Vocabulary:
    class_of = (np.arange(lm.UNITS) * lm.CLASSES // lm.UNITS).astype(np.int16)
    members = [np.flatnonzero(class_of == c) for c in range(lm.CLASSES)]
    slot_of = np.concatenate([np.arange(len(m)) for m in members])
    return lm.Vocabulary(1, 1, np.zeros(0, np.uint64), np.zeros(0), np.zeros(1, np.uint64), np.zeros(1, int), np.zeros(65536, np.int16),
                         np.ones(lm.UNITS), np.full(lm.UNITS, 1 / lm.UNITS), class_of, slot_of.astype(np.int16), members)


def plain(net: lm.Network, h: np.ndarray, units: np.ndarray) -> float:
    """Natural log-probability of one document's units, a step and a full softmax at a time."""
    n, p, v, before, total = net.h, net.p, net.v, 0, 0.0
    for u in units:
        x, g = p["x"][before].astype(float), h @ p["w"]
        r, z = (1 / (1 + np.exp(-(x[a:a + n] + g[a:a + n]))) for a in (0, n))
        cand = np.tanh(x[2 * n:] + r * g[2 * n:])
        h = cand + z * (h - cand)
        m = v.members[v.class_of[u]]
        for logits, k in ((h @ p["c"] + p["cb"], v.class_of[u]), (p["u"][m] @ h + p["ub"][m], v.slot_of[u])):
            total += logits[k] - logits.max() - np.log(np.exp(logits - logits.max()).sum())
        before = u
    return total


def test_unit_scores_equal_plain_steps():
    rng = np.random.default_rng(11)
    net = lm.Network(tables())
    net.flat += rng.normal(0, 0.3, net.flat.shape).astype(np.float32)
    docs = [np.append(rng.integers(1, lm.UNITS, n), 0).astype(np.int16) for n in (0, 1, 40, 9, 130)]
    for far in (1, 60):         # with 60, logits leave the range in which no shift is needed
        net.p["u"][:] *= far
        want = [plain(net, np.zeros(net.h), d) for d in docs]
        assert np.allclose(lm.score_units(net, docs, 3, 7), want, rtol=1e-4)


def test_gradient_holds_few_copies_of_a_window():
    net = lm.Network(tables())
    rng = np.random.default_rng(13)
    steps, slots = 20, 256
    target, feed = (rng.integers(0, lm.UNITS, (steps, slots)).astype(np.int16) for _ in range(2))
    fresh, live = np.zeros((2, steps, slots), bool)
    live[:] = True
    tracemalloc.start()
    lm.gradient(net, np.zeros((slots, net.h), np.float32), target, feed, fresh, live)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6.5e6         # 7.3 MB with every gate of the window once more for the way back
