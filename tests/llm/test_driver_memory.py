"""Memory of the fits on the driver."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from flowsentry.llm import langid, toxicity


def peak_of(run):
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_key_counts_hold_distinct_keys_only():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 40_000).astype(np.uint64)
    lists = [np.unique(rng.choice(pool, 8_000)) for _ in range(600)]
    (keys, counts), peak = peak_of(lambda: toxicity.key_counts(lists))
    want, n = np.unique(np.concatenate(lists), return_counts=True)
    assert np.array_equal(keys, want) and np.array_equal(counts, n)
    assert peak < 20e6          # all lists at once: 35 MB, and as much again for their marks and places
    keys, counts = toxicity.key_counts([np.zeros(0, np.uint64), np.array([0, 7, 1 << 63], np.uint64), np.array([7], np.uint64)], 1)
    assert keys.tolist() == [0, 7, 1 << 63] and counts.tolist() == [1, 2, 1]


def test_voters_are_a_plain_greedy_cover():
    rng = np.random.default_rng(5)
    rows = [(int(i < 150), np.unique(rng.choice(60, 8, p=np.arange(60, 0, -1) / 1830).astype(np.uint64) + np.uint64(100 * (i >= 150))))
            for i in range(300)]
    got = toxicity.propose_voters(rows)
    toxic = [set(x.tolist()) for y, x in rows if y]
    number = {k: sum(k in t for t in toxic) for k in set().union(*toxic)}
    keys = sorted((k for k, n in number.items() if n >= 4), key=lambda k: (-number[k], k))
    need, want = [4] * len(toxic), []
    while True:
        gain = [0 if k in want else sum(k in t and m > 0 for t, m in zip(toxic, need)) for k in keys]
        best = int(np.argmax(gain))
        if gain[best] < 4:
            break
        want.append(keys[best])
        need = [m - (keys[best] in t) for t, m in zip(toxic, need)]
    assert len(want) > 3 and got.tolist() == want


def test_language_sample_is_held_once():
    rng = np.random.default_rng(7)
    rows = pa.chunked_array([pa.array([r.tobytes() for r in rng.random((250, 4096)).astype(np.float16)], pa.binary()) for _ in range(4)])
    want = np.frombuffer(b"".join(rows.to_pylist()), np.float16).reshape(1000, -1).astype(np.float32)

    def run():
        x = langid.dense(rows, 4096)
        return x, langid.mean_squares(x)

    (x, squares), peak = peak_of(run)
    assert np.array_equal(x, want) and np.array_equal(squares, (want * want).mean(axis=0))
    assert peak < 1.5 * want.nbytes         # joined bytes, matrix and its square at once: 2.5 times
