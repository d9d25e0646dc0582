"""Quality by a weak-label model (operator 4).

1. Overlapping heuristic labellers vote good, bad or abstain on every whole text.
2. Expectation-maximisation over the counts of all vote patterns (at most 3^9 numbers, counted
   over the whole table) estimates how each labeller votes on good and on bad documents.
3. The posterior labels of a bounded sample (about ``sample`` rows) train a linear scorer over
   hashed words, word shapes and text statistics; it scores every document.

Edge cases: a NULL or empty text gets the labellers' votes for an empty text; repeated rows are
scored each; NULL ids are carried through; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import WHITESPACE_WORDS, Words, mix
from .common import hash_share, keep_rows, text_chunks

LABELLERS = ("length", "word_size", "capitals", "symbols", "digits", "shouting", "variety", "top_word", "repeated_lines")
BINS = 1 << 13
KEEP = 0.5

_KIND = np.zeros(256, np.uint8)         # 0 blank, 1 lower, 2 upper, 3 digit, 4 symbol, 5 beyond ASCII
_KIND[33:128] = 4
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 3, 2, 1, 5


def statistics(raw: bytes, off: np.ndarray, words: Words, keys: np.ndarray) -> np.ndarray:
    """Row x statistic: words, bytes a word, shares of capitals, symbols and digits, exclamation marks
    a word, distinct words, most frequent word, repeated lines."""
    n = len(off) - 1
    buf = np.frombuffer(raw, np.uint8)
    kind = _KIND[buf]

    def per_row(flag):
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return (total[off[1:]] - total[off[:-1]]).astype(float)

    lower, upper, digit, symbol, high = (per_row(kind == k) for k in range(1, 6))
    bangs = per_row(buf == 33)
    solid = np.maximum(lower + upper + digit + symbol + high, 1)
    count = np.diff(words.row_first).astype(float)
    out = np.zeros((n, len(LABELLERS)))
    out[:, 0] = count
    out[:, 1] = solid / np.maximum(count, 1)
    out[:, 2] = upper / np.maximum(lower + upper + high, 1)
    out[:, 3] = symbol / solid
    out[:, 4] = digit / solid
    out[:, 5] = bangs / np.maximum(count, 1)
    for i in range(n):
        k = keys[words.row_first[i]:words.row_first[i + 1]]
        if len(k):
            _, c = np.unique(k, return_counts=True)
            out[i, 6], out[i, 7] = len(c) / len(k), c.max() / len(k)
        lines = [x for x in raw[off[i]:off[i + 1]].split(b"\n") if x.strip()]
        out[i, 8] = 1 - len(set(lines)) / len(lines) if lines else 0.0
    return out


def votes(s: np.ndarray) -> np.ndarray:
    """Row x labeller: 1 good, -1 bad, 0 abstain."""
    count = s[:, 0]
    enough = count >= 20

    def band(x, good, bad, on=True):
        return np.where(on & good, 1, np.where(on & bad, -1, 0))

    return np.column_stack([
        band(count, count >= 40, count < 8),
        band(s, (s[:, 1] > 3) & (s[:, 1] < 10), (s[:, 1] < 2) | (s[:, 1] > 15)),
        band(s, s[:, 2] < 0.15, s[:, 2] > 0.3),
        band(s, s[:, 3] < 0.07, s[:, 3] > 0.12),
        band(s, s[:, 4] < 0.05, s[:, 4] > 0.2),
        band(s, s[:, 5] < 0.02, s[:, 5] > 0.1),
        band(s, s[:, 6] > 0.35, s[:, 6] < 0.2, enough),
        band(s, s[:, 7] < 0.12, s[:, 7] > 0.25, enough),
        band(s, s[:, 8] < 0.1, s[:, 8] > 0.3)]).astype(np.int8)


def label_model(patterns: np.ndarray, n: np.ndarray, steps: int = 100):
    """EM on vote patterns with counts: P(good), and per labeller P(vote | class) as class x labeller x vote."""
    post = 1 / (1 + np.exp(-2.0 * (patterns.sum(axis=1) - 0.4 * patterns.shape[1])))   # begins as a majority
    hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(steps):
        theta = []
        for p in (1 - post, post):
            w = p * n
            t = np.einsum("i,ijk->jk", w, hot) + 0.1
            theta.append(t / t.sum(axis=1, keepdims=True))
        theta = np.array(theta)
        prior = float(np.clip((post * n).sum() / max(n.sum(), 1), 1e-3, 1 - 1e-3))
        like = np.einsum("ijk,cjk->ci", hot, np.log(theta))
        now = 1 / (1 + np.exp(np.clip(like[0] - like[1] + np.log((1 - prior) / prior), -30, 30)))
        done = np.abs(now - post).max() < 1e-6
        post = now
        if done:
            break
    return prior, theta


def posterior(v: np.ndarray, prior: float, theta: np.ndarray) -> np.ndarray:
    hot = np.stack([v == x for x in (-1, 0, 1)], axis=2).astype(float)
    like = np.einsum("ijk,cjk->ci", hot, np.log(theta))
    return 1 / (1 + np.exp(np.clip(like[0] - like[1] + np.log((1 - prior) / prior), -30, 30)))


def examine(column, with_bins: bool = True):
    """Yield ``(first row, statistics, votes, hashed features)`` of runs of rows."""
    for i, raw, off in text_chunks(column):
        words = Words(raw, off, WHITESPACE_WORDS)
        keys = words.hashes()
        s = statistics(raw, off, words, keys)
        bins = None
        if with_bins:
            buf = np.frombuffer(raw + bytes(8), np.uint8)
            shape = np.zeros(len(words.starts), np.uint64)
            length = words.ends - words.starts
            for k in range(4):      # shape: kinds of the first and last bytes
                a = _KIND[buf[np.minimum(words.starts + k, words.ends - 1)]]
                b = _KIND[buf[np.maximum(words.ends - 1 - k, words.starts)]]
                shape = shape * np.uint64(64) + a.astype(np.uint64) * np.uint64(8) + b
            shape = mix(shape * np.uint64(32) + np.minimum(length, 20).astype(np.uint64) + np.uint64(1 << 40))
            bins = (keys % np.uint64(BINS // 2)).astype(np.int64), (BINS // 2 + shape % np.uint64(BINS // 2)).astype(np.int64)
        yield i, s, votes(s), words, bins


def dense(s: np.ndarray) -> np.ndarray:
    """Statistics on a common scale, with a constant."""
    x = np.column_stack([np.log1p(s[:, 0]) / 5, np.minimum(s[:, 1], 30) / 10, s[:, 2] * 3, s[:, 3] * 5, s[:, 4] * 5,
                         np.minimum(s[:, 5], 2), s[:, 6], s[:, 7] * 2, s[:, 8] * 2])
    return np.column_stack([x, np.ones(len(x))])


def row_features(words: Words, bins) -> np.ndarray:
    out = np.zeros((len(words.row_first) - 1, BINS), np.float32)
    for i, (a, b) in enumerate(zip(words.row_first[:-1], words.row_first[1:])):
        if b > a:
            out[i] = (np.bincount(bins[0][a:b], minlength=BINS) + np.bincount(bins[1][a:b], minlength=BINS)) / (b - a)
    return out


def fit(docs: DataFrame, sample: int = 3000):
    """Label model over all documents, then the scorer on a sample."""
    def pattern_rows(batches):
        for batch in batches:
            for _, _, v, _, _ in examine(batch.column(0), with_bins=False):
                u, c = np.unique(v, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in u], pa.binary()), pa.array(c)], ["p", "n"])

    counted = docs.select("text").mapInArrow(pattern_rows, "p binary, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()
    if not counted:
        return None
    total = sum(r["n"] for r in counted)
    prior, theta = label_model(np.array([np.frombuffer(bytes(r["p"]), np.int8) for r in counted]),
                               np.array([r["n"] for r in counted], float))

    def sampled(batches):
        for batch in batches:
            for _, s, v, words, bins in examine(batch.column(0)):
                x = row_features(words, bins).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in dense(s)], pa.binary()),
                     pa.array(posterior(v, prior, theta))], ["x", "d", "y"])

    got = (docs.where(hash_share(F.col("doc_id"), sample / max(total, 1), "quality-sample")).select("text")
           .mapInArrow(sampled, "x binary, d binary, y double").collect())
    if not got:
        return prior, theta, np.zeros(BINS + 10)
    x = np.concatenate([np.array([np.frombuffer(bytes(r["x"]), np.float16) for r in got]).astype(np.float32),
                        np.array([np.frombuffer(bytes(r["d"]), np.float64) for r in got]).astype(np.float32)], axis=1)
    y = np.array([r["y"] for r in got], np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    weigh = np.where(y > 0.5, 0.5 / max((y > 0.5).mean(), 1e-3), 0.5 / max((y <= 0.5).mean(), 1e-3)) / len(y)
    for k in range(1, 301):
        g = x.T @ ((1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) * weigh).astype(np.float32) + 1e-4 * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.05 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return prior, theta, w.astype(float)


def _scores(model, column):
    prior, theta, w = model
    for _, s, v, words, (a, b) in examine(column):
        n = np.maximum(np.diff(words.row_first), 1)
        total = np.concatenate([[0.0], np.cumsum(w[a] + w[b])])
        f = (total[words.row_first[1:]] - total[words.row_first[:-1]]) / n + dense(s) @ w[BINS:]
        yield 1 / (1 + np.exp(-np.clip(f, -30, 30))), posterior(v, prior, theta), v


def score(docs: DataFrame, sample: int = 3000) -> DataFrame:
    """``doc_id, votes_good, votes_bad, posterior, score, predicted`` per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = list(_scores(shared.value, batch.column(1)))
            s, p = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
            v = np.concatenate([x[2] for x in parts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array((v > 0).sum(axis=1).astype(np.int32)),
                 pa.array((v < 0).sum(axis=1).astype(np.int32)), pa.array(p), pa.array(s),
                 pa.array((s >= KEEP).astype(np.int32))],
                ["doc_id", "votes_good", "votes_bad", "posterior", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, votes_good int, votes_bad int, posterior double, score double, predicted int")


def keep_good(docs: DataFrame, sample: int = 3000) -> DataFrame:
    """Rows that the scorer holds to be good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def test(batch):
        column = batch.column(batch.schema.get_field_index("text"))
        return np.concatenate([s for s, _, _ in _scores(shared.value, column)] or [np.zeros(0)]) >= KEEP

    return keep_rows(docs, test)
