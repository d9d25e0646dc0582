"""Toxicity by weak supervision (operator 5).

1. A bounded sample of labelled training rows (about ``sample`` rows) proposes voters: words
   (the lexicon) and word beginnings of 4 to 6 bytes (patterns) that mark toxic rows and hardly
   ever others, taken greedily until toxic rows are covered several times over.  A fixed seed
   lexicon votes as well.
2. A generative label model, fitted by expectation-maximisation on the votes alone, estimates
   how often each voter fires on toxic and on clean rows and how voters correlate within the
   classes; correlated voters share their say in the posterior.
3. A linear classifier over hashed words and word beginnings is trained on the posterior labels.
   Its margin is the score; the labels of the training rows only calibrate the scale.

Learning reads only rows with crc32(doc_id) mod 4 other than 2; a score reads the text alone.

Edge cases: a NULL or empty text scores like a text without a marked word; without labelled
rows only the seed lexicon votes; NULL labels and NULL ids teach nothing; a label that repeats
for an id counts once (toxic if any says so); repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM_WORDS, Words, mix
from .common import held_out, keep_rows, learnable, text_chunks

#: fixed values: mild insults that vote from the start
SEED_LEXICON = ("idiot", "stupid", "moron", "loser", "trash", "scum", "clown", "pathetic", "worthless",
                "disgusting", "dumb", "imbecile", "jerk", "fool")
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
_SALT = mix(np.arange(101, 109, dtype=np.uint64))


def features(raw: bytes, off: np.ndarray):
    """64-bit keys of all words and of the beginnings of longer words, with the row of each."""
    w = Words(raw, off, ALNUM_WORDS)
    length = w.ends - w.starts
    row = np.repeat(np.arange(len(off) - 1), np.diff(w.row_first))
    keys, rows = [w.hashes()], [row]
    for k, n in enumerate(PREFIXES):
        at = np.flatnonzero(length > n)
        keys.append(mix(w.load8(w.starts[at], np.full(len(at), n)) ^ _SALT[k]))
        rows.append(row[at])
    return np.concatenate(keys), np.concatenate(rows)


def word_key(word: str) -> np.uint64:
    raw = word.encode()
    return Words(raw, np.array([0, len(raw)]), ALNUM_WORDS).hashes()[0]


@dataclass
class Model:
    keys: np.ndarray        # sorted feature keys with a weight
    weights: np.ndarray
    voters: np.ndarray      # which of them are voters
    accuracy: np.ndarray    # posterior share of toxic rows among a voter's rows
    bias: float
    scale: float
    shift: float

    def margins(self, raw: bytes, off: np.ndarray) -> np.ndarray:
        """Linear score per row over the distinct features it holds."""
        key, row = features(raw, off)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        pair = np.unique(row[hit] * len(self.keys) + at[hit])
        out = np.full(len(off) - 1, self.bias)
        np.add.at(out, pair // max(len(self.keys), 1), self.weights[pair % max(len(self.keys), 1)])
        return out

    def scores(self, raw: bytes, off: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.scale * self.margins(raw, off) + self.shift, -30, 30)))


def sample_features(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list, float]:
    """``(toxic, distinct feature keys)`` of about ``sample`` labelled training rows; the share of toxic labels.

    All toxic rows are wanted first: half of the sample goes to either label if there are enough.
    """
    y = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(learnable(F.col("doc_id"), 4))
         .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sizes = {r["toxic"]: r["n"] for r in y.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for k, n in sizes.items():
        share = F.when(F.col("toxic") == k, F.lit(min(1.0, sample / 2 / n))).otherwise(share)
    y = y.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic-sample")), F.lit(1 << 40)) < share * F.lit(1 << 40))

    def run(batches):
        for batch in batches:
            for i, raw, off in text_chunks(batch.column(0)):
                key, row = features(raw, off)
                order = np.argsort(row, kind="stable")
                key, cut = key[order], np.searchsorted(row[order], np.arange(len(off)))
                rows = [np.unique(key[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.binary()), batch.column(1).slice(i, len(rows)).cast(pa.int32())], ["x", "toxic"])

    joined = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")      # y: about `sample` rows
    got = joined.select("text", "toxic").mapInArrow(run, "x binary, toxic int").toArrow()
    rows = [(y, np.frombuffer(x.as_buffer(), np.uint64)) for x, y in zip(got.column("x"), got.column("toxic").to_pylist())]    # views
    return rows, sum(n for k, n in sizes.items() if k) / max(sum(sizes.values()), 1)


def key_counts(lists: list, at_once: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and in how many lists each occurs.

    Lists are merged in runs of about ``at_once`` keys, so the driver holds distinct keys and one run.
    """
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    run, held = [], 0
    for k, x in enumerate(lists):
        run.append(x)
        held += len(x)
        if held >= at_once or k == len(lists) - 1:
            new, n = np.unique(np.concatenate(run), return_counts=True)
            at = np.searchsorted(keys, new)
            known = np.append(keys, 0)[at] == new
            known &= at < len(keys)
            counts[at[known]] += n[known]
            keys, counts = np.insert(keys, at[~known], new[~known]), np.insert(counts, at[~known], n[~known])
            run, held = [], 0
    return keys, counts


def propose_voters(rows: list, most: int = 160, cover: int = 4, least: int = 4, candidates: int = 4000) -> np.ndarray:
    """Keys of features that mark toxic rows: greedy cover, the widest first, precision at least 0.9."""
    toxic = [x for y, x in rows if y]
    if not toxic:
        return np.zeros(0, np.uint64)
    key, n = key_counts(toxic)
    key, n = key[n >= least], n[n >= least]
    clean = np.zeros(len(key), np.int64)
    n_clean = 0
    for y, x in rows:
        if not y:
            n_clean += 1
            at = np.searchsorted(x, key)
            ok = at < len(x)
            clean[ok] += x[at[ok]] == key[ok]
    rate = clean * (len(toxic) / max(n_clean, 1))
    good = n >= 9 * rate
    key, n = key[good], n[good]
    wide = np.argsort(-n, kind="stable")[:candidates]
    key, n = key[wide], n[wide]
    has = np.empty((len(toxic), len(key)), bool)
    for i, x in enumerate(toxic):
        has[i] = np.isin(key, x, assume_unique=True)
    need = np.full(len(toxic), cover)
    gain = has.sum(axis=0)      # of rows that are not covered yet
    chosen: list[int] = []
    while len(chosen) < min(most, len(key)):
        left = gain.copy()
        left[chosen] = 0
        k = int(left.argmax())
        if left[k] < least:
            break
        chosen.append(k)
        need[has[:, k]] -= 1
        gain -= has[has[:, k] & (need == 0)].sum(axis=0)
    return key[chosen]


def label_model(votes: np.ndarray, prior: float, steps: int = 60):
    """Posterior P(toxic | votes) and voter accuracies by expectation-maximisation.

    Class-conditional firing rates are the model's parameters; the correlations of the votes within
    the classes discount each voter's log-odds, so that voters which fire together are not counted
    as independent evidence.
    """
    n, j = votes.shape
    if not j:
        return np.full(n, prior), np.zeros(0)
    v = votes.astype(float)
    post = np.where(v.any(axis=1), 0.9, 0.02)
    pi = prior
    for _ in range(steps):
        a = (post @ v + 0.5) / (post.sum() + 1)
        b = ((1 - post) @ v + 0.01) / ((1 - post).sum() + 1)
        da, db = v - a, v - b
        cov = ((da * post[:, None]).T @ da + (db * (1 - post)[:, None]).T @ db) / n
        spread = np.sqrt(np.diag(cov)) + 1e-9
        alike = np.clip(np.abs(cov / np.outer(spread, spread)) - 0.1, 0, 1)     # chance level taken off
        np.fill_diagonal(alike, 0)
        say = 1 / (1 + alike.sum(axis=1))
        none = ~v.any(axis=1)
        quiet = np.log(((post @ none) + 0.5) / (post.sum() + 1)) - np.log(((1 - post) @ none + 0.5) / ((1 - post).sum() + 1))
        logit = v @ (say * np.log(a / b)) + quiet * none + np.log(pi / (1 - pi))
        now = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        pi = float(np.clip(now.mean(), 1e-3, 0.9))
        done = np.abs(now - post).max() < 1e-4
        post = now
        if done:
            break
    fires = v.sum(axis=0)
    return post, (post @ v + 0.5) / (fires + 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, features_kept: int = 4096) -> Model:
    model = fit_sample(docs, labels, sample, features_kept)
    pa.default_memory_pool().release_unused()       # what the sample took on the driver
    return model


def fit_sample(docs: DataFrame, labels: DataFrame, sample: int, features_kept: int) -> Model:
    rows, prior = sample_features(docs, labels, sample)
    seeds = np.array([word_key(w) for w in SEED_LEXICON], np.uint64)
    voters = np.unique(np.concatenate([seeds, propose_voters(rows)]))
    if not rows:
        return Model(voters, np.full(len(voters), 4.0), np.ones(len(voters), bool), np.full(len(voters), 0.5), -2.0, 1.0, 0.0)
    y = np.array([bool(t) for t, _ in rows])
    votes = np.array([np.isin(voters, x, assume_unique=True) for _, x in rows])
    post, accuracy = label_model(votes, float(np.clip(y.mean(), 0.02, 0.6)))
    # linear classifier on posterior labels: the voters, and those of the most frequent other features
    # whose share among toxic rows differs beyond chance
    common, n = key_counts([x for _, x in rows])
    common = np.sort(common[np.argsort(-n, kind="stable")[:features_kept]])
    n1, n0 = max(post.sum(), 1e-9), max((1 - post).sum(), 1e-9)
    p1, p0, p = np.zeros(len(common)), np.zeros(len(common)), np.zeros(len(common))
    for (_, r), toxic in zip(rows, post):
        has = np.isin(common, r, assume_unique=True)
        p1[has] += toxic / n1
        p0[has] += (1 - toxic) / n0
        p[has] += 1.0 / len(rows)
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    keys = np.unique(np.concatenate([voters, common[z > 5]]))
    x = np.array([np.isin(keys, r, assume_unique=True) for _, r in rows], np.float32)
    w, b = np.zeros(len(keys), np.float32), np.float32(-1.0)
    is_voter = np.isin(keys, voters)
    penalty = np.where(is_voter, 1e-4, 1e-1).astype(np.float32)      # a common word is weak evidence
    weigh = np.where(post > 0.5, 0.5 / max((post > 0.5).mean(), 1e-3), 0.5 / max((post <= 0.5).mean(), 1e-3))
    weigh = (weigh / weigh.sum()).astype(np.float32)
    target = post.astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, 301):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        d = (p - target) * weigh
        g = x.T @ d + penalty * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.05 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
        b -= np.float32(2.0 * d.sum())
    # calibration: one-dimensional logistic fit to the labels of the sample
    f = (x @ w + b).astype(float)
    design = np.column_stack([f, np.ones(len(f))])
    line = np.array([1.0, 0.0])
    side = np.where(y, prior / max(y.mean(), 1e-3), (1 - prior) / max(1 - y.mean(), 1e-3)) / len(y)   # as all labels
    for _ in range(50):     # Newton steps, held near the start by a small penalty
        p = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
        gradient = design.T @ ((p - y) * side) + 1e-3 * (line - [1.0, 0.0])
        curve = (design * (p * (1 - p) * side)[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        line = line - step / max(1.0, np.abs(step).max())
    scale, shift = line
    keep = np.abs(w) > 1e-4
    keep |= is_voter
    return Model(keys[keep], w[keep].astype(float), is_voter[keep], accuracy, float(b), float(max(scale, 0.1)), float(shift))


def score(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches):
        for batch in batches:
            s = [shared.value.scores(raw, off) for _, raw, off in text_chunks(batch.column(1))]
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(s),
                 pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out(F.col("doc_id"), 4).alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """Rows that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def test(batch):
        texts = batch.column(batch.schema.get_field_index("text"))
        s = [shared.value.scores(raw, off) for _, raw, off in text_chunks(texts)]
        return (np.concatenate(s) if s else np.zeros(0)) < THRESHOLD

    return keep_rows(docs, test)
