"""Gated recurrent language model with a class-factored softmax (operator 8).

A word's probability is factored as ``P(class | state) * P(unit | class, state) * P(word | unit)``.
Units are the most frequent words (one unit each), the end of a document, and buckets of the
other words by their last two bytes; classes are bins of units of equal frequency.  Class and
unit come from a gated recurrent network in numpy; ``P(word | unit)`` is the add-one estimate
``(c + 1) / (N_unit + V_unit + 1)`` from the counts of all training documents.

* Counts: every training document, summed per task before the shuffle.
* Network: trained by truncated backpropagation on every training document, once.  Documents are dealt by
  hash to rounds and groups; in each round every group starts from the common parameters and
  streams its documents in blocks of about ``block_tokens``, and the groups' results are averaged.
* Scoring: many documents run side by side as slots of one batch; a slot's state is carried
  from window to window until its document ends, so the score covers complete documents.
* The counts of the ``head`` most frequent words (a bounded table) are broadcast.  Other words
  meet their counts in a shuffle join, keyed by the word.

Edge cases: a NULL or empty text has the end token alone; a NULL ``doc_id`` is scored but never
learned from; repeated rows are scored each; with no training documents every count is 0 and
the network keeps its initial, uniform state; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import WHITESPACE_WORDS, Words
from .common import drop_scratch, held_out, learnable, scratch, text_chunks

#: key and suffix of the end token (no word has this suffix: words hold no zero byte pair)
END = np.uint64(0x5E0D0F7EE7D0C0DE)
END_SUFFIX = 0

UNITS, CLASSES, HEAD_UNITS = 512, 24, 300
HIDDEN = 16
SLOTS, ROUNDS, RATE = 256, 2, 0.03


def text_tokens(words: Words):
    """Keys and suffixes of all words of a run of rows."""
    length = words.ends - words.starts
    last = words.buf[words.ends - 1].astype(np.int32)
    before = np.where(length > 1, words.buf[words.ends - 2], 0).astype(np.int32)
    return words.hashes(), before * 256 + last


# --- counts ------------------------------------------------------------------------------------

def word_counts(docs: DataFrame, flush: int = 1 << 21) -> DataFrame:
    """``key, suffix, c`` of every token of ``docs``; summed per task in runs of ``flush`` tokens."""
    def run(batches):
        keys, suffixes, held, rows = [], [], 0, 0

        def out():
            key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            suffix = np.concatenate(suffixes) if suffixes else np.zeros(0, np.int32)
            u, at, c = np.unique(key, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(u, END).view(np.int64)), pa.array(np.append(suffix[at], END_SUFFIX).astype(np.int32)),
                 pa.array(np.append(c, rows).astype(np.int64))], ["key", "suffix", "c"])

        for batch in batches:
            rows += batch.num_rows
            for _, raw, off in text_chunks(batch.column(0)):
                k, s = text_tokens(Words(raw, off, WHITESPACE_WORDS))
                keys.append(k)
                suffixes.append(s)
                held += len(k)
                if held > flush:
                    yield out()
                    keys, suffixes, held, rows = [], [], 0, 0
        if rows or held:
            yield out()

    return (docs.select("text").mapInArrow(run, "key long, suffix int, c long")
            .groupBy("key").agg(F.first("suffix").alias("suffix"), F.sum("c").alias("c")))


# --- vocabulary ---------------------------------------------------------------------------------

@dataclass
class Vocabulary:
    """Bounded tables: head words with counts, unit of each suffix, unit totals, class of each unit."""

    total: int
    types: int
    head_key: np.ndarray     # sorted
    head_count: np.ndarray
    unit_key: np.ndarray     # sorted keys of the one-word units
    unit_id: np.ndarray
    suffix_unit: np.ndarray  # 65,536
    unit_total: np.ndarray   # N + V + 1 of a bucket, 1 of a one-word unit
    unit_prior: np.ndarray
    class_of: np.ndarray
    slot_of: np.ndarray
    members: list

    def units(self, key: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        out = self.suffix_unit[suffix]
        at = np.minimum(np.searchsorted(self.unit_key, key), len(self.unit_key) - 1)
        hit = self.unit_key[at] == key
        out[hit] = self.unit_id[at[hit]]
        return out


def vocabulary(counts: DataFrame, head: int) -> Vocabulary:
    """All tables from the counts; what reaches the driver is bounded by ``head`` and 65,536 suffixes."""
    total, types = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    total, types = int(total or 0), int(types or 0)
    ends = counts.where(F.col("key") == F.lit(int(END.view(np.int64)))).select("c").first()
    end_count = int(ends[0]) if ends else 0
    # the lowest count whose words, with all more frequent ones, fit the head table
    step = F.floor(F.log2("c") * 8)
    bins = sorted(((r["b"], r["n"]) for r in counts.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()),
                  reverse=True)
    least, room = None, head
    for b, n in bins:
        if n > room:
            break
        least, room = b, room - n
    if least is None:
        hk, hc = np.zeros(0, np.int64), np.zeros(0, np.int64)
    else:
        pdf = counts.where(step >= F.lit(least)).select("key", "c").toPandas()
        hk, hc = pdf["key"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64)
    key = hk.view(np.uint64)
    order = np.argsort(key)
    key, hc = key[order], hc[order]
    single = np.argsort(-hc, kind="stable")[:HEAD_UNITS]
    single = single[key[single] != END]
    one_word = [int(np.int64(key[i].view(np.int64))) for i in single]
    rows = (counts.where(~F.col("key").isin(one_word + [int(END.view(np.int64))])).groupBy("suffix")
            .agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toPandas())
    mass = np.zeros(65536)
    kinds = np.zeros(65536)
    mass[rows["suffix"].to_numpy(int)] = rows["c"].to_numpy(float)
    kinds[rows["suffix"].to_numpy(int)] = rows["v"].to_numpy(float)
    # unit 0: the end; then one-word units; then frequent suffixes; the rest by the last byte
    unit_key = np.append(END, key[single])
    unit_id = np.arange(len(unit_key))
    rest = 16
    own = np.argsort(-mass, kind="stable")[:UNITS - rest - len(unit_key)]
    suffix_unit = (UNITS - rest + np.arange(65536) % 256 % rest).astype(np.int16)
    suffix_unit[own] = len(unit_key) + np.arange(len(own))
    unit_total = np.ones(UNITS)
    unit_mass = np.zeros(UNITS)
    np.add.at(unit_total, suffix_unit, mass + kinds)
    np.add.at(unit_mass, suffix_unit, mass)
    unit_mass[:len(unit_key)] = np.append(end_count, hc[single])
    unit_total[:len(unit_key)] = unit_mass[:len(unit_key)] + 1      # one word: P(word | unit) = 1
    prior = (unit_mass + 1) / (unit_mass.sum() + UNITS)
    by_mass = np.argsort(-prior, kind="stable")
    share = np.cumsum(prior[by_mass]) - prior[by_mass]
    class_of = np.zeros(UNITS, np.int16)
    class_of[by_mass] = np.minimum((np.sqrt(share) * CLASSES).astype(int), CLASSES - 1)
    members = [np.flatnonzero(class_of == c) for c in range(CLASSES)]
    slot_of = np.zeros(UNITS, np.int16)
    for m in members:
        slot_of[m] = np.arange(len(m))
    o = np.argsort(unit_key)
    return Vocabulary(total, types, key, hc, unit_key[o], unit_id[o], suffix_unit, unit_total, prior,
                      class_of, slot_of, members)


# --- network ------------------------------------------------------------------------------------

def sigmoid(x):
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5


def slot_product(w, h, out=None):
    """``w @ h``; if the slots fill no whole registers, from their rows, which rounds alike for every slot."""
    if h.shape[1] % 16 == 0:
        return np.matmul(w, h, out=out)
    got = (h.T.copy() @ w.T.copy()).T
    if out is None:
        return got
    out[:] = got
    return out


class Network:
    """Gated recurrent units over unit numbers, two softmax levels; parameters are one flat vector."""

    def __init__(self, vocab: Vocabulary, flat: np.ndarray | None = None, hidden: int = HIDDEN):
        self.v, self.h = vocab, hidden
        shapes = {"x": (UNITS, 3 * hidden), "w": (hidden, 3 * hidden), "c": (hidden, CLASSES), "cb": (CLASSES,),
                  "u": (UNITS, hidden), "ub": (UNITS,)}
        size = sum(math.prod(s) for s in shapes.values())
        fresh = flat is None
        self.flat = np.zeros(size, np.float32) if fresh else flat.astype(np.float32)
        self.p, at = {}, 0
        for k, s in shapes.items():
            self.p[k] = self.flat[at:at + math.prod(s)].reshape(s)
            at += math.prod(s)
        self.shapes = shapes
        if fresh:   # starts as the unigram model of units
            rng = np.random.default_rng(7)
            self.p["x"][:] = rng.normal(0, 0.4, shapes["x"])
            self.p["w"][:] = rng.normal(0, hidden ** -0.5, shapes["w"])
            self.p["x"][:, hidden:2 * hidden] += 1.5     # keep much of the state
            mass = np.array([vocab.unit_prior[m].sum() if len(m) else 1e-9 for m in vocab.members])
            self.p["cb"][:] = np.log(mass)
            self.p["ub"][:] = np.log(vocab.unit_prior / mass[vocab.class_of])

    def fed(self, units):
        """The inputs' share of a step: number by slot."""
        return np.ascontiguousarray(self.p["x"].take(units, axis=0).T)

    def step(self, h, fed, rz, cand, share, back):
        """The state of all slots after one step from ``h`` with the inputs' share ``fed`` (number by slot each).

        Gates, candidate and its state share go to ``rz``, ``cand``, ``share``; ``back`` is ``w`` transposed.
        """
        n = self.h
        slot_product(back[:2 * n], h, rz)
        rz += fed[:2 * n]
        sigmoid(rz)
        slot_product(back[2 * n:], h, share)
        np.multiply(rz[:n], share, out=cand)
        cand += fed[2 * n:]
        np.tanh(cand, out=cand)
        new = h - cand
        new *= rz[n:]
        new += cand
        return new

    def output(self, states, target, grad: bool = False):
        """Natural log-probability of each target unit; with ``grad`` also the gradients of the negative sum."""
        p, cls = self.p, self.v.class_of[target]
        # no logits lie farther apart than twice this
        far = np.abs(states).max(initial=0)
        near = (far * np.abs(p["u"]).sum(axis=1) + np.abs(p["ub"])).max() < 29 and (
            far * np.abs(p["c"]).sum(axis=0) + np.abs(p["cb"])).max() < 29
        logits = states @ p["c"]
        logits += p["cb"]
        e, logp = softmax_parts(logits, cls, near, grad)
        order = np.argsort(cls, kind="stable")      # tokens of one class lie together from here on
        g = {}
        if grad:
            ds = (e @ p["c"].T).take(order, axis=0)
            g = {"c": states.T @ e, "cb": np.ones(len(e), e.dtype) @ e, "u": np.zeros_like(p["u"]), "ub": np.zeros_like(p["ub"])}
        cls, slot, states, logp = cls[order], self.v.slot_of[target[order]], states.take(order, axis=0), logp.take(order)
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
        for c, m in enumerate(self.v.members):
            a, b = cuts[c:c + 2]
            if a == b or len(m) < 2:
                continue
            u, st = p["u"].take(m, axis=0), states[a:b]
            logits = st @ u.T
            logits += p["ub"][m]
            e, part = softmax_parts(logits, slot[a:b], near, grad)
            logp[a:b] += part
            if grad:
                ds[a:b] += e @ u
                g["u"][m] = e.T @ st
                g["ub"][m] = np.ones(len(e), e.dtype) @ e
        out = np.empty_like(logp)
        out[order] = logp
        if not grad:
            return out
        back = np.empty_like(ds)
        back[order] = ds
        return out, back, g


def softmax_parts(logits, target, near: bool, grad: bool = False):
    """Log-probability of each row's target; with ``grad`` before it the gradient of its negative by the logits.

    The logits are overwritten.  One shift serves all rows unless the logits lie far apart (never, if ``near``).
    """
    top = logits.max()
    logits -= top if near or top - logits.min() < 60 else logits.max(axis=1, keepdims=True)
    at = np.arange(len(target)) * logits.shape[1] + target
    flat = logits.reshape(-1)
    logp = flat[at]
    e = np.exp(logits, out=logits)
    total = e @ np.ones(e.shape[1], e.dtype)
    logp -= np.log(total)
    if grad:
        e /= total[:, None]
        flat[at] -= 1
    return e, logp


class Layout:
    """Documents dealt over slots, longest first to the shortest slot; slots are sorted by length, longest first.

    The tokens lie in one flat array, slot after slot; a window of all live slots is cut out when
    it is needed, so memory is the tokens themselves and one window, however long a document is.
    """

    def __init__(self, docs: list[np.ndarray], slots: int):
        slots = max(1, min(slots, len(docs)))
        heap = [(0, s) for s in range(slots)]
        where: list[list[int]] = [[] for _ in range(slots)]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            n, s = heapq.heappop(heap)
            where[s].append(i)
            heapq.heappush(heap, (n + len(docs[i]), s))
        size = dict((s, n) for n, s in heap)
        by_size = sorted(range(slots), key=lambda s: -size[s])
        self.order = np.array([i for s in by_size for i in where[s]], np.int64)
        self.length = np.array([size[s] for s in by_size], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.target = np.concatenate([docs[i] for i in self.order])
        self.doc_begin = np.cumsum([0] + [len(docs[i]) for i in self.order[:-1]])
        self.first = np.zeros(len(self.target), bool)
        self.first[self.doc_begin] = True

    def windows(self, width: int):
        """``(place, live)`` of each window: token numbers (steps x slots) and which of them are tokens of the slot."""
        for a in range(0, int(self.length[0]), width):
            k = int(np.searchsorted(-self.length, -a, "left"))          # slots with tokens left at a
            steps = np.arange(a, min(a + width, int(self.length[0])))
            live = steps[:, None] < self.length[None, :k]
            yield np.where(live, self.begin[None, :k] + steps[:, None], self.begin[None, :k]), live

    def feed(self, place: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """The unit before each token; the end unit (0) starts a document."""
        return np.where(fresh, 0, self.target[np.maximum(place - 1, 0)])


def score_units(net: Network, docs: list[np.ndarray], slots: int = 512, window: int = 32) -> np.ndarray:
    """Natural log-probability of each document's units, the state carried across windows."""
    if not docs:
        return np.zeros(0)
    lay = Layout(docs, slots)
    logp = np.zeros(len(lay.target), np.float32)
    n, back = net.h, net.p["w"].T.copy()
    h = np.zeros((n, len(lay.length)), np.float32)
    for place, live in lay.windows(window):
        fresh = lay.first[place]
        feed = lay.feed(place, fresh)
        steps, k = place.shape
        hs, (rz, cand, share) = np.empty((steps, k, n), np.float32), (np.empty((m, k), np.float32) for m in (2 * n, n, n))
        h, keep = h[:, :k], ~fresh
        for t in range(steps):
            h = net.step(h * keep[t], net.fed(feed[t]), rz, cand, share, back)
            hs[t] = h.T
        at = place[live]
        logp[at] = net.output(hs[live], lay.target[at])
    out = np.zeros(len(docs))
    out[lay.order] = np.add.reduceat(logp.astype(np.float64), lay.doc_begin)
    return out


class Adam:
    """Moments and step count of one run of training, kept from block to block."""

    def __init__(self, size: int):
        self.m, self.v, self.steps = np.zeros(size, np.float32), np.zeros(size, np.float32), 0


def blocks(docs, block_tokens: int):
    """Runs of whole documents of at least ``block_tokens``; a rest below half of that joins the run before."""
    last, held, n = [], [], 0
    for d in docs:
        held.append(d)
        n += len(d)
        if n >= block_tokens:
            if last:
                yield last
            last, held, n = held, [], 0
    if last and 2 * n >= block_tokens:
        yield last
        last = []
    if last or held:
        yield last + held


def gradient(net: Network, h: np.ndarray, target, feed, fresh, live):
    """Summed negative log-probability of a window's live tokens (steps x slots) from state ``h`` on.

    Returns the loss, its gradients by parameter and the state after the window.
    """
    steps, k = target.shape
    n, dtype = net.h, net.flat.dtype
    keep, back = ~fresh, net.p["w"].T.copy()
    # by step, number of the state or gate, slot: all slots lie side by side
    prev, cand, share = (np.empty((steps, n, k), dtype) for _ in range(3))
    rz, states = np.empty((steps, 2 * n, k), dtype), np.empty((steps, k, n), dtype)
    h = np.ascontiguousarray(h.T)
    for t in range(steps):
        np.multiply(h, keep[t], out=prev[t])
        h = net.step(prev[t], net.fed(feed[t]), rz[t], cand[t], share[t], back)
        states[t] = h.T
    at = np.flatnonzero(live)
    logp, ds, g = net.output(states.reshape(-1, n).take(at, axis=0), target.reshape(-1)[at], grad=True)
    d_out = states      # no longer needed
    d_out[:] = 0
    d_out.reshape(-1, n)[at] = ds
    d_fed, x, w = np.empty((steps, k, 3 * n), dtype), np.empty((3 * n, k), dtype), np.empty((3 * n, k), dtype)
    before, d_state, dh = np.empty((steps, k, n), dtype), np.empty((steps, k, 3 * n), dtype), np.zeros((n, k), dtype)
    for t in range(steps - 1, -1, -1):
        r, z, c = rz[t, :n], rz[t, n:], cand[t]
        dh += d_out[t].T
        dn, dz, dr = x[2 * n:], x[n:2 * n], x[:n]
        rest = 1 - z
        np.subtract(prev[t], c, out=dz)
        dz *= z
        dz *= rest
        dz *= dh
        np.multiply(c, c, out=dn)
        np.subtract(1, dn, out=dn)
        dn *= rest
        dn *= dh
        np.multiply(share[t], r, out=dr)
        dr *= 1 - r
        dr *= dn
        d_fed[t] = x.T
        w[:2 * n] = x[:2 * n]
        np.multiply(dn, r, out=w[2 * n:])
        before[t], d_state[t] = prev[t].T, w.T
        dh *= z
        dh += slot_product(net.p["w"], w)
        dh *= keep[t]
    g["w"] = before.reshape(-1, n).T @ d_state.reshape(-1, 3 * n)
    g["x"] = np.zeros_like(net.p["x"])
    fed = feed.reshape(-1)
    order = np.argsort(fed, kind="stable")
    unit, at = np.unique(fed[order], return_index=True)
    g["x"][unit] = np.add.reduceat(d_fed.reshape(-1, 3 * n).take(order, axis=0), at, axis=0)
    h = h.T
    return -float(logp.sum()), g, h


def train(net: Network, docs: list[np.ndarray], slots: int = SLOTS, window: int = 20, rate: float = 0.01,
          adam: Adam | None = None) -> float:
    """Truncated backpropagation through time with Adam; returns the mean loss per token."""
    lay = Layout(docs, slots)
    h = np.zeros((len(lay.length), net.h), net.flat.dtype)
    adam = adam or Adam(len(net.flat))
    m, v = adam.m, adam.v
    loss, seen, total = 0.0, 0, len(lay.target)
    for place, live in lay.windows(window):
        fresh = lay.first[place]
        lost, g, h = gradient(net, h[:place.shape[1]], lay.target[place], lay.feed(place, fresh), fresh, live)
        count = int(live.sum())
        grad = np.concatenate([g[k].reshape(-1) for k in net.shapes]) / count
        norm = float(np.sqrt((grad * grad).sum()))
        if norm > 1:
            grad /= norm
        adam.steps += 1
        m += 0.1 * (grad - m)
        v += 0.005 * (grad * grad - v)
        pace = rate * min(1.0, 1.5 * (1 - seen / total) + 0.05)
        net.flat -= pace * (m / (1 - 0.9 ** adam.steps)) / (np.sqrt(v / (1 - 0.995 ** adam.steps)) + 1e-6)
        loss += lost
        seen += count
    return loss / max(seen, 1)


# --- distributed fit and score ----------------------------------------------------------------

def _unit_docs(vocab: Vocabulary, column):
    """Unit numbers (the end included), keys and suffixes of each row."""
    for _, raw, off in text_chunks(column):
        w = Words(raw, off, WHITESPACE_WORDS)
        key, suffix = text_tokens(w)
        unit = vocab.units(key, suffix)
        for a, b in zip(w.row_first[:-1], w.row_first[1:]):
            yield np.append(unit[a:b], 0).astype(np.int16), key[a:b]


def fit(train_docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, block_tokens: int = 1 << 20) -> tuple[np.ndarray, int]:
    """Rounds of local training per group of documents and token-weighted averaging of the parameters.

    Every document is learned from once: a hash of id and text deals it to one of ``rounds`` parts and to one
    of a number of groups that grows with the square root of the corpus, and orders it there, so
    the result depends neither on the partitions of the table nor on the cluster.  Round ``r`` trains on
    part ``r``, each group from the average of the round before.
    Returns the parameters and the number of tokens learned from (the ends included).
    """
    spark = train_docs.sparkSession
    flat, total = Network(vocab).flat, 0
    groups = max(1, math.ceil(2 * math.sqrt(vocab.total / (1 << 20))))
    place = F.xxhash64("doc_id", "text")
    dealt = train_docs.select("text", place.alias("place"))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((vocab, flat))

        def units(batches):
            for batch in batches:
                rows = [u.tobytes() for u, _ in _unit_docs(shared.value[0], batch.column(0))]
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(rows, pa.binary())],
                                                 ["grp", "place", "units"])

        def stream(batches):
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(2)))

        def local(batches):
            vocab_, flat_ = shared.value
            for grp, rows in groupby(stream(batches), key=lambda r: r[0]):
                net, n = Network(vocab_, flat_.copy()), 0
                adam = Adam(len(net.flat))
                for docs in blocks((np.frombuffer(u, np.int16) for _, u in rows), block_tokens):
                    train(net, docs, rate=RATE / (k + 1), adam=adam)
                    n += sum(map(len, docs))
                yield pa.RecordBatch.from_arrays([pa.array([grp], pa.int32()), pa.array([n], pa.int64()),
                                                  pa.array([net.flat.tobytes()], pa.binary())], ["grp", "n", "flat"])

        def average(table):
            n = table.column("n").to_numpy().astype(np.float64)
            mean = sum(w * np.frombuffer(x.as_py(), np.float32).astype(np.float64)
                       for w, x in zip(n / n.sum(), table.column("flat")))
            return pa.table({"n": pa.array([int(n.sum())], pa.int64()),
                             "flat": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

        part = F.pmod(F.col("place"), F.lit(groups * rounds))
        rows = (dealt.where(F.floor(part / groups) == k).select("text", (part % groups).cast("int").alias("grp"), "place")
                .mapInArrow(units, "grp int, place long, units binary"))
        parts = (rows.repartition(groups, "grp").sortWithinPartitions("grp", "place", "units")
                 .mapInArrow(local, "grp int, n long, flat binary"))
        parts = scratch(parts, "lm-parts")
        bundles = max(1, math.isqrt(groups))
        means = (parts.groupBy((F.col("grp") % bundles).alias("g")).applyInArrow(average, "n long, flat binary").collect())
        n = sum(r["n"] for r in means)
        if n:
            flat = sum(r["n"] / n * np.frombuffer(r["flat"], np.float32).astype(np.float64) for r in means).astype(np.float32)
        total += n
        drop_scratch(parts)
    return flat, total


SCORE_SCHEMA = ("doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, unit_log double, "
                "tail array<struct<key:long,m:int>>")


def score_documents(docs: DataFrame, head: int = 1 << 18, rounds: int = ROUNDS, block_tokens: int = 1 << 21) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``."""
    spark = docs.sparkSession
    learn = docs.where(learnable(F.col("doc_id"), 7))
    counts = scratch(word_counts(learn), "lm-counts")
    vocab = vocabulary(counts, head)
    flat, _ = fit(learn, vocab, rounds)
    shared = spark.sparkContext.broadcast((vocab, flat))

    def run(batches):
        vocab_, flat_ = shared.value
        net = Network(vocab_, flat_)
        log_total = np.log10(vocab_.unit_total)
        held = {"units": [], "n": 0, "rows": []}

        def flush():
            unit_log = score_units(net, held["units"]) / math.log(10)
            rows = held["rows"]
            tails = [r[4] for r in rows]
            off = np.cumsum([0] + [len(t[0]) for t in tails]).astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays(
                [pa.array(np.concatenate([t[0] for t in tails]).view(np.int64)),
                 pa.array(np.concatenate([t[1] for t in tails]).astype(np.int32))], ["key", "m"]))
            unit_log -= [log_total[u].sum() for u in held["units"]]
            out = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()),
                 pa.array([len(u) for u in held["units"]], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([r[3] for r in rows], pa.float64()), pa.array(unit_log, pa.float64()), tail],
                ["doc_id", "held_out", "n_tokens", "head_known", "head_log", "unit_log", "tail"])
            held.update(units=[], n=0, rows=[])
            return out

        for batch in batches:
            ids, flag = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, (unit, key) in enumerate(_unit_docs(vocab_, batch.column(1))):
                u, m = np.unique(np.append(key, END), return_counts=True)
                if len(vocab_.head_key):
                    at = np.minimum(np.searchsorted(vocab_.head_key, u), len(vocab_.head_key) - 1)
                    hit = vocab_.head_key[at] == u
                    c = vocab_.head_count[at[hit]]
                else:
                    hit, c = np.zeros(len(u), bool), np.zeros(0)
                held["units"].append(unit)
                held["rows"].append((ids[i], flag[i], int(m[hit].sum()), float((m[hit] * np.log10(c + 1.0)).sum()),
                                     (u[~hit], m[~hit])))
                held["n"] += len(unit)
                if held["n"] >= block_tokens:
                    yield flush()
        if held["rows"]:
            yield flush()

    scored = docs.select("doc_id", "text", held_out(F.col("doc_id"), 7).alias("held_out")).mapInArrow(run, SCORE_SCHEMA)
    scored = scratch(scored.withColumn("uid", F.monotonically_increasing_id()), "lm-scored")
    tail = (scored.select("uid", F.inline("tail")).join(counts.select("key", "c"), "key", "left")
            .groupBy("uid").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("m"))).alias("tail_known"),
                                F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("tail_log")))
    zero = F.lit(0)
    known = F.col("head_known") + F.coalesce("tail_known", zero)
    logs = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0))
    one_word = F.col("unit_log")
    return scored.drop("tail").join(tail, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(math.log10(vocab.total + vocab.types + 1))).alias("base_score"),
        (one_word + logs).alias("score"))
