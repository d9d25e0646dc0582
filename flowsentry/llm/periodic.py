"""Periodic runs of words by a suffix automaton with link-cut access (operator 12).

A run is a stretch of consecutive words with smallest period ``q`` that no neighbouring word
extends and that is at least ``max(min_length, min_exponent * q)`` words long.

``runs`` builds the suffix automaton of the words.  Then the words are appended once more in
their order: the state of the prefix that ends at word ``i`` is accessed in a link-cut forest over
the suffix links, which recolours its path to the root with ``i``.  The path falls into segments
of one old colour ``j``, the last end of the segment's strings, and the longest of them has
``L`` words.  Prefixes that end at ``i`` and ``j`` therefore agree on exactly ``L`` words, so the
stretch of ``L + p`` words before ``i`` has period ``p = i - j`` and cannot be extended to the
left.  Where ``L >= (min_exponent - 1) * p`` the period is the smallest (a smaller one would divide
it and have coloured the string later), and comparing words to the right gives the run.  A path
breaks into O(log n) segments on average, so a document takes O(n log n) steps.

Most texts have no run, and the automaton is built only for stretches that can hold one.  In a run
the words ``x`` and ``x + q`` start the same ``min_length * 2 / 3`` words at least (16 by default),
and both copies together cover all of it.  Windows of that many words are hashed with numpy;
a stretch covered by windows that occur again, in which two equal ones lie no further apart
than a third of it, goes through the automaton, whole.  This leaves no run out: the others have none.

Edge cases: a NULL or word-free text has no words, no run and an empty collapsed text; a NULL
``doc_id`` is treated as any other row; rows are independent, so repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Words, mix
from .common import text_chunks

MIN_LENGTH, MIN_EXPONENT = 24, 3

#: words are runs of anything but blank and 0x09-0x0D, letters as they are
PLAIN_WORDS = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

_SHIFT = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """States of a word sequence: ``length`` of the longest string, suffix ``link``, state of each prefix.

    Most states have one way on; it is kept in two lists, and a dict is made for the second.
    State 0 stands for "none", state 1 is the root.
    """

    def __init__(self, words: list[int]):
        length, link = [0, 0], [0, 0]
        word, to, more = [-1, -1], [0, 0], [None, None]
        prefix = []
        last = 1
        for i, w in enumerate(words):
            new = len(length)
            length.append(i + 1)
            link.append(1)
            word.append(-1)
            to.append(0)
            more.append(None)
            prefix.append(new)
            p = last
            last = new
            while p:
                if word[p] == w:
                    q = to[p]
                elif word[p] < 0:
                    word[p], to[p] = w, new
                    p = link[p]
                    continue
                else:
                    m = more[p]
                    if m is None:
                        more[p] = {w: new}
                        p = link[p]
                        continue
                    q = m.get(w)
                    if q is None:
                        m[w] = new
                        p = link[p]
                        continue
                if length[q] == length[p] + 1:
                    link[new] = q
                    break
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                word.append(word[q])
                to.append(to[q])
                more.append(dict(more[q]) if more[q] else None)
                link[q] = link[new] = copy
                while p:
                    if word[p] == w:
                        if to[p] != q:
                            break
                        to[p] = copy
                    else:
                        m = more[p]
                        if m is None or m.get(w) != q:
                            break
                        m[w] = copy
                    p = link[p]
                break
        self.length, self.link, self.prefix = length, link, prefix


class LinkCutAccess:
    """Link-cut forest over fixed parents; every preferred path has one colour.

    A path is a splay tree ordered by depth, whose root holds the colour.  State 0 is "none".
    """

    def __init__(self, parent: list[int]):
        self.up = list(parent)          # parent in the splay tree, or the path's parent at its root
        self.left = [0] * len(parent)
        self.right = [0] * len(parent)
        self.colour = [-1] * len(parent)

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        first = x
        while True:
            y = up[x]
            if left[y] != x and right[y] != x or not y:
                break
            first = y
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            if inner:
                first = z
                if (left[y] == x) == (left[z] == y):        # zig-zig: turn the parent first
                    self._rotate(y)
                    self._rotate(x)
                else:
                    self._rotate(x)
                    self._rotate(x)
            else:
                self._rotate(x)
        if first != x:
            self.colour[x] = self.colour[first]

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        if left[y] == x:
            b = right[x]
            left[y], right[x] = b, y
        else:
            b = left[x]
            right[y], left[x] = b, y
        if b:
            up[b] = y
        up[y], up[x] = x, z

    def access(self, v: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from ``v`` to its root; ``(deepest state, old colour)`` of each segment."""
        seen = []
        up, right, colours = self.up, self.right, self.colour
        below, x = 0, v
        while x:
            self._splay(x)
            old = colours[x]
            cut = right[x]
            if cut:
                colours[cut] = old
            right[x] = below
            if old >= 0:
                seen.append((x, old))
            below, x = x, up[x]
        # the last splay tree holds the whole path; hand its root to ``v``
        self._splay(v)
        colours[v] = colour
        return seen


def runs(words: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a sequence of word numbers, by start, then period."""
    n = len(words)
    automaton = SuffixAutomaton(words)
    length = automaton.length
    forest = LinkCutAccess(automaton.link)
    ends: dict[int, int] = {}           # period -> end of its latest run
    found = []
    for i, state in enumerate(automaton.prefix):
        for top, j in forest.access(state, i):
            p, common = i - j, length[top]
            if common < (min_exponent - 1) * p or common + p < min_length or ends.get(p, -1) > i:
                continue
            stop = i + 1
            while stop < n and words[stop] == words[stop - p]:
                stop += 1
            ends[p] = stop
            start = i + 1 - common - p
            found.append((start, stop - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on (shorter at the end: left out)."""
    out, have, power = None, 0, hashes
    width, rest = 1, size
    while rest:
        if rest & 1:
            if out is None:
                out = power
            else:
                m = max(0, len(hashes) - (have + width) + 1)
                out = mix(out[:m] * _SHIFT + power[have:have + m])
            have += width
        rest >>= 1
        if rest:
            m = max(0, len(power) - width)
            power = mix(power[:m] * _SHIFT + power[width:width + m])
            width *= 2
    return out[:max(0, len(hashes) - size + 1)]


def stretches(hashes: np.ndarray, first: np.ndarray, min_length: int, min_exponent: int):
    """``(row, start, stop)`` of all stretches that can hold a run; word numbers within the row."""
    size = max(1, min_length - min_length // min_exponent)
    grams = windows(hashes, size)
    if not len(grams):
        return []
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    row = row[:len(hashes)]
    inside = np.flatnonzero(row[:len(grams)] == row[size - 1:size - 1 + len(grams)])
    key = mix(grams[inside] + row[inside].astype(np.uint64) * _SHIFT)
    order = np.argsort(key, kind="stable")
    at, key = inside[order], key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    if not same.size:
        return []
    near, far = at[same], at[same + 1]
    cover = np.zeros(len(hashes) + 1, np.int64)
    hit = np.unique(np.concatenate([near, far]))
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + size, -1)
    covered = np.cumsum(cover[:-1]) > 0
    # a stretch ends where the cover or the row ends
    edge = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0) != 0)
    edge = np.union1d(edge, first[(first > 0) & (first < len(hashes))])
    lo = np.append(edge[:-1], edge[-1:])
    hi = np.append(edge[1:], len(hashes))
    ok = (hi - lo >= min_length)
    lo, hi = lo[ok], hi[ok]
    lo, hi = lo[covered[lo]], hi[covered[lo]]
    # two equal windows close enough inside
    part_near = np.searchsorted(lo, near, "right") - 1
    valid = part_near >= 0
    near, far, part_near = near[valid], far[valid], part_near[valid]
    good = (far < hi[part_near]) & (near >= lo[part_near]) & ((far - near) * min_exponent <= hi[part_near] - lo[part_near])
    return [(int(row[lo[k]]), int(lo[k] - first[row[lo[k]]]), int(hi[k] - first[row[lo[k]]]))
            for k in np.unique(part_near[good])]


def rewritten(n: int, doc_id) -> np.ndarray | None:
    """Original word behind each word of a document that the task repeats periodically (else None)."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
                  order=lambda n, doc_id: None) -> DataFrame:
    """``doc_id, runs, collapsed`` per row: all runs by start and period, and the text without their repeats.

    ``order(n, doc_id)`` may give the word behind each of the ``n`` words of a document (None: as they are).
    """
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first_row, raw, off in text_chunks(batch.column(1)):
                yield one(ids[first_row:first_row + len(off) - 1], raw, off)

    def one(ids, raw, off):
        split = Words(raw, off, PLAIN_WORDS)
        hashes, first = split.hashes(), split.row_first
        del split
        orders = {}
        for r, doc_id in enumerate(ids):
            at = order(int(first[r + 1] - first[r]), doc_id)
            if at is not None:
                orders[r] = at
                hashes[first[r]:first[r + 1]] = hashes[first[r]:first[r + 1]][at]
        todo: dict[int, list] = {}
        for r, start, stop in stretches(hashes, first, min_length, min_exponent):
            todo.setdefault(r, []).append((start, stop))
        results, texts = [], []
        for r in range(len(ids)):
            words = raw[off[r]:off[r + 1]].split()
            if r in orders:
                words = [words[k] for k in orders[r].tolist()]
            found = []
            for start, stop in todo.get(r, ()):
                number: dict[bytes, int] = {}
                part = [number.setdefault(w, len(number)) for w in words[start:stop]]
                found += [(start + s, m, q) for s, m, q in runs(part, min_length, min_exponent)]
            found.sort(key=lambda x: (x[0], x[2]))
            results.append([{"start": s, "length": m, "period": q} for s, m, q in found])
            texts.append(b" ".join(collapsed(words, found)))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(results, pa.list_(RUN_TYPE)), pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Count, best run (greatest exact length / period, then smallest start, then period) and digests per row."""
    exponent = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]     # noqa: E731
    best = F.aggregate(F.slice("runs", F.lit(2), F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)),
                       lambda a, b: F.when(exponent(b, a) > 0, b).otherwise(a))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                    F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256")))
