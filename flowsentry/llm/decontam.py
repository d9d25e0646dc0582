"""Benchmark decontamination with one Aho-Corasick automaton (operator 9).

The windows of all benchmark items (``window`` consecutive words; a shorter item is one
window) form one automaton over normalised text: words joined by single blanks.  Every
document is normalised the same way and scanned once, whole; hits are mapped back through
word numbers to byte offsets and code points of the original text.

The windows are cut out of the items in tasks and written once.  While their weight is within
``max_patterns`` (about 5 kB of a worker's memory each) they form one automaton; a larger benchmark is
dealt by hash into slices of half that weight on average.  Slices are fetched, broadcast, scanned with and
released one after the other, so the driver and the executors hold one slice at a time; nothing
is left out.  What a slice finds is kept as row key, hit words and items of the documents it hits; texts
are read again but never written.

Edge cases: a NULL or word-free text has no words and no hits; items without words match
nothing; items with a NULL id still mark words as hit but are not counted or listed;
repeated items and documents are treated row by row; an empty benchmark hits nothing;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM_WORDS, Words
from .common import drop_scratch, keep_rows, scratch

#: weight of the pairs of windows and items in one automaton; a pair counts 1, and 1 more for every 256 bytes
MAX_PATTERNS = 50_000

SPAN_SCHEMA = ("doc_id long, n_words long, n_hit long, item_ids array<long>, "
               "spans array<struct<start:long,stop:long>>")


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM_WORDS).split()


def window_pairs(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct pairs of a window (its words between blanks) and an item that holds it."""
    def run(batches):
        for batch in batches:
            pairs = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = normalised(text.as_py())
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    pairs.append((b" " + b" ".join(words[i:i + window]) + b" ", item_id))
                    if len(pairs) >= 10_000:
                        yield table(pairs)
                        pairs = []
            if pairs:
                yield table(pairs)

    def table(pairs):
        keys, ids = zip(*pairs)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "item_id"])

    return (benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
            .mapInArrow(run, "key binary, item_id long").distinct())


def automaton(pairs) -> bytes:
    """Pickled automaton of ``(window, item id)`` pairs; bytes are kept one-to-one as latin-1 characters."""
    import ahocorasick

    items: dict[bytes, set] = defaultdict(set)
    for key, item_id in pairs:
        items[bytes(key)].add(item_id)
    a = ahocorasick.Automaton()
    for key in sorted(items):
        a.add_word(key.decode("latin-1"), (key.count(b" ") - 1, tuple(sorted(x for x in items[key] if x is not None))))
    a.make_automaton()
    return pickle.dumps(a)


_LOADED: dict = {}


def scan_text(text: bytes, machine) -> tuple[int, np.ndarray, set]:
    """Word count, hit words (ascending numbers) and item ids of one text."""
    words = text.translate(ALNUM_WORDS).split()
    n = len(words)
    if not n:
        return 0, np.zeros(0, np.int64), set()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = [(end, *value) for end, value in machine.iter(line)] if machine is not None else []
    if not found:
        return n, np.zeros(0, np.int64), set()
    ends = np.fromiter((f[0] for f in found), np.int64, len(found))
    size = np.fromiter((f[1] for f in found), np.int64, len(found))
    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(blanks, ends)          # the window ends before this word
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, last - size, 1)
    np.add.at(edge, last, -1)
    return n, np.flatnonzero(np.cumsum(edge[:n]) > 0), set().union(*(f[2] for f in found))


def original_spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Code-point spans of runs of hit words in the original text."""
    if not len(hit):
        return []
    w = Words(text, np.array([0, len(text)]), ALNUM_WORDS)
    cuts = np.flatnonzero(np.diff(hit) > 1)
    runs = zip(hit[np.append(0, cuts + 1)], hit[np.append(cuts, len(hit) - 1)])
    return [{"start": len(text[:w.starts[a]].decode("utf-8")), "stop": len(text[:w.ends[b]].decode("utf-8"))}
            for a, b in runs]


def slices(benchmark: DataFrame, window: int, max_patterns: int):
    """``(broadcast, key, last)`` of each slice of the benchmark, one live at a time but for the last."""
    spark = benchmark.sparkSession
    pairs = scratch(window_pairs(benchmark, window), "benchmark-windows")
    weight = pairs.agg(F.sum(1 + F.floor(F.length("key") / 256))).first()[0] or 0
    n = 1 if weight <= max_patterns else -(-2 * weight // max_patterns)
    part = F.pmod(F.xxhash64("key", "item_id"), F.lit(n))
    for k in range(n):
        rows = pairs.where(part == k).collect()
        shared = spark.sparkContext.broadcast(automaton(rows) if rows else b"")
        del rows
        if k == n - 1:
            drop_scratch(pairs)
            yield shared, uuid.uuid4().hex, True
        else:
            yield shared, uuid.uuid4().hex, False
            shared.destroy()


def loaded(shared, key: str):
    """The automaton (``None`` without windows), unpickled once per Python worker."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = pickle.loads(shared.value) if shared.value else None
    return _LOADED[key]


def row_key():
    """128 bits of a row's id and text; rows that agree in both have the same hits."""
    return (F.xxhash64("doc_id", "text").alias("_r1"), F.xxhash64(F.lit("row"), "doc_id", "text").alias("_r2"))


def hit_rows(docs: DataFrame, shared, key: str) -> DataFrame:
    """``_r1, _r2, hits, items`` of the rows in which one slice occurs."""
    def run(batches):
        machine = loaded(shared, key)
        for batch in batches:
            at, hits, items = [], [], []
            for i, value in enumerate(batch.column(0).cast(pa.large_binary())):
                _, hit, ids = scan_text(value.as_py() or b"", machine)
                if len(hit):
                    at.append(i)
                    hits.append(hit)
                    items.append(sorted(ids))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(rows), batch.column(2).take(rows), pa.array(hits, pa.list_(pa.int64())),
                 pa.array(items, pa.list_(pa.int64()))], ["_r1", "_r2", "hits", "items"])

    return docs.select("text", *row_key()).mapInArrow(run, "_r1 long, _r2 long, hits array<long>, items array<long>")


def all_hits(docs: DataFrame, benchmark: DataFrame, window: int, max_patterns: int):
    """The last slice if it is the only one, else None; and the hits of all slices together, one row per row key."""
    found = []
    for shared, key, last in slices(benchmark, window, max_patterns):
        if last and not found:
            return (shared, key), None
        found.append(scratch(hit_rows(docs, shared, key), "decontamination"))
    every = reduce(DataFrame.unionAll, found)
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    return None, scratch(every.groupBy("_r1", "_r2").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"), ids.alias("items")), "decontamination")


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """Per document: word and hit counts, ids of the items found, spans in the original text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    only, hits = all_hits(docs, benchmark, window, max_patterns)
    if only is None:
        docs = docs.select("*", *row_key()).join(hits, ["_r1", "_r2"], "left").select("doc_id", "text", "hits", "items")

    def run(batches):
        machine = loaded(*only) if only else None
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for i, value in enumerate(batch.column(1).cast(pa.large_binary())):
                text = value.as_py() or b""
                if only:
                    n, hit, ids = scan_text(text, machine)
                else:
                    n, hit, ids = scan_text(text, None)[0], np.array(batch.column(2)[i].as_py() or [], np.int64), batch.column(3)[i].as_py() or []
                n_words.append(n)
                n_hit.append(len(hit))
                items.append(sorted(ids))
                spans.append(original_spans(text, hit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                ["doc_id", "n_words", "n_hit", "item_ids", "spans"])

    return docs.mapInArrow(run, SPAN_SCHEMA)


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns: counts, and the ids as one SHA-256."""
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10,
                  max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """The rows that hold no benchmark window, with all their columns; nothing is shuffled under one automaton."""
    only, hits = all_hits(docs, benchmark, window, max_patterns)
    if only is None:
        return (docs.select("*", *row_key()).join(hits.select("_r1", "_r2"), ["_r1", "_r2"], "left_anti").select(*docs.columns))

    def clean(batch):
        machine = loaded(*only)
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
        return [not len(scan_text(t.as_py() or b"", machine)[1]) for t in texts]

    return keep_rows(docs, clean)


def items_digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
