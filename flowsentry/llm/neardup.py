"""MinHash near-duplicates by one-permutation hashing (operator 7).

1. ``fingerprints`` reads every whole text once: the set of 5-word shingles (64-bit hashes),
   its size, a 128-bit key of the set, and band hashes of a one-permutation signature whose
   empty bins are filled by optimal densification (each empty bin follows its own random
   order of the bins and takes the first that is filled).
2. Rows with equal shingle sets form a class; only one row per class goes on, so a group of
   exact copies costs one row whatever its size.
3. Band buckets with two classes or more give star-shaped candidates: the smallest member is the
   centre, so buckets of the same classes agree on it.  Centres are confirmed against the
   members on the full shingle sets of their whole texts.
4. Confirmed links are contracted to components by alternating large and small stars.
   A bucket whose members are all in one component is done.  The members of the others are
   compared across components by an exact prefix-filter join, so a star loses no link: every
   pair that shares a bucket is compared or connected.  No bucket is capped.

Rows are told apart by two hashes of id and text, not by the id, and classes by both words of their key.

With r rows and b bands a pair of similarity s shares a bucket with probability
1 - (1 - s^r)^b; the defaults (6, 64) miss a pair at exactly 0.75 with 4e-6.

Edge cases: NULL, empty and word-free texts have no shingles and are linked with nothing;
repeated rows fall into one class; rows with a NULL ``doc_id`` take part, but a component's
id is its smallest non-NULL ``doc_id`` (NULL if there is none); an id may occur with several texts;
extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import WHITESPACE_WORDS, Words, mix
from .common import drop_scratch, hot_shares, scratch, spread_join, text_chunks

K_WORDS = 5
ROWS, BANDS = 6, 64
FINGERPRINT_SCHEMA = "doc_id long, r1 long, r2 long, n_shingles long, k1 long, k2 long, bands array<long>"

_ODD = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(words: Words, k: int = K_WORDS):
    """Yield the sorted distinct shingle hashes of each row."""
    h = words.hashes()
    first = words.row_first
    if len(h) >= k:
        s = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            s += h[j:len(h) - k + 1 + j] * _ODD[j]
        s = mix(s)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            x = np.sort(s[a:b - k + 1])
            new = np.empty(len(x), bool)
            new[0] = True
            np.not_equal(x[1:], x[:-1], out=new[1:])
            yield x[new]
        elif b > a:
            yield mix((h[a:b] * _ODD[:b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


@lru_cache(2)
def _probes(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """``order[t, i]``: the bin that empty bin ``i`` tries at step ``t``; ``rank``: its inverse."""
    order = np.argsort(np.random.default_rng(20170806).random((bins, bins)), axis=0)
    return order.astype(np.int32), np.ascontiguousarray(np.argsort(order, axis=0).astype(np.int32).T)


def signatures(shingles: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation minima per set, empty bins densified.

    ``shingles`` holds the sorted sets one after the other, none empty; ``first`` where each begins.
    """
    n = len(first)
    owner = np.repeat(np.arange(n), np.diff(np.append(first, len(shingles))))
    cell = owner * bins + (((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    new = np.empty(len(cell), bool)
    new[:1] = True
    np.not_equal(cell[1:], cell[:-1], out=new[1:])
    sig, has = np.zeros(n * bins, np.uint64), np.zeros(n * bins, bool)
    sig[cell[new]] = shingles[new]
    has[cell[new]] = True
    order, rank = _probes(bins)
    empty = np.flatnonzero(~has)
    for t in range(48):
        if not empty.size:
            break
        i = empty % bins
        tried = empty - i + order[t][i]
        ok = has[tried]
        sig[empty[ok]] = sig[tried[ok]]
        empty = empty[~ok]
    # sets with few filled bins: look up which of them comes first
    cuts = np.flatnonzero(np.diff(empty // bins, prepend=-1))
    for at in np.split(empty, cuts[1:]) if empty.size else ():
        base = at[0] // bins * bins
        filled = np.flatnonzero(has[base:base + bins])
        sig[at] = sig[base + filled[rank[at - base][:, filled].argmin(axis=1)]]
    return sig.reshape(n, bins)


def band_hashes(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One hash per band of each signature."""
    parts = (mix(sig).reshape(len(sig), bands, rows) * _ODD[:rows]).sum(axis=2, dtype=np.uint64)
    return mix(parts + _ODD[rows:rows + bands])


def set_keys(shingles: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of sets: two sums of independently mixed members."""
    a = np.add.reduceat(mix(shingles), first)
    b = np.add.reduceat(mix(shingles * _ODD[100] + np.uint64(7)), first)
    return mix(a).view(np.int64), mix(b).view(np.int64)


def chunk_sets(raw: bytes, off: np.ndarray, k: int):
    """Sizes of all rows' sets, the non-empty sets one after the other, and where each begins."""
    sets = list(shingle_sets(Words(raw, off, WHITESPACE_WORDS), k))
    size = np.array([len(s) for s in sets], np.int64)
    full = size[size > 0]
    return size, np.concatenate(sets), np.cumsum(full) - full


def fingerprints(docs: DataFrame, rows: int = ROWS, bands: int = BANDS, k: int = K_WORDS) -> DataFrame:
    """``doc_id, r1, r2`` (row key), ``n_shingles, k1, k2, bands`` per row (set key and bands NULL without shingles)."""
    def run(batches):
        for batch in batches:
            size, k1, k2, band = [], [], [], []
            for _, raw, off in text_chunks(batch.column(1)):
                n, shingles, first = chunk_sets(raw, off, k)
                size.append(n)
                if len(first):
                    a, b = set_keys(shingles, first)
                    k1.append(a)
                    k2.append(b)
                    band.append(band_hashes(signatures(shingles, first, rows * bands), rows, bands).view(np.int64))
            size = np.concatenate(size) if size else np.zeros(0, np.int64)
            # rows without shingles get NULLs
            place = pa.array(np.cumsum(size > 0) - 1, mask=size == 0)
            k1, k2 = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)).take(place) for x in (k1, k2))
            flat = np.concatenate(band).reshape(-1) if band else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), batch.column(3), pa.array(size), k1, k2, lists.take(place)],
                ["doc_id", "r1", "r2", "n_shingles", "k1", "k2", "bands"])

    return docs.select("doc_id", "text", *row_key()).mapInArrow(run, FINGERPRINT_SCHEMA)


def row_key():
    """128 bits of a row's id and text; rows that agree in both are one and the same here."""
    return (F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit("row"), "doc_id", "text").alias("r2"))


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, k: int = K_WORDS) -> DataFrame:
    """Pairs ``(a, b)`` of classes with ``100 * |A & B| >= percent * |A | B|`` on their full sets.

    Both whole texts meet in one row; the rows of one centre follow each other, so its set is
    built once per run of rows.
    """
    t = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = (pairs.join(t, "b")
              .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"))

    def one_set(text: str) -> np.ndarray:
        raw = text.encode("utf-8")
        return next(shingle_sets(Words(raw, np.array([0, len(raw)]), WHITESPACE_WORDS), k))

    def run(batches):
        last, set_a = None, None
        for batch in batches:
            a, b, text_b, text_a = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "text_b", "text_a"))
            keep = []
            for i, node in enumerate(a.to_pylist()):
                if node != last:
                    last, set_a = node, one_set(text_a[i].as_py())
                set_b = one_set(text_b[i].as_py())
                both = len(np.intersect1d(set_a, set_b, assume_unique=True))
                keep.append(100 * both >= percent * (len(set_a) + len(set_b) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def prefix_pairs(texts: DataFrame, nodes: DataFrame, percent: int, k: int = K_WORDS) -> DataFrame:
    """Candidate pairs ``(a, b)`` of different components among ``nodes``, without loss.

    Prefix filter: with every set ordered by how rare its shingles are, two sets of the wanted
    similarity share a shingle among their first ``n - ceil(percent * n / 100) + 1``.  A passage
    that many documents share is common, hence late in the order, and makes no pairs.  Within a
    shingle's bucket only members outside its largest component meet the others, so a large
    group that is connected already is not paired with itself.
    """
    def run(batches):
        for batch in batches:
            for i, raw, off in text_chunks(batch.column(1)):
                n, shingles, _ = chunk_sets(raw, off, k)
                at = pa.array(np.repeat(np.arange(i, i + len(n)), n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(2).take(at), pa.array(np.repeat(n, n)),
                     pa.array(shingles.view(np.int64))], ["node", "comp", "size", "sh"])

    sets = scratch(texts.join(nodes, "node").select("node", "text", "comp")
                   .mapInArrow(run, "node long, comp long, size long, sh long"), "dup-sets")
    often = scratch(sets.groupBy("sh").agg(F.count(F.lit(1)).alias("df")).where("df > 1").withColumn("n_rows", F.col("df")), "dup-often")
    # from the commonest shingle down; those of one set only come first in the order and meet nothing
    from_end = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("df"), F.desc("sh")))
    prefix = scratch(spread_join(sets, often, ["sh"], "n_rows", ["node"]).withColumn("place", F.col("size") - from_end + 1)
                     .where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1)
                     .select("sh", "node", "comp", "size", "place"), "dup-prefix")
    drop_scratch(sets, often)
    by_comp = prefix.groupBy("sh", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = scratch(by_comp.groupBy("sh").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"),
                                                F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n_rows"))
                      .where("parts > 1").select("sh", "main", "n_rows"), "dup-largest")
    mixed = scratch(spread_join(prefix, largest, ["sh"], "n_rows", ["node"]), "dup-mixed")
    drop_scratch(prefix)
    # members outside the largest component meet all others; those of a hot shingle in shares
    _, hot = hot_shares(largest, ["sh"], "n_rows")
    dealt = (mixed.join(F.broadcast(hot), "sh", "left")
             .withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"), F.lit(0))))
    outside = (mixed.where("comp <> main").join(F.broadcast(hot), "sh", "left")
               .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shares"), F.lit(1)) - 1))))
    a, b = outside.alias("a"), dealt.alias("b")
    sa, sb = F.col("a.size"), F.col("b.size")
    rest = F.least(sa - F.col("a.place"), sb - F.col("b.place")) + 1        # all that the two can still share
    return (a.join(b, (F.col("a.sh") == F.col("b.sh")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.comp") != F.col("b.comp"))
                   & (F.least(sa, sb) * 100 >= F.greatest(sa, sb) * percent)
                   & (rest * (100 + percent) >= (sa + sb) * percent))
            .select(F.greatest("a.node", "b.node").alias("a"), F.least("a.node", "b.node").alias("b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` (smallest node of its component) by alternating large and small stars.

    Minima are partial aggregates and the joins can be split by the optimiser, so a hub with
    a great many links is not one task's work.
    """
    def larger(edges: DataFrame) -> DataFrame:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")

    def smaller(edges: DataFrame) -> DataFrame:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        return (edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .union(low.select("u", F.col("m").alias("v")))).where("u <> v").distinct()

    edges = scratch(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    # done when every node has one edge and no root has any: then each edge leads to its root
    while not edges.join(edges.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty():
        before, edges = edges, scratch(smaller(larger(edges)), "cc")
        drop_scratch(before)
    rooted = edges.groupBy("u").agg(F.min("v").alias("comp"), F.max("v").alias("other"))
    if not rooted.where("comp <> other").isEmpty():
        again = scratch(smaller(larger(edges)), "cc")
        return components(again.select(F.col("u").alias("a"), F.col("v").alias("b")))
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            .union(edges.select("v", "v").distinct().toDF("node", "comp")))


def grouped(docs: DataFrame, percent: int, rows: int, bands: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints of all rows, keys of rows that occur again, and ``k1, k2, rep`` per class.

    ``rep`` is the first row of the class's component.

    Rows are ordered by ``doc_id`` (NULL last), then row key; ``rep`` is a struct of these.
    """
    prints = scratch(fingerprints(docs, rows, bands, k), "dup-prints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "r1", "r2")
    # one row per distinct shingle set
    again = scratch(prints.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("r1", "r2"), "dup-again")
    classes = scratch(told_apart(
        prints.where("n_shingles > 0").groupBy("k1", "k2")
        .agg(F.min(row).alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))), "dup-classes")
    member = classes.select("node", F.explode("bands").alias("key"))
    crowded = member.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    buckets = scratch(member.join(crowded, "key"), "dup-buckets")
    stars = scratch(buckets.where("node <> centre").select("centre", "node").distinct(), "dup-stars")
    wanted = stars.select("node").union(stars.select("centre")).distinct()
    texts = scratch(class_texts(docs, classes.join(wanted, "node").select("node", "rep"), again), "dup-texts")

    of_a = classes.select(F.col("node").alias("centre"), F.col("size").alias("sa"))
    of_b = classes.select("node", F.col("size").alias("sb"))
    close = F.least("sa", "sb") * 100 >= F.greatest("sa", "sb") * percent   # exact: no link beyond it
    pairs = stars.join(of_a, "centre").join(of_b, "node").where(close).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    links = scratch(confirm(pairs, texts, percent, k), "dup-links")
    comps = scratch(components(links), "dup-comps")

    # buckets that still hold several components: their members meet once more, exactly
    apart = scratch(with_comp(with_comp(stars, comps, "centre", "ca"), comps, "node", "cb")
                    .where("ca <> cb").select("centre", "node"), "dup-apart")
    if not apart.isEmpty():
        open_keys = buckets.join(apart, ["centre", "node"], "left_semi").select("key").distinct()
        members = buckets.join(open_keys, "key").select("node").distinct()
        pairs = prefix_pairs(texts, with_comp(members, comps, "node", "comp"), percent, k)
        more = scratch(confirm(pairs, texts, percent, k), "dup-links")
        if not more.isEmpty():
            known = comps.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
            comps = scratch(components(known.union(more)), "dup-comps")
    drop_scratch(buckets, texts, stars, links, apart)

    of_class = with_comp(classes.select("node", "k1", "k2", "rep"), comps, "node", "comp")
    first = of_class.groupBy("comp").agg(F.min("rep").alias("first"))
    by_class = scratch(of_class.join(first, "comp").select("k1", "k2", F.col("first").alias("rep")), "dup-groups")
    drop_scratch(classes, comps)
    return prints, again, by_class


def told_apart(classes: DataFrame) -> DataFrame:
    """``classes`` with ``node``: the first word of the key, or a hash of both where several classes share it."""
    same = scratch(classes.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1"), "dup-same")
    if same.isEmpty():
        return classes.withColumn("node", F.col("k1"))
    return (classes.join(same.withColumn("twice", F.lit(True)), "k1", "left")
            .withColumn("node", F.when(F.col("twice"), F.xxhash64("k1", "k2")).otherwise(F.col("k1"))).drop("twice"))


def with_comp(rows: DataFrame, comps: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the component of the node in ``column``; a node without links is its own."""
    of = comps.select(F.col("node").alias(column), F.col("comp").alias(name))
    return rows.join(of, column, "left").withColumn(name, F.coalesce(name, column))


def near_duplicates(docs: DataFrame, percent: int = 75, rows: int = ROWS, bands: int = BANDS,
                    k: int = K_WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``; the smallest id of a component is its id."""
    prints, _, by_class = grouped(docs, percent, rows, bands, k)
    own = F.when(F.col("n_shingles") > 0, F.col("rep.doc_id")).otherwise(F.col("doc_id"))
    return (prints.select("doc_id", "n_shingles", "k1", "k2").join(by_class, ["k1", "k2"], "left")
            .select("doc_id", "n_shingles", own.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def class_texts(docs: DataFrame, wanted: DataFrame, again: DataFrame) -> DataFrame:
    """``node, text``: the whole text of the row that stands for each wanted class (``node, rep``).

    Rows whose key is in ``again`` occur more than once; one of them is taken.
    """
    found = (docs.select("text", *row_key())
             .join(wanted.select("node", F.col("rep.r1").alias("r1"), F.col("rep.r2").alias("r2")), ["r1", "r2"]))
    if again.isEmpty():
        return found.select("node", "text")
    repeated = again.withColumn("repeated", F.lit(True))
    marked = found.join(repeated, ["r1", "r2"], "left")
    return (marked.where("repeated IS NULL").select("node", "text")
            .union(marked.where("repeated").select("node", "text").dropDuplicates(["node"])))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each near-duplicate group (the first by ``doc_id``, NULL last), with all columns.

    Rows without shingles stay, each of them.  Of rows with equal id and text one stays.
    """
    prints, again, by_class = grouped(docs, percent, ROWS, BANDS, K_WORDS)
    chosen = by_class.select(F.col("rep.r1").alias("r1"), F.col("rep.r2").alias("r2")).distinct()
    kept = scratch(chosen.join(again.withColumn("again", F.lit(True)), ["r1", "r2"], "left")
                   .select(F.col("r1").alias("_r1"), F.col("r2").alias("_r2"),
                           F.coalesce("again", F.lit(False)).alias("_again")), "dup-kept")
    drop_scratch(prints)
    r1, r2 = row_key()
    keyed = docs.withColumns({"_r1": r1, "_r2": r2, "_words": F.length(F.btrim("text", F.lit(" \t\n\x0b\f\r"))) > 0})
    joined = keyed.join(kept, ["_r1", "_r2"], "left")
    single = joined.where(~F.coalesce("_words", F.lit(False)) | ~F.coalesce("_again", F.lit(True))).select(*docs.columns)
    if kept.where("_again").isEmpty():
        return single
    return single.union(keyed.join(kept.where("_again"), ["_r1", "_r2"]).dropDuplicates(["_r1", "_r2"]).select(*docs.columns))
