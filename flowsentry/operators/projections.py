"""Approximate nearest neighbours by hashed projections with multi-probe (J-6, W-4; LOF builds on it).

``tables`` sets of random orthogonal directions turn a vector into ``tables`` codes: one bit per
direction, which side of the sample median it lies on.  The number of bits grows with the logarithm of
the number of rows, so a bucket (rows of one code) holds about ``bucket_rows`` rows at every size.
A query visits, per table, its own bucket and those whose codes differ in the bits that it
nearly missed, ``probes`` buckets in order of the summed squared margins.  What a query reads is
therefore about ``tables * probes * bucket_rows`` rows, whatever the table's size, and no
bucket is read by all queries.  Distances are exact; only the choice of candidates is approximate.

Data without structure need a large share of all buckets for a high recall (2,000 rows of the
30 leading components of the test embeddings: see the README); then ``share`` gives the
probes as a share of all buckets, and ``share=1`` is an exact search.

Rows are dealt by (table, code) and sorted, reference rows before queries, so a task streams its
buckets and holds one at a time.  If every bucket is visited, queries are dealt by pages of buckets instead.  Of equal vectors only the ``k + 1`` smallest keys are indexed, which loses
nothing: a row has no use for more.  Buckets with many rows are split, and queries repeated per part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_key, hash_unit
from ..session import cut_lineage
from .skew import hot_shares
from .slices import SLICE_ROWS, id_numbers, nearest_rows, slices

#: rows that the medians are taken from
SAMPLE = 4096
#: bits of a code that a probe may flip: those with the smallest margins
FLIPS = 12
#: most parts that the rows of all buckets together are cut into for splitting a large bucket
PARTS = 8192


class Codes:
    """Directions and medians of all tables; codes of rows and probes of queries."""

    def __init__(self, sample: np.ndarray, tables: int, bits: int, seed: int):
        d = sample.shape[1]
        rng = np.random.default_rng(seed)
        sets = []
        for _ in range(tables):
            columns = [np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(math.ceil(bits / d))]
            sets.append(np.concatenate(columns, axis=1)[:, :bits])
        self.directions = np.stack(sets)                                         # tables x d x bits
        self.medians = np.median(np.einsum("nd,tdb->ntb", sample, self.directions), axis=0)
        self.place = np.int64(1) << np.arange(bits, dtype=np.int64)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tdb->ntb", x, self.directions) - self.medians

    def codes(self, x: np.ndarray) -> np.ndarray:
        return (self.margins(x) > 0) @ self.place                                # n x tables

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` codes of each row and table with the least margins to cross (n x tables x count)."""
        m = self.margins(x)
        bits = m.shape[2]
        flips = min(bits, FLIPS)
        count = min(count, 1 << flips)
        near = np.argsort(np.abs(m), axis=2)[:, :, :flips]
        cost = np.take_along_axis(m, near, 2) ** 2
        subset = (np.arange(1 << flips)[:, None] >> np.arange(flips)) & 1         # all sets of flipped bits
        order = np.argpartition(cost @ subset.T, count - 1, axis=2)[:, :, :count]
        flipped = np.einsum("ntcf,ntf->ntc", subset[order], self.place[near])
        return ((m > 0) @ self.place)[:, :, None] ^ flipped


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as one matrix, without a loop."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def fit_codes(rows: DataFrame, n: int, tables: int, bucket_rows: int, seed: int) -> Codes:
    """Codes from a hash sample of at most about ``SAMPLE`` rows."""
    share = min(1.0, SAMPLE / n)
    got = rows.where(hash_unit(hash_key("rid", seed)) < share).select("x").collect() or rows.limit(1).collect()
    bits = max(1, round(math.log2(max(2.0, n / bucket_rows))))
    return Codes(np.array([r["x"] for r in got], np.float64), tables, bits, seed)


def knn_approximate(query: DataFrame, ref: DataFrame, k: int, feat: str = "x", key: str = "row_id",
                    exclude_self: bool = False, tables: int = 4, bucket_rows: int = 16, probes: int = 18,
                    share: float | None = None, seed: int = 42) -> DataFrame:
    """``qid, rid, d, rank, compared``: the ``k`` nearest rows found, ties to the smaller key.

    ``compared`` is the number of distances computed for the query.  Rows without a vector take no part.
    """
    spark = query.sparkSession
    known = F.col(feat).isNotNull()
    ref = ref.where(known).select(F.col(key).alias("rid"), F.col(feat).cast("array<double>").alias("x"))
    query = query.where(known).select(F.col(key).alias("qid"), F.col(feat).cast("array<double>").alias("x"))
    id_type = ref.schema["rid"].dataType.simpleString()
    result = f"qid {id_type}, rid {id_type}, d double, compared long"
    equal = Window.partitionBy("x").orderBy("rid")
    ref = cut_lineage(ref.withColumn("copy", F.row_number().over(equal)).where(F.col("copy") <= k + 1).drop("copy"))
    n = ref.count()
    if not n:
        return spark.createDataFrame([], result).withColumn("rank", F.lit(1))
    codes = fit_codes(ref, n, tables, bucket_rows, seed)
    bits = len(codes.place)
    count = probes if share is None else math.ceil(share * (1 << bits))
    whole = count >= 1 << bits
    if not whole and count > 1 << min(bits, FLIPS):
        raise ValueError(f"{count} probes of 2^{bits} buckets: at most {1 << FLIPS} can be asked for")
    shared = spark.sparkContext.broadcast(codes)

    def deal(probing: bool):
        def run(batches):
            c = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    x = matrix(part.column(1))
                    got = c.probes(x, count) if probing else c.codes(x)[:, :, None]
                    each = got.shape[1] * got.shape[2]
                    rows = pa.array(np.repeat(np.arange(len(x)), each))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.repeat(np.arange(got.shape[1], dtype=np.int32), got.shape[2]), len(x))),
                         pa.array(got.reshape(-1).astype(np.int64)), part.column(0).take(rows), part.column(1).take(rows)],
                        ["t", "code", "id", "x"])
        return run

    dealt = f"t int, code long, id {id_type}, x array<double>"
    members = ref.select("rid", "x").mapInArrow(deal(False), dealt)
    _, hot = hot_shares(cut_lineage(members.groupBy("t", "code").agg(F.count(F.lit(1)).alias("n"))), ["t", "code"], "n",
                        parts=PARTS, least=2048)
    members = (members.join(F.broadcast(hot), ["t", "code"], "left")
               .withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"), F.lit(0))))
    if whole:
        best = _probe_all(query, members, n, tables, k, exclude_self, result)
        return _best_of(best, k)
    asked = query.select("qid", "x").mapInArrow(deal(True), dealt)
    asked = (asked.join(F.broadcast(hot), ["t", "code"], "left")
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shares"), F.lit(1)) - 1))))
    columns = ["t", "code", "part", "asks", "id", "x"]
    rows = (members.withColumn("asks", F.lit(0)).select(*columns).union(asked.withColumn("asks", F.lit(1)).select(*columns))
            .repartition("t", "code", "part").sortWithinPartitions("t", "code", "part", "asks"))

    def search(batches):
        bucket, ids, x = None, [], []
        for batch in batches:
            t, code, part, asks = (batch.column(i).to_numpy() for i in range(4))
            new = np.flatnonzero((np.diff(t) != 0) | (np.diff(code) != 0) | (np.diff(part) != 0) | (np.diff(asks) != 0)) + 1
            found = []
            for a, b in zip([0, *new], [*new, len(t)]):
                if a == b:
                    continue
                here = (t[a], code[a], part[a])
                if here != bucket:
                    bucket, ids, x = here, [], []
                some, vectors = batch.column(4).slice(a, b - a), matrix(batch.column(5).slice(a, b - a))
                if not asks[a]:
                    ids.append(some)
                    x.append(vectors)
                elif ids:
                    if len(ids) > 1:
                        ids, x = [pa.concat_arrays(ids)], [np.concatenate(x)]
                    found.append(nearest(some, vectors, ids[0], x[0], k, exclude_self))
            if found:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([f[i] for f in found]) for i in range(4)],
                                                 ["qid", "rid", "d", "compared"])

    return _best_of(rows.mapInArrow(search, result), k)


def _probe_all(query: DataFrame, members: DataFrame, n: int, tables: int, k: int, exclude_self: bool, result: str) -> DataFrame:
    """Every query in every bucket: the buckets' parts lie in pages of about ``SLICE_ROWS`` rows, the queries in slices,
    and a query is dealt once per page instead of once per bucket.  A task keeps the ``k`` best over its page."""
    a, b = slices(query.count(), n, SLICE_ROWS, query.sparkSession.sparkContext.defaultParallelism)

    def each(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    asked = (query.withColumn("qs", F.pmod(F.xxhash64("qid", "x"), F.lit(a)).cast("int")).withColumn("rs", each(b))
             .withColumn("t", each(tables)))
    known = (members.select("t", "code", "part", "id", "x", F.pmod(F.xxhash64("code", "part"), F.lit(b)).cast("int").alias("rs"))
             .withColumn("qs", each(a)))

    def search(q: pa.Table, r: pa.Table) -> pa.Table:
        qids, rids = q.column("qid").combine_chunks(), r.column("id").combine_chunks()
        if not len(qids) or not len(rids):
            return pa.table({"qid": qids.slice(0, 0), "rid": rids.slice(0, 0), "d": pa.array([], pa.float64()), "compared": pa.array([], pa.int64())})
        q_no, r_no = id_numbers(qids, rids)
        bucket = np.unique(np.stack([r.column(c).to_numpy().astype(np.int64) for c in ("code", "part")], axis=1), axis=0, return_inverse=True)[1]
        x = matrix(r.column("x"))
        some = np.unique(np.column_stack([r_no, x]), axis=0, return_index=True)[1] if len(np.unique(r_no)) < len(r_no) else np.arange(len(x))
        # a pair counts once, so room is left for ids that several vectors share
        most = int(np.unique(r_no[some], return_counts=True)[1].max())
        i, j, d = nearest_rows(matrix(q.column("x")), q_no, x[some], r_no[some], k * most, exclude_self, cell=bucket.reshape(-1)[some])
        j = some[j]
        done = len(rids) - (np.isin(q_no, r_no) if exclude_self else np.zeros(len(qids), bool))
        return pa.table({"qid": pa.concat_arrays([qids.take(pa.array(i)), qids]),
                         "rid": pa.concat_arrays([rids.take(pa.array(j)), pa.nulls(len(qids), rids.type)]),
                         "d": pa.array(np.concatenate([d, np.zeros(len(qids))])),
                         "compared": pa.array(np.concatenate([np.zeros(len(i), np.int64), done.astype(np.int64)]))})

    keys = ("t", "qs", "rs")
    return asked.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(search, result)


def _best_of(best: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of the rows found per query; rows without ``rid`` carry the number of distances."""
    per = best.groupBy("qid", "rid").agg(F.min("d").alias("d"), F.sum("compared").alias("compared"))
    w = Window.partitionBy("qid")
    return (per.withColumn("compared", F.sum("compared").over(w)).where("rid IS NOT NULL")
            .withColumn("rank", F.row_number().over(w.orderBy("d", "rid"))).where(F.col("rank") <= k))


def nearest(qids: pa.Array, q: np.ndarray, rids: pa.Array, r: np.ndarray, k: int, exclude_self: bool):
    """``qid, rid, d, compared`` of the ``k`` nearest rows of one bucket per query; a row without ``rid`` per
    query carries the number of distances."""
    own_q, own_r = np.asarray(qids), np.asarray(rids)
    order = np.argsort(own_r, kind="stable")            # so that ties go to the smaller key
    own_r, r = own_r[order], r[order]
    keep = min(k, len(r))
    rows, cols, ds = [], [], []
    step = max(1, (1 << 21) // (r.size or 1))
    for a in range(0, len(q), step):
        d = np.sqrt(((q[a:a + step, None, :] - r[None]) ** 2).sum(axis=2))
        if exclude_self:
            d[own_q[a:a + step, None] == own_r[None]] = np.inf
        if keep < len(r):
            # all rows up to the k-th distance: ties at the edge are settled by the stable sort
            edge = np.partition(d, keep - 1, axis=1)[:, keep - 1:keep]
            i, j = np.nonzero((d <= edge) & np.isfinite(d))
        else:
            i, j = np.nonzero(np.isfinite(d))
        v = d[i, j]
        by = np.lexsort((j, v, i))
        i, j, v = i[by], j[by], v[by]
        first = np.searchsorted(i, np.arange(len(d)))
        ok = np.arange(len(i)) - first[i] < keep
        rows.append(i[ok] + a)
        cols.append(j[ok])
        ds.append(v[ok])
    rows, cols, ds = np.concatenate(rows), np.concatenate(cols), np.concatenate(ds)
    done = len(r) - (np.isin(own_q, own_r) if exclude_self else np.zeros(len(q), bool))
    none = pa.nulls(len(q), rids.type)
    return (pa.concat_arrays([qids.take(pa.array(rows)), qids]),
            pa.concat_arrays([rids.take(pa.array(order[cols])), none]),
            pa.array(np.concatenate([ds, np.zeros(len(q))])),
            pa.array(np.concatenate([np.zeros(len(rows), np.int64), done.astype(np.int64)])))
