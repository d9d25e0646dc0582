"""Approximate nearest neighbours by a random-projection forest (operator 10).

* Fit: a bounded sample of vectors (about ``sample`` rows) grows ``trees`` trees; every inner
  node splits its sample at the median of the projection on the difference of two members.  The
  forest has at most ``trees * leaves`` nodes, whatever the table's size.  For inner products
  vectors get one more coordinate that gives all of them the same length.
* Index: every row goes down every tree and lands in one leaf per tree.  Of equal vectors only
  the ``k + 1`` smallest ids can ever be among the ``k`` nearest of any query, so only those are
  indexed, repeated rows once; this is exact and keeps a vector that fills a third of the table out of one leaf.
  A leaf with more rows or queries than a block is split by hash.
* Search: one priority queue shared by all trees holds the nodes not yet entered, ordered by the
  distance to the nearest split plane on their way; the query enters the most promising ones
  until it has visited its share of the leaves.  Leaves are reranked by exact inner products in double
  precision, and the best of all leaves merge into the answer.

Recall against brute force is measured in the tests.  Vectors without structure (as in the test
tables, drawn from all directions alike) need about half of all rows for a recall above 0.9,
as any partition of space does in 64 dimensions; with structure a smaller ``share`` will do.

Edge cases: vectors that are NULL, empty, zero, of another length than most, or with a NULL or
non-finite component take no part; a query with fewer candidates than ``k`` returns all;
rows of one id count as one
candidate with the best of their scores; rows without an id take no part; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch


@dataclass
class Forest:
    planes: np.ndarray       # node x dimension + 1
    offsets: np.ndarray
    children: np.ndarray     # node x 2; negative: leaf -(x + 1)
    roots: list
    n_leaves: int
    longest: float
    leaf_rows: list          # rows of the sample in each leaf

    def extend(self, x: np.ndarray) -> np.ndarray:
        """The extra coordinate: equal lengths, so that the largest inner product is the nearest."""
        rest = np.sqrt(np.maximum(self.longest ** 2 - (x * x).sum(axis=1), 0.0))
        return np.column_stack([x, rest])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree."""
        side = self.extend(x) @ self.planes.T > self.offsets
        out = np.zeros((len(x), len(self.roots)), np.int32)
        rows = np.arange(len(x))
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (inner := at >= 0).any():
                at[inner] = self.children[at[inner], side[rows[inner], at[inner]].astype(int)]
            out[:, t] = -at - 1
        return out

    def search(self, q: np.ndarray, visits: int, least: float) -> np.ndarray:
        """Leaves of a query in the order of the shared queue: ``visits`` of them, and ``least`` sampled rows."""
        margin = np.append(q, 0.0) @ self.planes.T - self.offsets
        heap = [(-np.inf, i, r) for i, r in enumerate(self.roots)]      # (largest margin crossed, order, node)
        heapq.heapify(heap)
        order, found, held = len(heap), [], 0
        while heap and (len(found) < visits or held < least):
            cost, _, at = heapq.heappop(heap)
            while at >= 0:
                m = margin[at]
                near, far = (1, 0) if m > 0 else (0, 1)
                heapq.heappush(heap, (max(cost, abs(m)), order, self.children[at, far]))
                order += 1
                at = self.children[at, near]
            found.append(-at - 1)
            held += self.leaf_rows[-at - 1]
        return np.array(found, np.int32)


def grow(x: np.ndarray, trees: int, leaves: int, seed: int = 5) -> Forest:
    """Trees over a sample; a node is split while it may still have several leaves and rows."""
    longest = float(np.sqrt((x * x).sum(axis=1).max())) if len(x) else 1.0
    dim = x.shape[1] + 1 if x.ndim == 2 else 1
    forest = Forest(np.zeros((0, dim)), np.zeros(0), np.zeros((0, 2), np.int64), [], 0, longest, [])
    full = forest.extend(x) if len(x) else np.zeros((0, dim))
    rng = np.random.default_rng(seed)
    planes, offsets, children = [], [], []

    def leaf(rows):
        forest.n_leaves += 1
        forest.leaf_rows.append(len(rows))
        return -forest.n_leaves

    def build(rows, budget):
        if budget < 2 or len(rows) < 2:
            return leaf(rows)
        for _ in range(8):
            a, b = full[rng.choice(rows, 2, replace=False)]
            w = a - b
            size = np.linalg.norm(w)
            if size > 0:
                break
        else:
            return leaf(rows)
        w = w / size
        p = full[rows] @ w
        cut = float(np.median(p))
        right = p > cut
        if not right.any() or right.all():
            return leaf(rows)
        at = len(planes)
        planes.append(w)
        offsets.append(cut)
        children.append([0, 0])
        children[at] = [build(rows[~right], budget // 2), build(rows[right], budget - budget // 2)]
        return at

    for _ in range(trees):
        forest.roots.append(build(np.arange(len(full)), leaves))
    if planes:
        forest.planes, forest.offsets = np.array(planes), np.array(offsets)
        forest.children = np.array(children, np.int64)
    return forest


def to_matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column without NULLs as doubles (all of one length)."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def pair_products(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray, run: int = 1 << 15) -> np.ndarray:
    """Inner products of the pairs ``(q[r], x[c])``, summed in one order for every pair.

    A matrix product may round equal vectors differently by their place in it; here they tie exactly.
    """
    out = np.empty(len(r))
    for a in range(0, len(r), run):
        out[a:a + run] = (q[r[a:a + run]] * x[c[a:a + run]]).sum(axis=1)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of rows whose vector takes part (of the commonest length)."""
    x = F.col("embedding").cast("array<double>")
    ok = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
          & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
          & F.exists(x, lambda v: v != 0))
    rows = vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    lengths = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("embedding") == (lengths["d"] if lengths else 0))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, trees: int = 10, leaves: int = 64, share: float = 0.1,
            sample: int = 20000, block: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row whose id is divisible by ``every``.

    Every tree has ``leaves`` leaves, whatever the table's size.  A query visits ``share`` of all leaves of the forest,
    and goes on until they hold ``4 * (k + 1)`` rows per tree (all rows, if there are fewer).  For tables with structure, more leaves and a smaller share read far fewer rows.
    """
    spark = vectors.sparkSession
    rows = scratch(usable(vectors).distinct(), "ann-rows")
    n = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("ann")), F.lit(1 << 40)) < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 40))))
    fit = drawn.select("embedding").toArrow().column(0).combine_chunks()
    fit = fit.chunk(0) if isinstance(fit, pa.ChunkedArray) and fit.num_chunks else fit
    grown = grow(to_matrix(fit) if len(fit) else np.zeros((0, 1)), trees, leaves)
    visits = max(1, math.ceil(share * grown.n_leaves))
    least = trees * min(len(fit), 4 * (k + 1) * len(fit) / max(n, 1))
    forest = spark.sparkContext.broadcast(grown)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    # equal vectors: the k + 1 smallest ids are all that any query can need (rows are distinct)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    indexed = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy")

    kind = rows.schema["embedding"].dataType.simpleString()
    schema = f"vec_id long, embedding {kind}, leaf array<int>"

    def lists(batch, found):
        size = np.array([len(f) for f in found])
        leaf = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(np.concatenate(found)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), leaf], ["vec_id", "embedding", "leaf"])

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                yield lists(batch, forest.value.leaves(to_matrix(batch.column(1))))

    def visit(batches):
        for batch in batches:
            if batch.num_rows:
                yield lists(batch, [forest.value.search(q, visits, least) for q in to_matrix(batch.column(1))])

    entries = scratch(indexed.select("vec_id", "embedding").mapInArrow(index, schema), "ann-entries")
    asked = scratch(rows.where(F.col("vec_id") % every == 0).repartition("vec_id").mapInArrow(visit, schema), "ann-asked")

    # a leaf with more rows than a block is split by hash, its queries go to all parts, and the
    # other way round; the counts are one number per leaf, whatever the table's size
    def split(frame: DataFrame) -> dict:
        got = frame.select(F.explode("leaf").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()
        return {r["leaf"]: -(-r["n"] // block) for r in got if r["n"] > block}

    def dealt(frame: DataFrame, own: dict, other: dict, mine: str, theirs: str) -> DataFrame:
        def parts(table):
            at = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[F.col("leaf")] if table else F.lit(None)
            return F.coalesce(at.cast("int"), F.lit(1))
        return (frame.withColumn("leaf", F.explode("leaf"))
                .withColumn(mine, F.pmod(F.xxhash64("vec_id"), parts(own)).cast("int"))
                .withColumn(theirs, F.explode(F.sequence(F.lit(0), parts(other) - 1))))

    of_rows, of_asked = split(entries), split(asked)
    left_side = dealt(entries, of_rows, of_asked, "part", "ask")
    right_side = dealt(asked, of_asked, of_rows, "ask", "part")

    def rerank(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        ids = left.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        x = to_matrix(left.column("embedding").combine_chunks())[order]
        start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))        # first row of each id
        asks, q = right.column("vec_id").to_numpy(), to_matrix(right.column("embedding").combine_chunks())
        longest = np.linalg.norm(x, axis=1).max()
        out_q, out_v, out_s = [], [], []
        for a in range(0, len(asks), 256):
            s = q[a:a + 256] @ x.T
            s[asks[a:a + 256, None] == ids[None, :]] = -np.inf
            if len(start) > k:      # all that reach the k-th best score within rounding, then ties by the smaller id
                of_id = s if len(start) == len(ids) else np.maximum.reduceat(s, start, axis=1)
                least = -np.partition(-of_id, k - 1, axis=1)[:, k - 1:k] - 1e-12 * np.linalg.norm(q[a:a + 256], axis=1)[:, None] * longest
            else:
                least = np.full((len(s), 1), -np.inf)
            r, c = np.nonzero((s >= least) & (s > -np.inf))
            exact = pair_products(q[a:a + 256], x, r, c)
            o = np.lexsort((ids[c], -exact, r))
            r, c, exact = r[o], c[o], exact[o]
            if len(start) < len(ids):       # an id with several vectors counts once, by its best
                first = np.sort(np.unique(np.column_stack([r, ids[c]]), axis=0, return_index=True)[1])
                r, c, exact = r[first], c[first], exact[first]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            top = place < k
            out_q.append(asks[a + r[top]])
            out_v.append(ids[c[top]])
            out_s.append(exact[top])
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    found = (left_side.groupBy("leaf", "part", "ask").cogroup(right_side.groupBy("leaf", "part", "ask"))
             .applyInArrow(rerank, "query_id long, vec_id long, score double"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def brute_force(ids: np.ndarray, x: np.ndarray, k: int = 20, every: int = 20) -> dict:
    """Exact answers, for measuring recall on small tables."""
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        s[i] = -np.inf
        order = np.lexsort((ids, -s))[:k]
        out[int(ids[i])] = [int(ids[j]) for j in order if s[j] > -np.inf]
    return out
