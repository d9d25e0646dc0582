"""Approximate neighbours against brute force: recall, work, ties, hot vectors; LOF on top."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import neighbors as NB
from flowsentry.operators import projections as P

SF = "/root/testdata/sf0.1"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(x)], "row_id long, x array<double>").repartition(6)


def brute(q, r, k, same):
    d = np.sqrt(((q[:, None] - r[None]) ** 2).sum(axis=2))
    if same:
        np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def recall(found, want):
    got = {}
    for r in found:
        got.setdefault(r["qid"], set()).add(r["rid"])
    return np.mean([len(got.get(i, set()) & set(w.tolist())) / len(w) for i, w in enumerate(want)])


def test_recall_and_work_on_reduced_embeddings(spark):
    """No structure at all: the hardest case."""
    x = np.array(pq.read_table(f"{SF}/embeddings.parquet", columns=["embedding"]).column(0).to_pylist())
    x -= x.mean(axis=0)
    z = x @ np.linalg.svd(x, full_matrices=False)[2][:30].T
    df = frame(spark, z)
    rows = P.knn_approximate(df, df, 10, exclude_self=True).collect()
    work = np.mean([r["compared"] for r in rows if r["rank"] == 1]) / len(z)
    assert recall(rows, brute(z, z, 10, True)) >= 0.9 and work < 0.6
    for r in rows[::97]:
        assert r["d"] == pytest.approx(np.linalg.norm(z[r["qid"]] - z[r["rid"]]), rel=1e-12)


def test_work_does_not_grow_on_clustered_rows(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(300, 30)) * 3
    share = {}
    for n in (2500, 10000):
        z = centres[rng.integers(0, 300, n)] + rng.normal(size=(n, 30)) * 0.5
        df = frame(spark, z)
        rows = P.knn_approximate(df, df.where("row_id < 400"), 5, probes=6).collect()
        share[n] = np.mean([r["compared"] for r in rows if r["rank"] == 1])
        rows = P.knn_approximate(df.where("row_id < 400"), df, 5, probes=6).collect()
        assert recall(rows, brute(z[:400], z, 5, False)) >= 0.9
        share[n] = np.mean([r["compared"] for r in rows if r["rank"] == 1])
    assert share[10000] < 1.6 * share[2500] and share[10000] < 0.1 * 10000


def test_all_probes_are_exact_with_ties_and_hot_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (400, 3)).astype(float)
    x[::3] = [1.0, 2.0, 0.0]                    # a third of all rows
    df = frame(spark, x).withColumn("row_id", F.concat(F.lit("r"), F.format_string("%04d", "row_id")))
    for size in (1, 64):
        rows = P.knn_approximate(df, df, 7, exclude_self=True, tables=2, bucket_rows=size, share=1.0).collect()
        got = [[] for _ in x]
        for r in sorted(rows, key=lambda r: (r["qid"], r["rank"])):
            got[int(r["qid"][1:])].append(int(r["rid"][1:]))
        assert np.array_equal(got, brute(x, x, 7, True))


def test_large_buckets_are_split(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(3000, 8)) * 1e-9, rng.normal(size=(300, 8))])
    df = frame(spark, x)
    rows = P.knn_approximate(df.where("row_id >= 2990"), df, 4, tables=1, bucket_rows=4000, share=1.0).collect()
    want = brute(x[2990:], x, 4, False)
    got = {q: [r["rid"] for r in sorted(rows, key=lambda r: r["rank"]) if r["qid"] == q] for q in range(2990, 3300)}
    assert all(got[2990 + i] == w.tolist() for i, w in enumerate(want))


def test_empty_missing_and_few(spark):
    df = frame(spark, np.arange(6.0).reshape(3, 2))
    none = df.limit(0)
    assert P.knn_approximate(df, none, 3).count() == 0 and P.knn_approximate(none, df, 3).count() == 0
    rows = P.knn_approximate(df.union(spark.createDataFrame([(9, None)], df.schema)), df, 5, share=1.0).collect()
    assert len(rows) == 9 and {r["qid"] for r in rows} == {0, 1, 2}
    with pytest.raises(ValueError):
        NB.neighbours(df, df, 2, method="nearly")


def test_lof_on_approximate_neighbours_ranks_outliers_first(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 10)) * 4
    z = np.concatenate([centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 10)) * 0.3, rng.normal(size=(15, 10)) * 12])
    df = frame(spark, z)
    near = {r.row_id: r.score for r in NB.lof_scores(df, None, 10).collect()}
    exact = {r.row_id: r.score for r in NB.lof_scores(df, None, 10, method="exact").collect()}
    assert set(sorted(near, key=near.get)[-15:]) == set(range(1500, 1515))
    a, b = (np.array([m[i] for i in range(1500)]) for m in (near, exact))
    assert np.mean(np.abs(a - b) < 1e-9) > 0.8 and np.corrcoef(a, b)[0, 1] > 0.9


def test_lof_grid_equals_single_runs(spark):
    rng = np.random.default_rng(5)
    tr, ev = frame(spark, rng.normal(size=(150, 4))), frame(spark, rng.normal(size=(40, 4)), 500)
    grid = NB.lof_scores_grid(tr, ev, (3, 8), method="exact").collect()
    for k in (3, 8):
        one = {r.row_id: r.score for r in NB.lof_scores(tr, ev, k, method="exact").collect()}
        assert {r.row_id: r.score for r in grid if r.k == k} == pytest.approx(one)
