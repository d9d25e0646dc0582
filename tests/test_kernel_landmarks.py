"""Kernel k-means by matrix sums, density rows, landmark features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import kernels as G


def angles(spark, n, width, seed=0, groups=2):
    rng = np.random.default_rng(seed)
    centre = rng.uniform(0.3, 2.8, (groups, width))
    x = centre[rng.integers(0, groups, n)] + rng.normal(size=(n, width)) * 0.15
    return x, spark.createDataFrame([(i, int(i % 2), r.tolist()) for i, r in enumerate(x)],
                                    "row_id long, y int, angle array<double>").repartition(5)


@pytest.mark.parametrize("kind", ["zz", "z", "rx"])
def test_density_rows_equal_the_column_form(spark, kind):
    _, df = angles(spark, 30, 3)
    fmap = G.build_feature_map(3, 1, kind)
    a = {r.row_id: r.v for r in G.density_rows(df, fmap).collect()}
    b = {r.row_id: r.v for r in G.kernel_vectors(df, fmap).collect()}
    assert all(np.allclose(a[i], b[i], atol=1e-12) for i in range(30))


def brute_lloyd(gram, labels, k, max_iter=100):
    for step in range(max_iter):
        d = np.full((len(gram), k), np.inf)
        for c in range(k):
            m = labels == c
            if m.any():
                d[:, c] = np.diag(gram) - 2 * gram[:, m].mean(axis=1) + gram[np.ix_(m, m)].mean()
        new = d.argmin(axis=1)
        if (new == labels).all():
            return labels, step + 1
        labels = new
    return labels, max_iter


@pytest.mark.parametrize("k", [2, 3])
def test_kernel_kmeans_equals_the_pair_matrix_loop(spark, k):
    x, df = angles(spark, 300, 4, k, groups=k)
    fmap = G.build_feature_map(4, 1, "zz")
    start = {r.row_id: r.c for r in df.select("row_id", G.initial_clusters(df, k).alias("c")).collect()}
    a = fmap.states(x)
    want, steps = brute_lloyd(np.abs(a @ a.conj().T) ** 2, np.array([start[i] for i in range(300)]), k)
    got, n = G.kernel_kmeans(G.density_rows(df, fmap), k)
    assert n == steps and {r.row_id: r.cluster for r in got.collect()} == dict(enumerate(want))
    cut, _ = G.kernel_kmeans(G.density_rows(df, fmap), k, max_iter=1)
    assert cut.count() == 300


def test_landmarks_agree_with_the_exact_loop(spark):
    _, df = angles(spark, 500, 4, 7)
    fmap = G.build_feature_map(4, 1, "zz")
    exact = {r.row_id: r.cluster for r in G.kernel_kmeans(G.density_rows(df, fmap), 2)[0].collect()}
    every = {r.row_id: r.cluster for r in G.kernel_kmeans(G.landmark_features(df, fmap, 500), 2)[0].collect()}
    some = {r.row_id: r.cluster for r in G.kernel_kmeans(G.landmark_features(df, fmap, 120), 2)[0].collect()}
    assert every == exact and np.mean([some[i] == exact[i] for i in exact]) > 0.97


def test_ten_thousand_rows_of_eight_angles(spark):
    x, df = angles(spark, 10_000, 8, 3)
    fmap = G.build_feature_map(8, 1, "zz")
    rows = G.landmark_features(df, fmap, 128)
    assert rows.select(F.max(F.size("v"))).first()[0] <= 128
    got, steps = G.kernel_kmeans(rows, 2, max_iter=20)
    assert got.groupBy("cluster").count().count() == 2 and steps >= 1
    v = {r.row_id: np.array(r.v) for r in rows.where("row_id < 40").collect()}
    a = fmap.states(x[:40])
    exact = np.abs(a @ a.conj().T) ** 2
    near = np.array([[v[i] @ v[j] for j in range(40)] for i in range(40)])
    assert np.abs(near - exact).mean() < 0.1
