"""Fitted values of the detectors (D-2, D-3, D-7), PCA in two scans, curves at every number of distinct scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.functions.blocks import with_block
from flowsentry.operators import forest as FR
from flowsentry.operators import metrics as M
from flowsentry.operators.detect import fit_kmeans, fit_reconstruction
from flowsentry.operators.features import fit_pca


def _frame(spark, X, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "row_id long, x array<double>").repartition(parts)


def _scores(df):
    return np.array([r.score for r in df.orderBy("row_id").collect()])


# --- isolation forest (D-3) ----------------------------------------------------------------------

def _by_hand(trees, psi, x):
    """2^(-mean path / c(psi)), one row and one node at a time."""
    def c(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n

    total = 0.0
    for feat, thr, left, right, size in trees:
        node, depth = 0, 0
        while feat[node] >= 0:
            node, depth = (left if x[feat[node]] < thr[node] else right)[node], depth + 1
        total += depth + c(size[node])
    return 2.0 ** (-(total / len(trees)) / c(psi))


def test_isolation_forest_scores_equal_a_walk_by_hand(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(900, 4))
    X[:9] += 9.0
    df = _frame(spark, X)
    model = FR.fit_isolation_forest(df, "x", n_trees=40, max_samples=64)
    assert len(model.trees) == 40 and model.max_samples == 64
    for feat, thr, left, right, size in model.trees:
        assert size[0] == 64                            # a whole sample each
        for i, f in enumerate(feat):
            if f >= 0:
                assert size[i] == size[left[i]] + size[right[i]] and min(size[left[i]], size[right[i]]) > 0
                assert X[:, f].min() <= thr[i] <= X[:, f].max()
    got = _scores(model.score(df, "x"))
    assert np.allclose(got, [_by_hand(model.trees, 64, x) for x in X], rtol=0, atol=1e-12)
    assert set(np.argsort(-got)[:9]) == set(range(9))   # the planted rows


def test_isolation_forest_draws_differ_by_tree_and_repeat_by_seed(spark):
    df = _frame(spark, np.random.default_rng(2).normal(size=(2000, 2)))
    one, two = (FR.fit_isolation_forest(df, "x", n_trees=12, max_samples=32) for _ in range(2))
    assert one.trees == two.trees
    assert len({tuple(t[1]) for t in one.trees}) == 12
    few = FR.fit_isolation_forest(_frame(spark, [[0.0], [1.0], [5.0]]), "x", n_trees=5)
    assert few.max_samples == 3 and all(t[4][0] == 3 for t in few.trees)


# --- reconstruction error (D-7), PCA (F-4) --------------------------------------------------------

def test_reconstruction_error_equals_svd(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(250, 8)) @ rng.normal(size=(8, 8)) + 100.0
    got = _scores(fit_reconstruction(_frame(spark, X), "x").score(_frame(spark, X), "x"))
    mean = X.mean(0)
    top = np.linalg.svd(X - mean, full_matrices=False)[2][:4]
    back = (X - mean) @ top.T @ top + mean
    assert np.allclose(got, ((X - back) ** 2).mean(1), rtol=1e-7)


def test_pca_far_from_the_origin_and_of_few_rows(spark):
    X = np.random.default_rng(4).normal(size=(400, 5)) * [5, 3, 1, 1e-2, 1e-3] + 1e5
    fit = fit_pca(_frame(spark, X, 7), "x", 4)
    values = np.linalg.svd(X - X.mean(0), compute_uv=False) ** 2 / 399
    assert np.allclose(fit.explained_variance, values[:4], rtol=1e-5)
    assert np.allclose(np.array(fit.components) @ np.array(fit.components).T, np.eye(4), atol=1e-9)
    one = fit_pca(_frame(spark, [[1.0, 2.0, 3.0]], 2), "x", 2)
    assert one.mean == [1.0, 2.0, 3.0] and one.explained_variance == [0.0, 0.0]
    with pytest.raises(ValueError):
        fit_pca(spark.createDataFrame([], "x array<double>"), "x", 1, 3)


# --- k-means (D-2) -------------------------------------------------------------------------------

def test_k_means_centres_are_means_of_their_rows(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [8, 0], [0, 8]], float)
    X = np.concatenate([rng.normal(size=(150, 2)) + c for c in centres])
    model = fit_kmeans(_frame(spark, X), "x", 3)
    C = np.array(model.centers)
    D = np.linalg.norm(X[:, None] - C[None], axis=2)
    near = D.argmin(1)
    assert np.allclose(C, [X[near == k].mean(0) for k in range(3)], atol=1e-3)
    assert sorted(np.round(C).tolist()) == sorted(centres.tolist())
    rows = model.score(_frame(spark, X), "x").orderBy("row_id").collect()
    assert np.allclose([r.score for r in rows], D.min(1)) and [r.cluster for r in rows] == near.tolist()


# --- helpers -------------------------------------------------------------------------------------

def test_blocks_keep_other_columns_and_empty_tables(spark):
    df = _frame(spark, [[1.0, 2.0], [3.0, 4.0]]).withColumn("tag", F.lit("a")).withColumn("s", F.lit(-1))
    got = {r.row_id: (r.tag, r.s) for r in with_block(df, "x", "s", lambda m: m.sum(axis=1)).collect()}
    assert got == {0: ("a", 3.0), 1: ("a", 7.0)}
    lists = with_block(df, "x", "twice", lambda m: 2 * m, many=True).orderBy("row_id").collect()
    assert [r.twice for r in lists] == [[2.0, 4.0], [6.0, 8.0]]
    assert with_block(df.where("false"), "x", "s", lambda m: m.sum(axis=1)).collect() == []


@pytest.mark.parametrize("distinct", [1, 2, 60, 70, 400])
def test_auc_has_no_switch_in_the_number_of_scores(spark, distinct):
    rng = np.random.default_rng(distinct)
    s, y = rng.integers(0, distinct, 500).astype(float), rng.integers(0, 2, 500)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, y int")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert M.roc_auc(df).first().auc == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_with_null_nan_and_infinite_keys(spark, descending):
    keys = [None, float("-inf"), 1.0, 2.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(k, 10 ** i) for i, k in enumerate(keys)], "k double, w long")
    got = {str(r.k): r.cum_w for r in M.running_totals(df, "k", ["w"], descending=descending).collect()}
    total, want = 0, {}
    for i in (reversed(range(6)) if descending else range(6)):
        total += 10 ** i
        want[str(keys[i])] = total
    assert got == want
