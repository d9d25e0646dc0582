"""Exact neighbours and silhouettes by slices: equal to brute force, and what is shuffled grows with the rows."""

import numpy as np
import pytest

from flowsentry.operators import neighbors as NB
from flowsentry.operators.projections import knn_approximate
from flowsentry.operators.slices import SLICE_ROWS, slices


def frame(spark, x, labels=None, ids=None):
    rows = [(int(i if ids is None else ids[i]), [float(v) for v in r], None if labels is None else int(labels[i])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, x array<double>, cluster int").repartition(3)


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def clustered(rng):
    return np.concatenate([rng.normal(size=(120, 3)) + 1e4, 0.01 * rng.normal(size=(150, 3)), np.zeros((30, 3)), np.ones((30, 3))])


@pytest.mark.parametrize("slice_rows", [50, 65_536])
def test_neighbours_over_many_slices_equal_brute_force(spark, slice_rows):
    x = clustered(np.random.default_rng(0))
    df = frame(spark, x)
    got = {}
    for r in NB.knn(df, df, 7, exclude_self=True, slice_rows=slice_rows, chunk_rows=16, q_block_rows=32).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["rid"], r["d"]))
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        want = np.lexsort((np.arange(len(x)), d[i]))[:7]
        found = sorted(got[i])
        assert [rid for _, rid, _ in found] == list(want) and np.allclose([v for *_, v in found], d[i, want], rtol=1e-12)


def test_rows_that_are_not_finite_have_no_neighbours(spark):
    x = np.random.default_rng(1).normal(size=(60, 2))
    x[3, 0], x[7, 1] = np.nan, np.inf
    df = frame(spark, x)
    got = NB.knn(df, df, 4, exclude_self=True).collect()
    assert {r.qid for r in got} == set(range(60)) - {3, 7} and not {3, 7} & {r.rid for r in got} and len(got) == 58 * 4


@pytest.mark.parametrize("slice_rows", [40, 65_536])
def test_silhouette_over_many_slices_equals_brute_force(spark, slice_rows):
    rng = np.random.default_rng(2)
    x = clustered(rng)
    c = rng.integers(0, 3, len(x))
    c[5] = 9                                    # a cluster of one
    d = distances(x)
    got = {r.row_id: r.silhouette for r in NB.silhouette_exact(frame(spark, x, c), block_rows=32, slice_rows=slice_rows).collect()}
    for i in range(len(x)):
        own = (c == c[i]) & (np.arange(len(x)) != i)
        if not own.any():
            assert got[i] == 0.0
            continue
        a, b = d[i, own].mean(), min(d[i, c == k].mean() for k in set(c) - {c[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_copies_of_a_row_stay_few():
    for n in (100, 10_000, 100_000, 600_000):
        a, b = slices(n, n, SLICE_ROWS, 12)
        assert a * b >= min(12, n // 256) and a + b <= 26 and n / b <= SLICE_ROWS


def test_every_bucket_can_be_probed_whatever_their_number(spark):
    x = np.random.default_rng(4).normal(size=(6_000, 3))        # 2^13 buckets of one row
    df = frame(spark, x)
    got = {}
    for r in knn_approximate(df.where("row_id < 50"), df, 5, exclude_self=True, tables=1, bucket_rows=1, share=1.0).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.rid, r.compared))
    d = np.sqrt(((x[:50, None] - x[None]) ** 2).sum(-1))
    d[np.arange(50), np.arange(50)] = np.inf
    for i in range(50):
        assert [v for _, v, _ in sorted(got[i])] == list(np.argsort(d[i], kind="stable")[:5]) and got[i][0][2] == 5_999


def test_repeated_rows_leave_room_for_other_neighbours(spark):
    x = np.random.default_rng(5).normal(size=(40, 3))
    df = frame(spark, np.concatenate([x, x[:20]]), ids=[*range(40), *range(20)])
    rows = knn_approximate(df, df, 6, exclude_self=True, tables=1, bucket_rows=64, share=1.0).collect()
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    for i in range(40):
        assert [r.rid for r in sorted(rows, key=lambda r: r["rank"]) if r.qid == i] == list(np.argsort(d[i])[:6])
