"""Quantiles by counts only: ties, infinities, many decades, many groups and columns; sweeps built on them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import metrics as M
from flowsentry.operators import quantiles as Q
from flowsentry.operators.stats import exact_quantiles

FRACS = [0.0, 0.001, 0.01, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


def linear(v, f):
    """numpy's rule; two equal neighbours need no difference (numpy gives NaN between equal infinities)."""
    s, h = np.sort(v), f * (len(v) - 1)
    a, b = s[math.floor(h)], s[math.ceil(h)]
    return a if a == b else a + (b - a) * (h - math.floor(h))


def test_ties_infinities_and_decades(spark):
    rng = np.random.default_rng(0)
    parts = [np.full(200_000, 3.25), np.full(500, np.inf), np.full(700, -np.inf), 10.0 ** rng.uniform(-300, 300, 5000),
             -(10.0 ** rng.uniform(-300, 300, 5000)), np.zeros(100), np.array([5e-324, -5e-324, 1.7e308, -0.0])]
    v = np.concatenate(parts)
    rng.shuffle(v)
    df = spark.createDataFrame(v.reshape(-1, 1).tolist(), "v double")
    for bins in (2, 512):
        got = exact_quantiles(df, "v", FRACS, bins=bins)
        for f, g in zip(FRACS, got):
            assert g == linear(v, f) or g == pytest.approx(linear(v, f), rel=1e-12)


def test_neighbouring_doubles_are_told_apart(spark):
    v = [1.0]
    for _ in range(300):
        v.append(math.nextafter(v[-1], 2))
    df = spark.createDataFrame([(x,) for x in v], "v double")
    assert exact_quantiles(df, "v", [0.0, 1 / 3, 0.5, 1.0], bins=2) == [v[0], v[100], v[150], v[300]]


def test_groups_and_columns(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=999), None: rng.integers(0, 4, 50).astype(float), "one": np.array([7.0])}
    rows = [(g, float(x)) for g, vs in data.items() for x in vs] + [("a", None), ("a", math.nan), ("none", None)]
    got = Q.grouped_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", FRACS, "g")
    assert set(got) == set(data)
    for g, vs in data.items():
        assert np.allclose(got[g], np.quantile(vs, FRACS), rtol=1e-12)
    wide = spark.createDataFrame([(1.0, None, 5), (3.0, None, 6), (None, None, 7)], "p double, q double, r int")
    assert Q.column_quantiles(wide, ["p", "q", "r"], [0.5]) == {"p": [2.0], "q": [None], "r": [6.0]}
    assert Q.grouped_quantiles(wide.limit(0), "p", [0.5]) == {}


def test_only_counts_are_collected(spark, monkeypatch):
    """The rows that reach the driver are bounded by ranks and bins, whatever the ties."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(r := collect(self)) or r)
    df = spark.range(300_000).select((F.pmod(F.xxhash64("id"), F.lit(100_003)) / 7.0).alias("v"))
    exact_quantiles(df, "v", [0.5, 0.9], bins=64)
    assert max(map(len, seen)) <= 4 * 64


@pytest.mark.parametrize("strict", [True, False])
def test_counts_beyond_thresholds(spark, strict):
    rows = [(float(x), y) for x in (-2, 0, 1, 1, 5, math.inf, -math.inf) for y in (0, 1)] + [(None, 1), (math.nan, 1), (math.nan, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    ts = [1.0, -math.inf, 5.0, math.inf, 0.5, 1.7976931348623157e308, 1.0]

    def beyond(s, t):
        return s is not None and (math.isnan(s) or (s > t if strict else s >= t))

    got = {r["i"]: r for r in M.counts_beyond(df, "s", "y", ts, strict).collect()}
    for i, t in enumerate(ts):
        assert got[i]["tp"] == sum(beyond(s, t) and y == 1 for s, y in rows), t
        assert got[i]["fp"] == sum(beyond(s, t) and y == 0 for s, y in rows), t
        assert got[i]["P"] == 9 and got[i]["threshold"] == t
