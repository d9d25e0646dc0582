"""Detector comparison, one-class grid, null-safe header filter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import forest as FR
from flowsentry.operators.stats import contamination_cut
from flowsentry.plans import experiments as E
from flowsentry.plans.catalog import QUERIES
from flowsentry.sources.flows import read_cic

from .conftest import SF_SMALL
from .test_quantiles import linear


def test_header_filter_keeps_rows_with_an_empty_label(spark, tmp_path):
    path = tmp_path / "day.csv"
    path.write_text(" Flow Duration, Label\n1,BENIGN\n2,\nFlow Duration,Label\n3,DoS\n")
    assert read_cic(spark, str(path)).count() == 3


def test_one_class_grid_ranks_outliers_first(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.3, 4).tolist()) for i in range(200)] + [(200 + i, (rng.normal(0, 0.3, 4) + 4).tolist()) for i in range(10)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>")
    maps = {"rbf": FR.fit_kernel_map(df, "x", "rbf", 0.5, 128)}
    fits = FR.fit_one_class_grid(df.where("row_id < 200"), "x", (0.05, 0.1), maps)
    assert set(fits) == {("rbf", 0.05), ("rbf", 0.1)}
    for (_, nu), fit in fits.items():
        scored = fit.model.score(df).toPandas().sort_values("score")
        assert set(scored.tail(10).row_id) == set(range(200, 210))
        assert abs((scored[scored.row_id < 200].score > 0).mean() - nu) < 0.03


def test_counts_of_cuts_and_choice(spark):
    df = spark.createDataFrame([(0, int(i >= 90), float(i)) for i in range(100)], "fit int, y int, score double")
    models = [E.Candidate("d", {}, (0.01, 0.05, 0.1)), E.Candidate("e", {}, (), None, "failed: x")]
    counts = E.cut_counts(df, models).collect()
    q = {r["cut"]: E.quality(r) for r in counts}
    assert [q[c]["flagged"] for c in (0.01, 0.05, 0.1)] == [1, 5, 10] and q[0.1]["recall"] == 1.0 and q[0.1]["rows"] == 100
    assert E.pick(models, counts)["d"][1] == 0.1 and "e" not in E.pick(models, counts)
    assert E.pick(models, counts, {0: 0.4}) == {"d": (0, 0.01, 0.4)}


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_cuts_of_many_models_equal_one_by_one(spark, n):
    rng = np.random.default_rng(n)
    scores = {0: rng.normal(size=n), 1: rng.integers(0, 3, n).astype(float), 2: np.full(n, 2.5),
              3: np.where(rng.random(n) < 0.3, np.inf, rng.lognormal(0, 90, n)), 4: rng.normal(size=n) * 1e-300}
    rows = [(f, i, int(i % 3 == 0), float(v)) for f, vs in scores.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "fit int, row_id int, y int, score double")
    models = [E.Candidate(str(f), {}, E.FOREST_CUTS) for f in scores]
    got = {(r["fit"], r["cut"]): r for r in E.cut_counts(df, models).collect()}
    assert len(got) == len(scores) * len(E.FOREST_CUTS)
    for f in scores:
        for c in E.FOREST_CUTS:
            one = contamination_cut(df.where(F.col("fit") == f), "score", c).where("pred = 1").count()
            assert got[f, c]["tp"] + got[f, c]["fp"] == one == int((scores[f] >= linear(scores[f], 1.0 - c)).sum())


def test_measures_without_labels_are_the_studys(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=400), rng.lognormal(size=400)
    df = spark.createDataFrame([(0, float(v)) for v in a] + [(1, float(v)) for v in b], "fit int, score double")
    models = [E.Candidate("a", {}, (0.1,)), E.Candidate("b", {}, (0.1,)), E.Candidate("c", {}, (0.1,), silhouette=lambda: 0.25)]
    got = E.unsupervised_measure(df, models)
    want = [np.quantile(v, [0.75, 0.9, 0.99]).mean() - np.quantile(v, [0.01, 0.1, 0.25]).mean() for v in (a, b)]
    assert got[2] == 0.25 and np.allclose([got[0], got[1]], want)


@pytest.mark.parametrize("kind", ["rbf", "poly"])
def test_kernel_svm_queries_use_512_features(spark, monkeypatch, kind):
    class Fitted(Exception):
        pass

    def stop(df, feat, kind_, gamma="scale", n_components=512, **kw):
        raise Fitted(kind_, n_components)

    monkeypatch.setattr(FR, "fit_kernel_map", stop)
    query = {"rbf": "m4_rbf_svm", "poly": "m5_poly_svm"}[kind]
    with pytest.raises(Fitted) as got:
        QUERIES[query](spark, SF_SMALL)
    assert got.value.args == (kind, 512)


def test_sigmoid_map_gives_the_positive_part_of_the_kernel(spark):
    x = np.random.default_rng(5).normal(size=(40, 6))
    df = spark.createDataFrame([(str(i), r.tolist()) for i, r in enumerate(x)], "row_id string, x array<double>")
    km = FR.fit_kernel_map(df, "x", "sigmoid", 0.3, 512)
    phi = np.array([r.phi for r in km.transform(df, "x", "phi").orderBy(F.col("row_id").cast("int")).collect()])
    values, vectors = np.linalg.eigh(np.tanh(0.3 * x @ x.T))
    solid = values > 1e-10 * values.max()
    assert np.allclose(phi @ phi.T, (vectors[:, solid] * values[solid]) @ vectors[:, solid].T, atol=1e-8)
