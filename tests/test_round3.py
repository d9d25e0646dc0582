"""Merge by name, imputer, sparse categories, saved pipelines, run ledger end to end."""

import shutil
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from flowsentry.operators.features import fit_flow_encoder, fit_one_hot
from flowsentry.operators.impute import fit_imputer
from flowsentry.operators.models import RunRecord, fit_classifier, pipeline_of
from flowsentry.operators.sparse import fit_vocabulary, to_ml_vector
from flowsentry.operators.stages import Fit
from flowsentry.plans.experiments import run_supervised
from flowsentry.sources import flows as FL
from flowsentry.sources import sinks as SK

from .conftest import SF_SMALL


# --- merge by name (S-4, S-5) --------------------------------------------------------------------

def test_files_with_shuffled_and_missing_columns_merge_by_name(spark, tmp_path):
    (tmp_path / "mon.csv").write_text(" Flow Duration, Flow Bytes/s, Label\n1, 10.5, BENIGN\n2, Infinity, DDoS\n3,4\n"
                                      " Flow Duration, Flow Bytes/s, Label\n5, junk,\n")
    (tmp_path / "tue.csv").write_text("Label,Flow Bytes/s,Flow Duration\nPortScan,7.5,70\nBENIGN,8.5,80,extra,fields\n")
    (tmp_path / "wed.csv").write_text("Flow Duration,Idle Mean,Idle Mean,Label\n9,1,2,BENIGN\n")
    got = FL.read_merged(spark, str(tmp_path))
    rows = {r.flow_duration: r for r in got.rows.collect()}
    assert set(rows) == {1.0, 2.0, 5.0, 70.0, 9.0}
    assert rows[70.0].flow_bytes_s == 7.5 and rows[70.0].label == "PortScan" and rows[2.0].flow_bytes_s == 0.0
    assert rows[9.0].idle_mean == 1.0 and rows[9.0].idle_mean_2 == 2.0 and rows[9.0].flow_bytes_s == 0.0
    bad = {(r.source_file, r.reason): r.record for r in got.quarantine.collect()}
    assert set(bad) == {("mon.csv", "malformed"), ("mon.csv", "header"), ("tue.csv", "malformed")}
    assert bad["tue.csv", "malformed"] == "BENIGN,8.5,80,extra,fields"
    shapes = {r.source_file: (r.n_rows, r.n_bad) for r in got.shapes.collect()}
    assert shapes == {"mon.csv": (3, 2), "tue.csv": (1, 1), "wed.csv": (1, 0)}
    lines = sum(len((tmp_path / f).read_text().splitlines()) - 1 for f in shapes)
    assert got.rows.count() + got.quarantine.count() == lines


# --- imputer (P-7) -------------------------------------------------------------------------------

def test_imputer_fills_exact_medians(spark):
    rows = [("1.5", "x"), ("Infinity", None), ("NaN", "-Infinity"), ("4", ""), (None, "n/a"), ("100", "y")]
    df = spark.createDataFrame(rows, "a string, b string")
    imp = fit_imputer(df, ["a", "b"], without=-1.0)
    assert imp.fills == [4.0, -1.0]
    assert [r.a for r in imp.transform(df).collect()] == [1.5, 4.0, 4.0, 4.0, 4.0, 100.0]
    wide = spark.range(2001).select(*[(F.pmod(F.col("id") * (i + 3), F.lit(2001)) * 0.5).alias(f"c{i}") for i in range(12)])
    assert fit_imputer(wide, wide.columns).fills == [float(np.median([r[c] for r in wide.collect()])) for c in wide.columns]


# --- sparse categories (F-1) ---------------------------------------------------------------------

@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_sparse_encoding_equals_the_dense_one(spark, limit):
    rng = np.random.default_rng(0)
    rows = [(i, f"v{rng.integers(0, 40)}" if i % 3 else "hot", None if i % 5 == 0 else str(rng.integers(0, 9))) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, a string, b string").repartition(4)
    train = df.where("row_id < 600")
    voc = fit_vocabulary(train, ["a", "b"])
    dense = fit_one_hot(train, ["a", "b"])
    assert voc.width == dense.width
    for r in voc.encode(df.withColumn("dense", dense.expr()), limit=limit).collect():
        assert [i for i, x in enumerate(r.dense) if x] == r.onehot["indices"] and r.onehot["size"] == voc.width
        assert r.onehot["values"] == [1.0] * len(r.onehot["indices"])


def test_a_hundred_thousand_categories_without_a_collect(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    seen, collect = [0], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(len(r := collect(self))) or r)
    df = spark.range(200_000).select(F.col("id").alias("row_id"), F.concat(F.lit("k"), F.col("id") % 100_000).alias("a"))
    voc = fit_vocabulary(df, ["a"])
    out = voc.encode(df, limit=0)
    one = out.agg(F.count_distinct("onehot.indices"), F.min(F.size("onehot.indices")), F.max(F.element_at("onehot.indices", 1))).first()
    assert voc.width == 100_000 and tuple(one) == (100_000, 1, 99_999) and max(seen) < 1000
    assert fit_vocabulary(df.limit(0), ["a"]).encode(df.limit(0)).count() == 0


def test_sparse_vectors_feed_an_estimator(spark):
    from pyspark.ml.classification import LogisticRegression

    df = spark.createDataFrame([(i, "ab"[i % 2], float(i % 2)) for i in range(60)], "row_id long, a string, y double")
    enc = fit_vocabulary(df, ["a"]).encode(df).select("y", to_ml_vector(F.col("onehot")).alias("fv"))
    model = LogisticRegression(featuresCol="fv", labelCol="y").fit(enc)
    assert model.transform(enc).where("prediction = y").count() == 60


# --- saved pipelines (K-2, K-3) ------------------------------------------------------------------

def test_saved_pipeline_scores_batch_and_stream_alike(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), str(rng.integers(0, 3)), int(x > 0.2), rng.normal(size=5).tolist()) for i, x in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(rows, "row_id long, v double, c string, y int, arr array<double>").withColumn("t", F.col("v").cast("string"))
    df = df.withColumn("t", F.when(F.col("row_id") % 9 == 0, "NaN").otherwise(F.col("t")))
    from pyspark.ml.classification import DecisionTreeClassifier
    pipe = Pipeline(stages=[
        Fit(kind="impute", options={"cols": ["t"]}),
        Fit(kind="encode", options={"numeric": ["v", "t"], "categorical": ["c"], "scale_scope": "all"}, output="features"),
        Fit(kind="pca", options={"input": "arr", "k": 2, "width": 5}, output="pc"),
        Fit(kind="angle", options={"input": "pc", "width": 2}, output="angles"),
        Fit(kind="vector", options={"input": "features"}, output="fv"),
        DecisionTreeClassifier(featuresCol="fv", labelCol="y", maxDepth=3)])
    fitted = pipe.fit(df)
    path = str(tmp_path / "m")
    fitted.write().overwrite().save(path)
    Pipeline.load(_saved(pipe, tmp_path))
    back = PipelineModel.load(path)
    cols = ["row_id", "t", "features", "angles", "prediction"]
    want = {r.row_id: tuple(r) for r in fitted.transform(df).select(*cols).collect()}
    assert {r.row_id: tuple(r) for r in back.transform(df).select(*cols).collect()} == want
    df.write.parquet(str(tmp_path / "in"))
    stream = back.transform(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).select(*cols)
    q = stream.writeStream.format("memory").queryName("pipe_rows").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.row_id: tuple(r) for r in spark.table("pipe_rows").collect()} == want


def _saved(pipe, tmp_path):
    path = str(tmp_path / "unfitted")
    pipe.write().overwrite().save(path)
    return path


def test_a_loaded_pipeline_scores_in_a_new_session(spark, tmp_path):
    import subprocess
    import sys

    df = spark.createDataFrame([(i, float(i), "ab"[i % 2], int(i > 20)) for i in range(60)], "row_id long, v double, c string, y int")
    enc = fit_flow_encoder(df, ["v"], ["c"])
    fitted = fit_classifier(enc.transform(df), "dt", "features", "y")
    pipeline_of(enc, fitted).write().overwrite().save(str(tmp_path / "m"))
    df.coalesce(1).write.parquet(str(tmp_path / "rows"))
    code = (f"from flowsentry.session import get_spark\nfrom pyspark.ml import PipelineModel\n"
            f"s = get_spark('local[1]', 1)\nm = PipelineModel.load({str(tmp_path / 'm')!r})\n"
            f"m.transform(s.read.parquet({str(tmp_path / 'rows')!r})).select('row_id', 'prediction').write.parquet({str(tmp_path / 'out')!r})")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).parents[1]), timeout=180)
    got = {r.row_id: int(r.prediction) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.row_id: r.pred for r in fitted.predict(enc.transform(df)).collect()}


# --- run ledger (K-4, E-1, M-11) -----------------------------------------------------------------

def test_supervised_runs_leave_model_report_and_record(spark, tmp_path):
    out = str(tmp_path / "study")
    for kind, more in (("dt", {"max_depth": 4}), ("logreg", {})):
        for _ in range(2):          # a retried run is one run
            run_supervised(spark, SF_SMALL, kind, save_to=out, run_id=f"{kind}-1", **more)
    runs = {r.run_id: r for r in SK.read_runs(spark, f"{out}/runs").collect()}
    assert set(runs) == {"dt-1", "logreg-1"} and all(r.status == "ok" and r.n_train > r.n_test > 0 for r in runs.values())
    best = {r.model: r.best_f1 for r in SK.best_runs(SK.read_runs(spark, f"{out}/runs")).collect()}
    assert best == {"dt": runs["dt-1"].f1, "logreg": runs["logreg-1"].f1}
    report = spark.read.parquet(f"{out}/reports/dt-1")
    assert {"0", "1", "macro avg", "weighted avg"} <= {r.row for r in report.collect()}
    from flowsentry.sources.standins import lineitem_flows
    model = PipelineModel.load(f"{out}/models/dt-1/pipeline")
    assert model.transform(lineitem_flows(spark, SF_SMALL).df).where("prediction IS NULL").count() == 0


def test_two_writers_do_not_lose_records(spark, tmp_path):
    path = str(tmp_path / "runs")
    record = RunRecord("rf", "a", 10, 5, 1.0, 0.1, 0.9, 0.8, 0.7, 0.75, 0.9)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: SK.append_run(spark, path, record, f"r{i % 6}"), range(12)))
    assert sorted(r.run_id for r in SK.read_runs(spark, path).collect()) == [f"r{i}" for i in range(6)]
    shutil.rmtree(path)
