"""Sources, sinks and streaming on small fixture files written to a temp folder."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from flowsentry.sources import flows as FL
from flowsentry.sources import sinks as SK


def test_read_nsl_fixed_schema_and_lenient_cast(spark, tmp_path):
    row = ["0", " tcp", " http", " SF", "181", "5450"] + ["0"] * 35 + [" normal", "21"]
    bad = ["x", "udp", "dns", "SF", "junk", "10"] + ["1"] * 35 + ["neptune", "5"]
    p = tmp_path / "nsl.txt"
    p.write_text(",".join(row) + "\n" + ",".join(bad) + "\n")
    df = FL.read_nsl(spark, str(p))
    assert df.columns == FL.NSL_COLUMNS
    rows = df.orderBy("label").collect()
    assert rows[1]["protocol_type"] == "tcp" and rows[1]["label"] == "normal" and rows[1]["src_bytes"] == 181.0
    assert rows[0]["src_bytes"] is None  # bad number -> NULL, filled by P-4 downstream
    from flowsentry.functions.scalars import lenient_double
    assert df.select(lenient_double("src_bytes").alias("v")).orderBy("v").first()["v"] == 0.0
    num, cat = FL.nsl_feature_columns()
    assert len(num) == 38 and cat == ["protocol_type", "service", "flag"]


def test_read_cic_cleans_values_and_labels(spark, tmp_path):
    d = tmp_path / "cic"
    d.mkdir()
    head = b" Flow Duration, Flow Bytes/s, Label\n"
    body = (b"10, 5.0, BENIGN\n"
            b"20, Infinity, DDoS\n"
            b"30, NaN, Web Attack \x96 XSS\n"
            b" Flow Duration, Flow Bytes/s, Label\n")
    (d / "monday.csv").write_bytes(head + body)
    (d / "tuesday.csv").write_bytes(head + b"40, 1.5, BENIGN\n")
    merged, shapes = FL.merge_sources(spark, [str(d / "monday.csv"), str(d / "tuesday.csv")])
    rows = {r["flow_duration"]: r for r in merged.collect()}
    assert set(rows) == {10.0, 20.0, 30.0, 40.0}  # repeated header dropped (P-8)
    assert rows[20.0]["flow_bytes_s"] == 0.0 and rows[30.0]["flow_bytes_s"] == 0.0  # inf / NaN -> 0
    assert rows[30.0]["label"] == "Web Attack - XSS"
    sh = {r["source_file"]: r["n_rows"] for r in shapes.collect()}
    assert sh == {"monday.csv": 3, "tuesday.csv": 1}


def test_write_table_partitioned_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "v int, label string")
    out = str(tmp_path / "t")
    FL.write_table(df, out, ["label"])
    back = spark.read.parquet(out)
    assert back.where(F.col("label") == "a").count() == 2
    assert sorted(p for p in os.listdir(out) if p.startswith("label=")) == ["label=a", "label=b"]


def test_save_model_and_transforms_roundtrip(spark, tmp_path):
    from pyspark.ml.classification import DecisionTreeClassificationModel

    from flowsentry.operators.features import fit_standardizer
    from flowsentry.operators.models import fit_classifier

    df = spark.createDataFrame([(float(i), [float(i), float(i % 3)], int(i > 5)) for i in range(12)],
                               "v double, features array<double>, y int")
    sc = fit_standardizer(df, ["v"])
    fitted = fit_classifier(df, "dt", "features", "y")
    path = str(tmp_path / "m")
    SK.save_fitted(spark, path, {"scaler": sc}, fitted.model)
    tr = SK.load_transforms(spark, path)
    assert tr["scaler"]["mean"] == pytest.approx(sc.mean)
    back = DecisionTreeClassificationModel.load(os.path.join(path, "model"))
    assert back.numNodes == fitted.model.numNodes


def test_runs_table_append_and_best(spark, tmp_path):
    from flowsentry.operators.models import RunRecord
    path = str(tmp_path / "runs")
    SK.append_run(spark, path, RunRecord("rf", "a", 10, 5, 1.0, 0.1, 0.9, 0.8, 0.7, 0.75, 0.9))
    SK.append_run(spark, path, RunRecord("rf", "b", 10, 5, 1.0, 0.1, 0.9, 0.8, 0.7, 0.85, 0.9))
    best = SK.best_runs(SK.read_runs(spark, path)).collect()[0]
    assert best["n_runs"] == 2 and best["best_f1"] == 0.85 and best["dataset"] == "b"
    for f1 in (0.1, 0.95):      # a run written again replaces itself
        SK.append_run(spark, path, RunRecord("dt", "c", 10, 5, 1.0, 0.1, 0.9, 0.8, 0.7, f1, None), "run-7")
    rows = {r.run_id: r for r in SK.read_runs(spark, path).collect()}
    assert len(rows) == 3 and rows["run-7"].f1 == 0.95 and rows["run-7"].auc is None
    with pytest.raises(ValueError):
        SK.append_run(spark, path, {}, "../elsewhere")


def test_streaming_scores_equal_batch(spark, tmp_path):
    from flowsentry.streaming import scoring as ST

    sf = "/root/testdata/sf0.001"
    scorer = ST.fit_centroid_scorer(spark, sf)
    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(os.path.join(sf, "events.parquet"), src / "part-0.parquet")
    stream = scorer.apply(ST.event_stream(spark, str(src)))
    q = (stream.writeStream.format("memory").queryName("scored_events")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {r["event_id"]: (r["pred"], round(r["score"], 9)) for r in spark.sql("SELECT * FROM scored_events").collect()}
    batch = scorer.apply(spark.read.parquet(os.path.join(sf, "events.parquet")))
    exp = {r["event_id"]: (r["pred"], round(r["score"], 9)) for r in batch.collect()}
    assert got == exp
    win = ST.windowed_anomalies(batch).agg(F.sum("n").alias("n")).collect()[0]["n"]
    assert win == len(exp)
