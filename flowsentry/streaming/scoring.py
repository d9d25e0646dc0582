"""Streaming scoring with a batch-fitted detector.

The reference is batch only; a fitted detector is a row-wise expression, so
the same scoring runs unchanged on a stream.  This module scores arriving
event files with the E-5 centroid detector and keeps windowed anomaly
counts with a watermark (late rows within the watermark still count).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import l2_dist, lit_vector
from ..functions.scalars import binarize, lenient_double
from ..sources.standins import EVENT_NORMAL_TYPES


@dataclass
class CentroidScorer:
    """Fitted state of E-5: scaler (mean, std), centroid and threshold -- all literals."""

    mean: list[float]
    std: list[float]
    center: list[float]
    threshold: float

    def apply(self, events: DataFrame) -> DataFrame:
        value = F.col("value").cast("double")
        k = lenient_double(F.get_json_object("props", "$.k"))
        z = F.array(*[(c - F.lit(m)) * F.lit(1.0 / s if s else 1.0)
                      for c, m, s in zip((value, k), self.mean, self.std)])
        score = l2_dist(z, lit_vector(self.center))
        return events.select("event_id", "ts", "event_type", binarize("event_type", EVENT_NORMAL_TYPES).alias("y"),
                             score.alias("score"), (score > F.lit(self.threshold)).cast("int").alias("pred"))


def fit_centroid_scorer(spark: SparkSession, sf_dir: str) -> CentroidScorer:
    from ..operators import metrics as M
    from ..operators.detect import fit_centroid, normal_rows
    from ..operators.features import fit_standardizer
    from ..operators.sample import stratified_split
    from ..sources.standins import event_flows

    ft = event_flows(spark, sf_dir)
    sc = fit_standardizer(ft.df, ft.numeric)
    feats = ft.df.select("row_id", "y", F.array(*sc.exprs()).alias("features"))
    cen = fit_centroid(normal_rows(feats), "features", 2)
    scored = cen.score(feats)
    val = stratified_split(scored, 0.25, "row_id", "y").where(F.col("split") == "test")
    best = M.threshold_sweep(val, "score", "y").where(F.col("best") == 1).collect()[0]
    return CentroidScorer(sc.mean, sc.std, cen.center, float(best["threshold"]))


def event_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Parquet files landing in ``source_dir`` as a stream (schema of the events table)."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(source_dir))


def windowed_anomalies(scored: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Per-window counts of rows, flagged rows and true attacks (append mode after the watermark)."""
    return (scored.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("pred").alias("flagged"), F.sum("y").alias("attacks"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "n", "flagged", "attacks"))


def start_scoring(scored: DataFrame, checkpoint_dir: str, query_name: str = "anomaly_windows",
                  window: str = "1 hour", watermark: str = "2 hours"):
    """Start the windowed count query into a memory sink (tests / notebooks)."""
    agg = windowed_anomalies(scored, window, watermark)
    return (agg.writeStream.outputMode("append").format("memory").queryName(query_name)
            .option("checkpointLocation", checkpoint_dir).start())
