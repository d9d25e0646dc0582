"""Descriptive aggregates (A-1..A-9, A-17).

Everything is a partial+final hash aggregate except the exact quantile,
which Spark only offers as ``percentile`` -- an aggregate that buffers every
distinct value of the group in one task.  ``exact_quantiles`` instead selects
the wanted ranks by counting (``operators.quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import BINS, grouped_quantiles


def value_counts(df: DataFrame, label: str, name: str = "n") -> DataFrame:
    """A-1 / O-1: class counts, largest first, ties by class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), F.asc(label))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """A-2: ``class_label, samples, pct`` with pct = round(100 n / N, 3)."""
    counts = df.groupBy(F.col(label).alias("class_label")).agg(F.count(F.lit(1)).alias("samples"))
    total = F.sum("samples").over(Window.partitionBy())  # one row per class: bounded
    return (counts.withColumn("pct", F.round(F.lit(100.0) * F.col("samples") / total, 3))
            .orderBy(F.desc("samples"), F.asc("class_label")))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """A-3: balanced weights n / (k * n_c), one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return counts.select(
        label, "n_c",
        (F.sum("n_c").over(w).cast("double") / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"))


def mean_std(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A-4: column mean and population std (numpy ``std``)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return df.agg(*aggs)


def global_min_max(df: DataFrame, arr: str) -> DataFrame:
    """A-5: one min / max over every entry of an array column."""
    return df.agg(F.min(F.array_min(arr)).alias("gmin"), F.max(F.array_max(arr)).alias("gmax"))


def anomaly_ratio(df: DataFrame, y: str = "y") -> DataFrame:
    """A-6."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(y).cast("double")).alias("anomaly_ratio"))


def distinct_classes(df: DataFrame, col: str) -> DataFrame:
    """A-7."""
    return df.agg(F.countDistinct(col).alias("n_distinct"))


# --------------------------------------------------------------------------- quantiles

def exact_quantiles(df: DataFrame, col: str, fracs: Sequence[float], bins: int = BINS) -> list[float | None]:
    """A-8: linear-interpolation quantiles, equal to numpy ``percentile`` / SQL ``quantile_cont``.

    NULL and NaN are ignored.  Only counts reach the driver (``operators.quantiles``).
    """
    got = grouped_quantiles(df, col, fracs, bins=bins)
    return got.get(0, [None] * len(fracs))


def quantile_table(df: DataFrame, col: str, fracs: Sequence[float]) -> DataFrame:
    """A-8 as a DataFrame ``(frac, value)``."""
    qs = exact_quantiles(df, col, fracs)
    spark = df.sparkSession
    return spark.createDataFrame([(float(f), q) for f, q in zip(fracs, qs)], "frac double, value double")


def contamination_cut(df: DataFrame, score: str, contamination: float, pred: str = "pred") -> DataFrame:
    """A-9: flag the top ``contamination`` share: ``score >= quantile(1 - c)`` (inclusive)."""
    cutoff = exact_quantiles(df, score, [1.0 - float(contamination)])[0]
    return df.withColumn(pred, (F.col(score) >= F.lit(cutoff)).cast("int"))


SEPARATION_TOP = (0.75, 0.9, 0.99)
SEPARATION_BOTTOM = (0.01, 0.1, 0.25)


def score_separation(df: DataFrame, score: str) -> float:
    """A-17: mean of the top quantiles minus mean of the bottom quantiles."""
    qs = exact_quantiles(df, score, list(SEPARATION_TOP) + list(SEPARATION_BOTTOM))
    return sum(qs[:3]) / 3.0 - sum(qs[3:]) / 3.0
