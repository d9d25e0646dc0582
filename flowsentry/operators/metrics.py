"""Evaluation metrics (A-11..A-14, A-16, A-19, A-21, W-1..W-3, O-2, D-9).

Counting metrics are single-pass conditional aggregates.  Curves and AUC
need running totals over the score order; instead of one global window
(one task for all rows) the scores are first collapsed to distinct values
with partial aggregation, then cut into range buckets whose offsets come
from a tiny per-bucket aggregate (a distributed prefix sum).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bce_with_logits, broadcast_if_small, col_, safe_ratio
from ..session import cut_lineage
from .stats import exact_quantiles

# Percentile grid of the threshold sweep: linspace(80, 99.5, 40).
SWEEP_PERCENTILES = [80.0 + 0.5 * i for i in range(40)]


# --------------------------------------------------------------------------- counts

def binary_counts(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    yy, pp = F.col(y), F.col(pred)
    return df.agg(
        F.count_if((yy == 1) & (pp == 1)).alias("tp"),
        F.count_if((yy == 0) & (pp == 1)).alias("fp"),
        F.count_if((yy == 1) & (pp == 0)).alias("fn"),
        F.count_if((yy == 0) & (pp == 0)).alias("tn"),
    )


def confusion(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """A-11 binary: all four cells, zero-filled, as ``(label, pred, n)``."""
    c = binary_counts(df, y, pred)
    return c.select(F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (label, pred, n)"))


def confusion_multiclass(df: DataFrame, y: str, pred: str) -> DataFrame:
    """A-11 general: ``(label, pred, n)`` for observed cells."""
    return df.groupBy(F.col(y).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def binary_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """A-12 + A-13: accuracy and attack-class precision / recall / F1 (0 on 0/0)."""
    c = binary_counts(df, y, pred)
    prec = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(
        "tp", "fp", "fn", "tn",
        safe_ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def report_from_confusion(conf: DataFrame) -> DataFrame:
    """A-14: per-class P/R/F1/support, then accuracy, macro and weighted rows.

    ``conf`` is ``(label, pred, n)``: one aggregation over the predictions,
    bounded by classes^2 rows.  It is collected once and the report is
    derived from it, so the (possibly huge) prediction table is read once.
    """
    cells = [(r["label"], r["pred"], int(r["n"])) for r in conf.collect()]
    classes = sorted({c for lab, prd, _ in cells for c in (lab, prd) if c is not None}, key=lambda v: (str(type(v)), v))
    support = {c: sum(n for lab, _, n in cells if lab == c) for c in classes}
    predicted = {c: sum(n for _, prd, n in cells if prd == c) for c in classes}
    tp = {c: sum(n for lab, prd, n in cells if lab == c and prd == c) for c in classes}

    def div(a, b):
        return a / b if b else 0.0

    rows = []
    for c in classes:
        rows.append((str(c), support[c], div(tp[c], predicted[c]), div(tp[c], support[c]),
                     div(2 * tp[c], predicted[c] + support[c])))
    total = sum(support.values())
    hits = sum(tp.values())
    k = len(rows)
    acc = div(hits, total)
    rows.append(("accuracy", total, acc, acc, acc))
    rows.append(("macro avg", total, *(div(sum(r[i] for r in rows[:k]), k) for i in (2, 3, 4))))
    rows.append(("weighted avg", total, *(div(sum(r[i] * r[1] for r in rows[:k]), total) for i in (2, 3, 4))))
    return conf.sparkSession.createDataFrame(rows, "row string, support bigint, precision double, recall double, "
                                                   "f1 double")


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return report_from_confusion(confusion_multiclass(df, y, pred))


def prediction_histogram(df: DataFrame, y: str = "y", pred: str = "pred", bins: int = 2) -> DataFrame:
    """A-19: counts of predictions per true class in ``bins`` equal bins over [0, 1]."""
    b = F.least(F.floor(F.col(pred).cast("double") * bins).cast("int"), F.lit(bins - 1))
    return df.groupBy(F.col(y).alias("label"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mean_log_loss(df: DataFrame, logit: str, y: str = "y") -> DataFrame:
    """A-21 + A-22: mean binary cross-entropy from logits."""
    return df.agg(F.avg(bce_with_logits(logit, y)).alias("log_loss"), F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- running totals

def distinct_score_counts(df: DataFrame, score: str, y: str = "y") -> DataFrame:
    """Collapse rows to ``(score, pos, neg)``; partial aggregation absorbs hot scores."""
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))


def running_totals(df: DataFrame, order_col: str, sum_cols: Sequence[str], descending: bool = False,
                   rows_per_bucket: int = 1_000_000, min_buckets: int = 64, max_buckets: int = 100_000) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` along ``order_col`` (distinct values).

    Distributed prefix sum: range buckets from a sketch (their number grows
    with the input so one bucket holds ~``rows_per_bucket`` rows), in-bucket
    window sums, plus bucket offsets computed over a (buckets)-row table.
    """
    df = cut_lineage(df)        # read by the count, the sketch, the totals and the sums
    n = df.count()
    buckets = int(min(max(min_buckets, math.ceil(n / rows_per_bucket)), max_buckets))
    qs = [i / buckets for i in range(1, buckets)]
    acc = max(10_000, 10 * buckets)
    row = df.agg(F.percentile_approx(order_col, qs, acc).alias("q")).collect()[0]
    edges = sorted({float(v) for v in (row["q"] or []) if math.isfinite(v)})
    o = F.col(order_col)
    if edges:       # JVM binary search; NULL comes first and NaN last, as in the sort order
        from pyspark.ml.feature import Bucketizer
        b = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol=order_col, outputCol="_bk", handleInvalid="keep").transform(df)
        b = b.withColumn("_bucket", F.when(o.isNull(), 0).otherwise(F.col("_bk").cast("int"))).drop("_bk")
    else:
        b = df.withColumn("_bucket", F.lit(0))
    if descending:
        b = b.withColumn("_bucket", F.lit(len(edges)) - F.col("_bucket"))
    tot = b.groupBy("_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    wb = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # <= buckets rows
    offs = tot.select("_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}")
                                   for c in sum_cols])
    ordered = o.desc() if descending else o.asc()
    w = Window.partitionBy("_bucket").orderBy(ordered).rowsBetween(Window.unboundedPreceding, 0)
    inner = b.select("*", *[F.sum(c).over(w).alias(f"_r_{c}") for c in sum_cols])
    joined = inner.join(broadcast_if_small(offs, buckets), "_bucket")
    return joined.select(*df.columns, *[(F.col(f"_r_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}")
                                        for c in sum_cols])


def roc_points(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """W-1 / W-3: one point per distinct score (descending): tp, fp, tpr, fpr, precision, recall."""
    d = distinct_score_counts(df, score, y)
    cum = running_totals(d, "score", ["pos", "neg"], descending=True)
    t = df.agg(F.count_if(F.col(y) == 1).alias("P"), F.count_if(F.col(y) != 1).alias("N")).collect()[0]
    P, N = F.lit(t["P"]), F.lit(t["N"])
    return cum.select(F.col("score").alias("threshold"),
                      F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                      safe_ratio("cum_pos", P).alias("tpr"), safe_ratio("cum_neg", N).alias("fpr"),
                      safe_ratio("cum_pos", F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                      safe_ratio("cum_pos", P).alias("recall"))


def closed_curves(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """W-1 / W-3 with the curves' starts: one more row (threshold NULL) at ROC point (0, 0) and at precision 1, recall 0."""
    points = roc_points(df, score, y).select("threshold", "fpr", "tpr", "precision", "recall")
    start = df.sparkSession.createDataFrame([(None, 0.0, 0.0, 1.0, 0.0)], points.schema)
    return points.unionByName(start)


def roc_auc(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """W-2: ROC AUC with ties = P(s+ > s-) + 0.5 P(s+ = s-) (trapezoid rule).

    NULL when only one class is present (M-7 guard).
    """
    d = distinct_score_counts(df, score, y)
    cum = running_totals(d, "score", ["neg"], descending=False)
    part = cum.agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") * 0.5)).alias("u"),
                   F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return part.select(F.when((F.col("P") > 0) & (F.col("N") > 0),
                              F.col("u") / (F.col("P").cast("double") * F.col("N"))).alias("auc"))


# --------------------------------------------------------------------------- threshold sweep

def counts_beyond(df: DataFrame, score: str, y: str, thresholds: Sequence[float], strict: bool) -> DataFrame:
    """``i, threshold, tp, fp, P`` per threshold: positives and negatives beyond it (``>``, or ``>=``), all positives.

    Every row is put between two thresholds once (binary search) and counted there; the running
    sums go over at most as many counts as there are thresholds.  NaN counts as beyond all, NULL as none.
    """
    from pyspark.ml.feature import Bucketizer

    at = [math.nextafter(t, math.inf) if strict else t for t in thresholds]     # x > t is x >= the next double
    edges = sorted({t for t in at if not math.isinf(t)})
    if edges:
        rows = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="_s", outputCol="_b", handleInvalid="keep").transform(
            df.select(F.col(score).cast("double").alias("_s"), F.col(y).alias("_y")))
    else:
        rows = df.select(F.col(score).cast("double").alias("_s"), F.col(y).alias("_y"), F.lit(0.0).alias("_b"))
    top = len(edges) + 1        # +inf and NaN have places of their own above all edges
    place = (F.when(F.col("_s").isNull(), -1).when(F.isnan("_s"), top + 1).when(F.col("_s") == math.inf, top)
             .otherwise(F.col("_b").cast("int")))
    counts = rows.groupBy(place.alias("b")).agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") != 1).alias("neg"))
    whole = counts.agg(F.collect_list(F.struct("b", "pos", "neg")).alias("c"))
    first = [0 if x == -math.inf else (top + 1 if strict and t == math.inf else top) if x == math.inf else edges.index(x) + 1
             for t, x in zip(thresholds, at)]
    ask = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold"), F.lit(b).alias("first"))
                              for i, (t, b) in enumerate(zip(thresholds, first))]))
    asked = whole.select("c", ask.alias("q")).select("c", "q.*")

    def total(name, from_bucket):
        return F.aggregate(F.filter("c", lambda x: x["b"] >= from_bucket), F.lit(0).cast("long"), lambda acc, x: acc + x[name])

    return asked.select("i", "threshold", total("pos", F.col("first")).alias("tp"), total("neg", F.col("first")).alias("fp"),
                        total("pos", F.lit(-1)).alias("P"))


def threshold_sweep(df: DataFrame, score: str = "score", y: str = "y",
                    percentiles: Sequence[float] = SWEEP_PERCENTILES) -> DataFrame:
    """O-2: F1 at every percentile threshold (strict ``>``); one scan counts for all thresholds.

    Returns ``(pct, threshold, precision, recall, f1, best)``; ``best`` marks
    the first maximal F1 in grid order (the reference keeps the first).
    """
    ths = exact_quantiles(df, score, [p / 100.0 for p in percentiles])
    stacked = counts_beyond(df, score, y, ths, strict=True).join(
        F.broadcast(df.sparkSession.createDataFrame([(i, float(p)) for i, p in enumerate(percentiles)], "i int, pct double")), "i")
    out = stacked.select(
        "i", "pct", "threshold",
        safe_ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
        safe_ratio("tp", "P").alias("recall"),
        safe_ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P")).alias("f1"))
    w = Window.orderBy(F.desc("f1"), F.asc("i"))  # 40 rows
    return out.withColumn("best", (F.row_number().over(w) == 1).cast("int")).drop("i")


def threshold_decision(df: DataFrame, score: str, threshold: float, pred: str = "pred") -> DataFrame:
    """D-9: strict ``score > threshold``."""
    return df.withColumn(pred, (F.col(score) > F.lit(float(threshold))).cast("int"))


# --------------------------------------------------------------------------- clustering quality

def cluster_majority(df: DataFrame, cluster: str = "cluster", y: str = "y") -> DataFrame:
    """A-15: cluster -> class by mean label rounded half-to-even (0.5 -> 0)."""
    return df.groupBy(cluster).agg(F.bround(F.avg(F.col(y).cast("double")), 0).cast("int").alias("mapped"),
                                   F.count(F.lit(1)).alias("n"))


def clusters_to_prediction(df: DataFrame, cluster: str = "cluster", y: str = "y", pred: str = "pred") -> DataFrame:
    """G-7 / J-3: map each row's cluster to its majority class (broadcast of k rows)."""
    m = cluster_majority(df, cluster, y).select(cluster, F.col("mapped").alias(pred))
    k = m.count()  # one row per cluster
    return df.join(broadcast_if_small(m, k), cluster, "left")


def col_list(cols):
    return [col_(c) for c in cols]


def contamination_sweep(df: DataFrame, score: str = "score", y: str = "y",
                        contaminations: Sequence[float] = (0.01, 0.03, 0.05, 0.1, 0.15)) -> DataFrame:
    """A-9 over a grid in one scan: inclusive cut at quantile(1 - c), F1 per grid point.

    ``best`` marks the first maximal F1 in grid order (O-4)."""
    ths = exact_quantiles(df, score, [1.0 - c for c in contaminations])
    st = counts_beyond(df, score, y, ths, strict=False).join(
        F.broadcast(df.sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate(contaminations)],
                                                    "i int, contamination double")), "i")
    out = st.select("i", "contamination", "threshold",
                    safe_ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P")).alias("f1"))
    w = Window.orderBy(F.desc("f1"), F.asc("i"))
    return out.withColumn("best", (F.row_number().over(w) == 1).cast("int")).drop("i")
