"""Registered queries: one per SURVEY section-2 operator (id + slug).

Each entry is ``(spark, sf_dir) -> DataFrame`` over the whole driver
tables.  ``ORACLE`` holds the matching plain SQL where the operator is
SQL-expressible; doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_double, sigmoid
from ..operators import metrics as M
from ..operators import sample as S
from ..operators import stats as A
from ..operators.detect import fit_centroid, normal_rows
from ..operators.features import fit_flow_encoder
from ..sources.standins import dirty_events, embedding_vectors, event_flows, lineitem_flows
from ..session import cut_lineage
from ..sources.tables import read_table
from . import oracle as O
from .experiments import _round_cols, run_centroid_anomaly, run_centroid_flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r6_arr(c):
    return F.transform(F.col(c) if isinstance(c, str) else c, lambda x: F.round(x, 6))


# =========================================================================== sources

@query("s6_parquet_scan", """
SELECT event_id, event_type, round(value, 6) AS value FROM events WHERE value >= 0""")
def s6_parquet_scan(spark, d):
    ev = read_table(spark, d, "events")
    return ev.where(F.col("value") >= 0).select("event_id", "event_type", r6("value").alias("value"))


@query("s5_merge_sources", """
WITH u AS (
  SELECT 'customer' AS source, c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer
  UNION ALL
  SELECT 'supplier' AS source, s_nationkey AS nationkey, s_acctbal AS acctbal FROM supplier)
SELECT source, count(*) AS n_rows, 3 AS n_cols, round(sum(acctbal), 6) AS sum_acctbal FROM u GROUP BY source""")
def s5_merge_sources(spark, d):
    c = read_table(spark, d, "customer").select(
        F.lit("customer").alias("source"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"))
    s = read_table(spark, d, "supplier").select(
        F.lit("supplier").alias("source"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    u = c.unionByName(s, allowMissingColumns=True)
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(u.columns)).alias("n_cols"),
                                   r6(F.sum("acctbal")).alias("sum_acctbal"))


# =========================================================================== projections

@query("p1_binarize_label", f"SELECT row_id, label, y FROM ({O.EVENT_FLOWS})")
def p1_binarize_label(spark, d):
    return event_flows(spark, d).df.select("row_id", "label", "y")


@query("p4_lenient_numeric", f"SELECT row_id, round(k, 6) AS k FROM ({O.EVENT_FLOWS})")
def p4_lenient_numeric(spark, d):
    return event_flows(spark, d).df.select("row_id", r6("k").alias("k"))


_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("p6_clean_numeric", f"""
SELECT row_id, {', '.join(f"round(COALESCE(CASE WHEN isnan({c}) OR isinf({c}) THEN NULL ELSE {c} END, 0.0), 6) AS {c}"
                          for c in _LI_NUM)}
FROM ({O.LINEITEM_FLOWS})""")
def p6_clean_numeric(spark, d):
    df = lineitem_flows(spark, d).df
    return df.select("row_id", *[r6(clean_double(c)).alias(c) for c in _LI_NUM])


@query("p9_normal_rows", f"""
SELECT row_id, round(value, 6) AS value, round(k, 6) AS k FROM ({O.EVENT_FLOWS})
WHERE label <> 'Label' AND y = 0""")
def p9_normal_rows(spark, d):
    df = event_flows(spark, d).df.where(~F.col("label").eqNullSafe("Label"))  # P-8 then P-9
    return normal_rows(df).select("row_id", r6("value").alias("value"), r6("k").alias("k"))


def _lineitem_features(spark, d):
    ft = lineitem_flows(spark, d)
    enc = fit_flow_encoder(ft.df, ft.numeric, ft.categorical)
    return ft, enc, enc.transform(ft.df)


def _lineitem_features_sql() -> str:
    num = ", ".join(f"({c} - avg({c}) OVER ()) * (1.0 / stddev_pop({c}) OVER ())" for c in _LI_NUM)
    return f"""
WITH f AS ({O.LINEITEM_FLOWS}),
ls AS (SELECT list_sort(list_distinct(list(l_linestatus))) AS cats FROM f),
sy AS (SELECT list_sort(list_distinct(list(ship_year))) AS cats FROM f),
z AS (SELECT row_id, label, y, [{num}] AS num, l_linestatus, ship_year FROM f)
SELECT row_id, label, y,
       list_transform(list_concat(num,
            list_transform(ls.cats, lambda c: CASE WHEN z.l_linestatus = c THEN 1.0 ELSE 0.0 END),
            list_transform(sy.cats, lambda c: CASE WHEN z.ship_year = c THEN 1.0 ELSE 0.0 END)),
            lambda v: round(v, 6)) AS features
FROM z, ls, sy"""


@query("p11_assemble_features", _lineitem_features_sql())
def p11_assemble_features(spark, d):
    _, _, feats = _lineitem_features(spark, d)
    return feats.select("row_id", "label", "y", r6_arr("features").alias("features"))


@query("p12_float32", "SELECT vec_id AS row_id, CAST(CAST(embedding AS DOUBLE[]) AS FLOAT[]) AS x32 FROM embeddings")
def p12_float32(spark, d):
    from ..operators.features import to_float32
    return embedding_vectors(spark, d).df.select("row_id", to_float32("x").alias("x32"))


@query("p13_head", "SELECT event_id, event_type, round(value, 6) AS value FROM events ORDER BY event_id LIMIT 5")
def p13_head(spark, d):
    ev = read_table(spark, d, "events", ["event_id", "event_type", "value"])
    return ev.orderBy("event_id").limit(5).select("event_id", "event_type", r6("value").alias("value"))


@query("p14_shape", "SELECT count(*) AS n_rows, 11 AS n_cols FROM lineitem")
def p14_shape(spark, d):
    li = read_table(spark, d, "lineitem")
    return li.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(li.columns)).alias("n_cols"))


# =========================================================================== aggregates

@query("a01_value_counts", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def a01_value_counts(spark, d):
    return A.value_counts(event_flows(spark, d).df, "label")


@query("a02_class_distribution", f"""
SELECT label AS class_label, count(*) AS samples,
       round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS pct
FROM ({O.LINEITEM_FLOWS}) GROUP BY label""")
def a02_class_distribution(spark, d):
    return A.class_distribution(lineitem_flows(spark, d).df, "label")


@query("a03_class_weights", f"""
WITH c AS (SELECT y, count(*) AS n_c FROM ({O.EVENT_FLOWS}) GROUP BY y)
SELECT y, n_c, round(CAST(sum(n_c) OVER () AS DOUBLE) / (count(*) OVER () * n_c), 6) AS weight FROM c""")
def a03_class_weights(spark, d):
    w = A.class_weights(event_flows(spark, d).df, "y")
    return w.select("y", "n_c", r6("weight").alias("weight"))


@query("a04_mean_std", "SELECT " + ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in _LI_NUM) + " FROM lineitem")
def a04_mean_std(spark, d):
    return _round_cols(A.mean_std(lineitem_flows(spark, d).df, _LI_NUM))


@query("a05_global_min_max", """
SELECT round(min(list_min(CAST(embedding AS DOUBLE[]))), 6) AS gmin,
       round(max(list_max(CAST(embedding AS DOUBLE[]))), 6) AS gmax FROM embeddings""")
def a05_global_min_max(spark, d):
    return _round_cols(A.global_min_max(embedding_vectors(spark, d).df, "x"))


@query("a06_anomaly_ratio", f"SELECT count(*) AS n_rows, round(avg(y), 6) AS anomaly_ratio FROM ({O.EVENT_FLOWS})")
def a06_anomaly_ratio(spark, d):
    return _round_cols(A.anomaly_ratio(event_flows(spark, d).df))


@query("a07_distinct_classes", "SELECT count(DISTINCT l_returnflag) AS n_distinct FROM lineitem")
def a07_distinct_classes(spark, d):
    return A.distinct_classes(lineitem_flows(spark, d).df, "label")


QUANTILE_FRACS = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


@query("a08_exact_percentiles", f"""
WITH q AS (SELECT quantile_cont(value, [{', '.join(O.dbl(f) for f in QUANTILE_FRACS)}]) AS qs FROM events)
SELECT round([{', '.join(O.dbl(f) for f in QUANTILE_FRACS)}][i], 6) AS frac, round(qs[i], 6) AS value
FROM q, range(1, {len(QUANTILE_FRACS) + 1}) t(i)""")
def a08_exact_percentiles(spark, d):
    return _round_cols(A.quantile_table(read_table(spark, d, "events", ["value"]), "value", QUANTILE_FRACS))


@query("a09_contamination_cut", """
WITH q AS (SELECT quantile_cont(value, CAST('0.9' AS DOUBLE)) AS cutoff FROM events)
SELECT event_id AS row_id, CASE WHEN value >= cutoff THEN 1 ELSE 0 END AS pred FROM events, q""")
def a09_contamination_cut(spark, d):
    ev = read_table(spark, d, "events", ["event_id", "value"]).withColumnRenamed("event_id", "row_id")
    return A.contamination_cut(ev, "value", 0.1).select("row_id", "pred")


GRID_CUTS = [0.01, 0.03, 0.05, 0.1, 0.15]


@query("a09_grouped_cuts", f"""
WITH s AS (SELECT i - 1 AS fit, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, CAST(embedding[i] AS DOUBLE) AS score
           FROM embeddings, range(1, 65) t(i)),
c AS (SELECT unnest([{', '.join(O.dbl(c) for c in GRID_CUTS)}]) AS cut),
q AS (SELECT fit, quantile_cont(score, [{', '.join(O.dbl(1.0 - c) for c in GRID_CUTS)}]) AS qs FROM s GROUP BY fit),
t AS (SELECT fit, unnest([{', '.join(O.dbl(c) for c in GRID_CUTS)}]) AS cut, unnest(qs) AS threshold FROM q)
SELECT CAST(t.fit AS INTEGER) AS fit, round(cut, 6) AS cut, round(threshold, 6) AS threshold,
       count(*) FILTER (WHERE score >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND y <> 1) AS fp,
       count(*) FILTER (WHERE y = 1) AS p, count(*) AS n
FROM s JOIN t ON s.fit = t.fit GROUP BY ALL""")
def a09_grouped_cuts(spark, d):
    """A-9 / E-2: the cuts of a whole grid over 64 given scores (the coordinates), all fits in one selection."""
    from .experiments import Candidate, cut_counts

    v = embedding_vectors(spark, d).df
    scores = v.select("y", F.posexplode("x").alias("fit", "score"))
    return _round_cols(cut_counts(scores, [Candidate(str(i), {}, tuple(GRID_CUTS)) for i in range(64)]))


@query("a17_score_separation", """
WITH q AS (SELECT quantile_cont(value, [0.75, 0.9, 0.99, 0.01, 0.1, 0.25]) AS qs FROM events)
SELECT round((qs[1] + qs[2] + qs[3]) / 3.0 - (qs[4] + qs[5] + qs[6]) / 3.0, 6) AS separation FROM q""")
def a17_score_separation(spark, d):
    ev = read_table(spark, d, "events", ["value"])
    return spark.createDataFrame([(round(A.score_separation(ev, "value"), 6),)], "separation double")


# =========================================================================== joins

@query("j2_class_weight_join", f"""
WITH f AS ({O.EVENT_FLOWS}),
c AS (SELECT y, count(*) AS n_c FROM f GROUP BY y),
w AS (SELECT y, CAST(sum(n_c) OVER () AS DOUBLE) / (count(*) OVER () * n_c) AS weight FROM c)
SELECT f.row_id, f.y, round(w.weight, 6) AS weight FROM f JOIN w USING (y)""")
def j2_class_weight_join(spark, d):
    df = event_flows(spark, d).df
    from ..functions.scalars import broadcast_if_small
    w = A.class_weights(df, "y").select("y", "weight")
    return df.join(broadcast_if_small(w, w.count()), "y").select("row_id", "y", r6("weight").alias("weight"))


# =========================================================================== set ops + sampling

@query("u1_union_splits", f"""
WITH f AS ({O.EVENT_FLOWS}),
{O.split_ctes('f', 'row_id', 'label', 0.25, 'sp')}
SELECT split, label, count(*) AS n FROM (
  SELECT * FROM sp_split WHERE split = 'train' UNION ALL SELECT * FROM sp_split WHERE split = 'test')
GROUP BY split, label""")
def u1_union_splits(spark, d):
    df = event_flows(spark, d).df
    sp = S.stratified_split(df, 0.25, "row_id", "label")
    u = sp.where(F.col("split") == "train").unionByName(sp.where(F.col("split") == "test"))
    return u.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def _fixed_sizes(n: int) -> tuple[int, int]:
    return n // 2, n // 10  # train / test shares of the table, as 100000 / 10000 of the reference's merge


@query("x1_fixed_split", f"""
WITH f AS ({O.LINEITEM_FLOWS}),
n AS (SELECT count(*) AS total_n FROM f),
rk AS (SELECT row_id, row_number() OVER (ORDER BY {O.hash_order('row_id')}) - 1 AS rnk FROM f)
SELECT row_id, CASE WHEN rnk < total_n // 10 THEN 'test' ELSE 'train' END AS split
FROM rk, n WHERE rnk < total_n // 10 + total_n // 2""")
def x1_fixed_split(spark, d):
    df = lineitem_flows(spark, d).df.select("row_id")
    n_train, n_test = _fixed_sizes(df.count())
    return S.fixed_split(df, n_train, n_test, "row_id").select("row_id", "split")


@query("x2_stratified_sample", f"""
WITH f AS ({O.EVENT_FLOWS}),
{O.sample_ctes('f', 'row_id', 'label', 0, 'sm').replace('least(0, total_n)', 'total_n // 10')}
SELECT row_id, label FROM sm_sample""")
def x2_stratified_sample(spark, d):
    df = event_flows(spark, d).df.select("row_id", "label")
    return S.stratified_sample(df, df.count() // 10, "row_id", "label")


@query("x3_stratified_split", f"""
WITH f AS ({O.LINEITEM_FLOWS}),
{O.split_ctes('f', 'row_id', 'label', 0.25, 'sp')}
SELECT row_id, label, split FROM sp_split""")
def x3_stratified_split(spark, d):
    df = lineitem_flows(spark, d).df.select("row_id", "label")
    return S.stratified_split(df, 0.25, "row_id", "label")


@query("x4_random_sample", f"""
WITH f AS ({O.EMBEDDING_VECTORS}),
{O.sample_ctes('f', 'row_id', None, 0, 'sm').replace('least(0, total_n)', 'total_n // 5')}
SELECT row_id, y FROM sm_sample""")
def x4_random_sample(spark, d):
    df = embedding_vectors(spark, d).df.select("row_id", "y")
    return S.random_sample(df, df.count() // 5, "row_id")


@query("x5_sample_bypass", "SELECT count(*) AS n FROM events")
def x5_sample_bypass(spark, d):
    df = read_table(spark, d, "events", ["event_id"])
    return S.stratified_sample(df, 10 ** 12, "event_id").agg(F.count(F.lit(1)).alias("n"))


@query("w5_stratum_ordinal", f"""
SELECT event_id AS row_id, event_type AS label,
       row_number() OVER (PARTITION BY event_type ORDER BY {O.hash_order('event_id')}) - 1 AS ordinal
FROM events""")
def w5_stratum_ordinal(spark, d):
    df = event_flows(spark, d).df.select("row_id", "label")
    return S.stratum_ordinal(df, "row_id", "label")


@query("p15_row_gather", f"""
WITH f AS ({O.EVENT_FLOWS}),
{O.sample_ctes('f', 'row_id', None, 0, 'sm').replace('least(0, total_n)', 'total_n // 4')}
SELECT e.event_id, e.event_type FROM events e WHERE e.event_id IN (SELECT row_id FROM sm_sample)""")
def p15_row_gather(spark, d):
    df = event_flows(spark, d).df.select("row_id")
    ids = S.random_sample(df, df.count() // 4, "row_id").withColumnRenamed("row_id", "event_id")
    ev = read_table(spark, d, "events", ["event_id", "event_type"])
    return S.gather(ev, ids, "event_id")


# =========================================================================== metrics on (y_true, y_pred)

_LABEL_PAIRS = "SELECT doc_id, quality AS y, toxic AS pred FROM labels"


def _label_pairs(spark, d):
    return read_table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("pred"))


@query("a11_confusion", f"""
WITH p AS ({_LABEL_PAIRS}), g AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(label, pred))
SELECT g.label, g.pred, (SELECT count(*) FROM p WHERE p.y = g.label AND p.pred = g.pred) AS n FROM g""")
def a11_confusion(spark, d):
    return M.confusion(_label_pairs(spark, d))


@query("a13_binary_metrics", f"""
WITH p AS ({_LABEL_PAIRS}),
c AS (SELECT count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
             count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn
      FROM p)
SELECT tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1
FROM c, ({O.metrics_select('p')}) m""")
def a13_binary_metrics(spark, d):
    return _round_cols(M.binary_metrics(_label_pairs(spark, d)))


@query("a14_classification_report", f"""
WITH p AS ({_LABEL_PAIRS}),
c AS (SELECT y AS label, pred, count(*) AS n FROM p GROUP BY ALL),
cls AS (SELECT label AS cls FROM c UNION SELECT pred FROM c),
per AS (SELECT cls,
          COALESCE((SELECT sum(n) FROM c WHERE label = cls), 0) AS support,
          COALESCE((SELECT sum(n) FROM c WHERE pred = cls), 0) AS predicted,
          COALESCE((SELECT sum(n) FROM c WHERE label = cls AND pred = cls), 0) AS tp FROM cls),
m AS (SELECT CAST(cls AS VARCHAR) AS row, CAST(support AS BIGINT) AS support,
        COALESCE(CAST(tp AS DOUBLE) / NULLIF(predicted, 0), 0.0) AS precision,
        COALESCE(CAST(tp AS DOUBLE) / NULLIF(support, 0), 0.0) AS recall,
        COALESCE(CAST(2 * tp AS DOUBLE) / NULLIF(predicted + support, 0), 0.0) AS f1, tp FROM per),
t AS (SELECT sum(support) AS tot, sum(tp) AS hits, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
        sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM m)
SELECT row, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m
UNION ALL SELECT 'accuracy', CAST(tot AS BIGINT), round(hits / tot, 6), round(hits / tot, 6), round(hits / tot, 6) FROM t
UNION ALL SELECT 'macro avg', CAST(tot AS BIGINT), round(mp, 6), round(mr, 6), round(mf, 6) FROM t
UNION ALL SELECT 'weighted avg', CAST(tot AS BIGINT), round(wp / tot, 6), round(wr / tot, 6), round(wf / tot, 6) FROM t""")
def a14_classification_report(spark, d):
    return _round_cols(M.classification_report(_label_pairs(spark, d)))


@query("a19_prediction_histogram", f"""
WITH p AS ({_LABEL_PAIRS})
SELECT y AS label, CAST(least(floor(pred * 2.0), 1) AS INTEGER) AS bin, count(*) AS n FROM p GROUP BY ALL""")
def a19_prediction_histogram(spark, d):
    return M.prediction_histogram(_label_pairs(spark, d))


# =========================================================================== curves / sweep on event scores

_EVENT_SCORES = f"SELECT row_id, value AS score, y FROM ({O.EVENT_FLOWS})"


def _event_scores(spark, d):
    return event_flows(spark, d).df.select("row_id", F.col("value").alias("score"), "y")


@query("w1_roc_curve", f"""
WITH s AS ({_EVENT_SCORES}),
g AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM s GROUP BY score),
t AS (SELECT sum(pos) AS P, sum(neg) AS Nn FROM g),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM g)
SELECT round(score, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(CAST(tp AS DOUBLE) / P, 6) AS tpr, round(CAST(fp AS DOUBLE) / Nn, 6) AS fpr,
       round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision, round(CAST(tp AS DOUBLE) / P, 6) AS recall
FROM c, t""")
def w1_roc_curve(spark, d):
    return _round_cols(M.roc_points(_event_scores(spark, d)))


@query("w3_closed_curves", f"""
WITH s AS ({_EVENT_SCORES}),
g AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM s GROUP BY score),
t AS (SELECT sum(pos) AS P, sum(neg) AS Nn FROM g),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM g)
SELECT round(score, 6) AS threshold, round(CAST(fp AS DOUBLE) / Nn, 6) AS fpr, round(CAST(tp AS DOUBLE) / P, 6) AS tpr,
       round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision, round(CAST(tp AS DOUBLE) / P, 6) AS recall
FROM c, t
UNION ALL SELECT CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)""")
def w3_closed_curves(spark, d):
    return _round_cols(M.closed_curves(_event_scores(spark, d)))


@query("w2_roc_auc", f"""
WITH s AS ({_EVENT_SCORES}), {O.auc_ctes('s', 'au')}
SELECT round(auc, 6) AS auc FROM au_auc""")
def w2_roc_auc(spark, d):
    return _round_cols(M.roc_auc(_event_scores(spark, d)))


@query("o2_threshold_sweep", f"""
WITH s AS ({_EVENT_SCORES}), {O.sweep_ctes('s', 'sw')}
SELECT round(pct, 6) AS pct, round(threshold, 6) AS threshold, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1, best FROM sw_sweep""")
def o2_threshold_sweep(spark, d):
    return _round_cols(M.threshold_sweep(_event_scores(spark, d)))


@query("a22_bce_logits", f"""
WITH s AS (SELECT (value - 50.0) / 10.0 AS z, y FROM ({O.EVENT_FLOWS}))
SELECT round(avg(greatest(z, 0.0) - z * y + ln(1 + exp(-abs(z)))), 6) AS log_loss, count(*) AS n FROM s""")
def a22_bce_logits(spark, d):
    df = event_flows(spark, d).df.select(((F.col("value") - 50.0) / 10.0).alias("z"), "y")
    return _round_cols(M.mean_log_loss(df, "z", "y"))


@query("m10_sigmoid_class", f"""
SELECT row_id, round(1.0 / (1.0 + exp(-((value - 50.0) / 10.0))), 6) AS prob,
       CASE WHEN 1.0 / (1.0 + exp(-((value - 50.0) / 10.0))) >= 0.5 THEN 1 ELSE 0 END AS pred
FROM ({O.EVENT_FLOWS})""")
def m10_sigmoid_class(spark, d):
    df = event_flows(spark, d).df.select("row_id", sigmoid((F.col("value") - 50.0) / 10.0).alias("p"))
    return df.select("row_id", r6("p").alias("prob"), (F.col("p") >= 0.5).cast("int").alias("pred"))


# =========================================================================== detectors

@query("e5_centroid_anomaly", O.CENTROID_ANOMALY)
def e5_centroid_anomaly(spark, d):
    return run_centroid_anomaly(spark, d)


@query("e5_centroid_flows", O.centroid_flows_sql())
def e5_centroid_flows(spark, d):
    """E-5 on all features of the mixed flow records: scaled numbers and one-hot categories."""
    return run_centroid_flows(spark, d)


@query("a10_normal_centroid", f"""
WITH v AS ({O.EMBEDDING_VECTORS}), e AS (SELECT i, x[i] AS xi FROM v, range(1, 65) t(i) WHERE y = 0)
SELECT CAST(i - 1 AS INTEGER) AS dim, round(avg(xi), 6) AS center FROM e GROUP BY i""")
def a10_normal_centroid(spark, d):
    v = embedding_vectors(spark, d).df
    c = fit_centroid(normal_rows(v), "x", 64)
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(c.center)], "dim int, center double")


@query("d1_centroid_scores", f"""
WITH v AS ({O.EMBEDDING_VECTORS}),
e AS (SELECT i, avg(x[i]) AS c FROM v, range(1, 65) t(i) WHERE y = 0 GROUP BY i),
cv AS (SELECT list(c ORDER BY i) AS c FROM e)
SELECT row_id, y, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (x[i] - cv.c[i]) * (x[i] - cv.c[i])))), 6)
       AS score FROM v, cv""")
def d1_centroid_scores(spark, d):
    v = embedding_vectors(spark, d).df
    c = fit_centroid(normal_rows(v), "x", 64)
    return c.score(v, "x").select("row_id", "y", r6("score").alias("score"))


# =========================================================================== kernels (G-*)

from ..operators import kernels as G  # noqa: E402
from ..operators.features import fit_angle_scaler  # noqa: E402


def _angles(spark, d, n: int):
    """F-6 on n sums of equal blocks of all embedding coordinates (a fixed projection)."""
    width = 64 // n
    blocks = [F.aggregate(F.slice("x", 1 + width * i, width), F.lit(0.0), lambda a, v: a + v) for i in range(n)]
    v = embedding_vectors(spark, d).df.select("row_id", "y", F.array(*blocks).alias("p"))
    sc = fit_angle_scaler(v, "p", n)
    return v.select("row_id", "y", sc.expr("p").alias("angle"))


@query("f6_angle_scaling", f"""
WITH {O.angle_ctes(4)}
SELECT row_id, [round(x0, 6), round(x1, 6), round(x2, 6), round(x3, 6)] AS angle FROM an""")
def f6_angle_scaling(spark, d):
    return _angles(spark, d, 4).select("row_id", r6_arr("angle").alias("angle"))


def _rowsum_query(map_type: str, reps: int, ent: str, n: int):
    fmap = G.build_feature_map(n, reps, map_type, ent)

    def run(spark, d):
        vecs = G.kernel_vectors(_angles(spark, d, n), fmap)
        tot = vecs.count()
        rs = G.kernel_row_sums(vecs, "v", fmap.dim ** 2)
        return rs.select("row_id", r6(F.col("k_sum") / F.lit(float(tot))).alias("k_mean"))

    sql = f"""
WITH {O.angle_ctes(n)},
{O.kernel_pairs_cte(map_type, n, ent)}
SELECT i AS row_id, round(sum(k) / count(*), 6) AS k_mean FROM kp GROUP BY i"""
    return run, sql


for _name, _args in {"g1_zz_kernel_rowsum": ("zz", 1, "full", 4), "g3_z_kernel_rowsum": ("z", 1, "full", 4),
                     "g4_pauli_kernel_rowsum": ("pauli", 1, "full", 4), "g5_rx_kernel_rowsum": ("rx", 1, "full", 4),
                     "g2_zz_linear_kernel_rowsum": ("zz", 1, "linear", 4)}.items():
    _fn, _sql = _rowsum_query(*_args)
    _fn.__name__ = _name
    query(_name, _sql)(_fn)

N_LANDMARKS = 8


def _landmark_ids_sql(prefix: str = "lm") -> str:
    return f"""{prefix} AS (SELECT row_id FROM an ORDER BY {O.hash_order('row_id')} LIMIT {N_LANDMARKS})"""


@query("j7_kernel_to_landmarks", f"""
WITH {O.angle_ctes(2)},
{_landmark_ids_sql()},
{O.kernel_pairs_cte('zz', 2, 'linear')}
SELECT i AS row_id, j AS landmark, round(k, 6) AS k FROM kp WHERE j IN (SELECT row_id FROM lm)""")
def j7_kernel_to_landmarks(spark, d):
    """J-7 / M-8: test rows x a bounded landmark set (hash-sampled support rows)."""
    fmap = G.build_feature_map(2, 1, "zz", "linear")
    vecs = G.kernel_vectors(_angles(spark, d, 2), fmap)
    lms = S.random_sample(vecs, N_LANDMARKS, "row_id").select("row_id", "v").collect()  # m rows: bounded
    out = G.kernel_to_landmarks(vecs, [(r["row_id"], r["v"]) for r in lms])
    return out.select("row_id", "landmark", r6("k").alias("k"))


def _kmeans_step_sql(k: int = 2) -> str:
    return f"""
WITH {O.angle_ctes(4)},
{O.kernel_pairs_cte('zz', 4)},
c0 AS (SELECT row_id, CAST(least(floor({O.hash_unit_sql('row_id')} * {k}), {k - 1}) AS INTEGER) AS c0 FROM an),
sz AS (SELECT c0 AS c, count(*) AS n FROM c0 GROUP BY 1),
sx AS (SELECT p.i, cb.c0 AS c, sum(p.k) AS s FROM kp p JOIN c0 cb ON p.j = cb.row_id GROUP BY ALL),
cc AS (SELECT ca.c0 AS c, sum(p.k) AS q FROM kp p JOIN c0 ca ON p.i = ca.row_id JOIN c0 cb ON p.j = cb.row_id
       WHERE ca.c0 = cb.c0 GROUP BY 1),
kxx AS (SELECT i, k AS kxx FROM kp WHERE i = j),
dist AS (SELECT sx.i, sx.c, kxx.kxx - 2.0 * sx.s / sz.n + cc.q / (CAST(sz.n AS DOUBLE) * sz.n) AS d
         FROM sx JOIN sz USING (c) JOIN cc USING (c) JOIN kxx USING (i)),
best AS (SELECT i, arg_min(c, d) AS cluster, list(round(d, 6) ORDER BY c) AS dist FROM dist GROUP BY i)"""


@query("g6_kernel_kmeans_step", _kmeans_step_sql() + """
SELECT best.i AS row_id, c0.c0, best.dist, best.cluster FROM best JOIN c0 ON c0.row_id = best.i""")
def g6_kernel_kmeans_step(spark, d):
    fmap = G.build_feature_map(4, 1, "zz", "full")
    vecs = G.kernel_vectors(_angles(spark, d, 4), fmap)
    st = G.kernel_kmeans_step(vecs, 2)
    return st.select("row_id", "c0", r6_arr("dist").alias("dist"), "cluster")


@query("a20_kernel_cluster_sums", _kmeans_step_sql() + """
SELECT c AS cluster, n AS size, round(q, 6) AS pair_sum FROM sz JOIN cc USING (c)""")
def a20_kernel_cluster_sums(spark, d):
    fmap = G.build_feature_map(4, 1, "zz", "full")
    vecs = G.kernel_vectors(_angles(spark, d, 4), fmap)
    st = G.cluster_state(vecs, G.initial_clusters(vecs, 2), 2, "v", fmap.dim ** 2)
    rows = [(c, n, round(sum(x * x for x in S_), 6)) for c, (S_, n) in enumerate(zip(st.sums, st.sizes)) if n]
    return spark.createDataFrame(rows, "cluster int, size long, pair_sum double")


@query("g7_cluster_to_anomaly", _kmeans_step_sql() + """,
lab AS (SELECT best.cluster, v.y FROM best JOIN an v ON v.row_id = best.i),
mp AS (SELECT cluster, CAST(round_even(avg(y), 0) AS INTEGER) AS mapped FROM lab GROUP BY cluster),
pr AS (SELECT lab.y, mp.mapped AS pred FROM lab JOIN mp USING (cluster)),
met AS (""" + O.metrics_select("pr") + """)
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM met""")
def g7_cluster_to_anomaly(spark, d):
    fmap = G.build_feature_map(4, 1, "zz", "full")
    vecs = G.kernel_vectors(_angles(spark, d, 4), fmap)
    st = G.kernel_kmeans_step(vecs, 2)
    pred = M.clusters_to_prediction(st, "cluster", "y")
    return _round_cols(M.binary_metrics(pred).select("accuracy", "precision", "recall", "f1"))


# =========================================================================== neighbours / LOF (J-6, W-4, D-5, D-6)

from ..operators import neighbors as NB  # noqa: E402
from ..operators.features import fit_pca  # noqa: E402
from ..operators.impute import fit_imputer  # noqa: E402
from ..operators.sparse import fit_vocabulary  # noqa: E402
from ..operators.projections import knn_approximate  # noqa: E402

LOF_K_OUTLIER = 10
LOF_K_NOVELTY = 20


@query("w4_knn_kdistance", f"""
WITH v AS ({O.EMBEDDING_VECTORS}), {O.knn_ctes('v', 'v', LOF_K_OUTLIER, True, 'k')}
SELECT q AS row_id, round(max(d), 6) AS kdist, count(*) AS n_neighbors FROM k_nn GROUP BY q""")
def w4_knn_kdistance(spark, d):
    v = embedding_vectors(spark, d).df.select("row_id", "x")
    nn = NB.knn(v, v, LOF_K_OUTLIER, exclude_self=True)
    return nn.groupBy(F.col("qid").alias("row_id")).agg(r6(F.max("d")).alias("kdist"),
                                                        F.count(F.lit(1)).alias("n_neighbors"))


@query("d6_lof_outlier", f"""
WITH v AS ({O.EMBEDDING_VECTORS}), {O.lof_ctes('v', None, LOF_K_OUTLIER)}
SELECT row_id, round(score, 6) AS score FROM lf_lof""")
def d6_lof_outlier(spark, d):
    v = embedding_vectors(spark, d).df.select("row_id", "x")
    return NB.lof_scores(v, None, LOF_K_OUTLIER, method="exact").select("row_id", r6("score").alias("score"))


@query("d5_lof_novelty", f"""
WITH v AS ({O.EMBEDDING_VECTORS}),
{O.split_ctes('v', 'row_id', 'y', 0.25, 'sp')},
tr AS (SELECT row_id, x FROM sp_split WHERE split = 'train'),
ev AS (SELECT row_id, x FROM sp_split WHERE split = 'test'),
{O.lof_ctes('tr', 'ev', LOF_K_NOVELTY)}
SELECT row_id, round(score, 6) AS score FROM lf_lof""")
def d5_lof_novelty(spark, d):
    v = embedding_vectors(spark, d).df.select("row_id", "y", "x")
    sp = S.stratified_split(v, 0.25, "row_id", "y")
    tr = sp.where(F.col("split") == "train").select("row_id", "x")
    ev = sp.where(F.col("split") == "test").select("row_id", "x")
    return NB.lof_scores(tr, ev, LOF_K_NOVELTY, method="exact").select("row_id", r6("score").alias("score"))


@query("w4_knn_all_probes", f"""
WITH v AS ({O.EMBEDDING_VECTORS}), {O.knn_ctes('v', 'v', LOF_K_OUTLIER, True, 'k')}
SELECT q AS row_id, round(max(d), 6) AS kdist, count(*) AS n_neighbors FROM k_nn GROUP BY q""")
def w4_knn_all_probes(spark, d):
    """W-4 by hashed projections with every bucket probed: exact, so the SQL holds for codes, buckets and merging."""
    v = embedding_vectors(spark, d).df.select("row_id", "x")
    nn = knn_approximate(v, v, LOF_K_OUTLIER, exclude_self=True, tables=1, bucket_rows=64, share=1.0)
    return nn.groupBy(F.col("qid").alias("row_id")).agg(r6(F.max("d")).alias("kdist"), F.count(F.lit(1)).alias("n_neighbors"))


@query("w4_knn_approximate")
def w4_knn_approximate(spark, d):
    """W-4 / J-6: k-distance over the 30 leading components by multi-probe hashing, with the distances computed per row."""
    v = embedding_vectors(spark, d).df
    z = v.select("row_id", fit_pca(v, "x", 30, 64).project("x").alias("x"))
    nn = knn_approximate(z, z, LOF_K_OUTLIER, exclude_self=True)
    return nn.groupBy(F.col("qid").alias("row_id")).agg(
        r6(F.max("d")).alias("kdist"), F.count(F.lit(1)).alias("n_neighbors"), F.first("compared").alias("compared"))


@query("d6_lof_approximate")
def d6_lof_approximate(spark, d):
    """D-6 on approximate neighbours."""
    v = embedding_vectors(spark, d).df
    z = v.select("row_id", fit_pca(v, "x", 30, 64).project("x").alias("x"))
    return NB.lof_scores(z, None, LOF_K_OUTLIER).select("row_id", r6("score").alias("score"))


# =========================================================================== dirty input, sparse categories (P-4, P-6..P-8, F-1)

_DIRTY_SQL = """
SELECT event_id AS row_id, event_type AS label,
       CASE WHEN event_id % 11 = 0 THEN 'Infinity' WHEN event_id % 13 = 0 THEN 'NaN' WHEN event_id % 17 = 0 THEN 'n/a'
            WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN '-Infinity' ELSE CAST(value AS VARCHAR) END AS value,
       CASE WHEN event_id % 7 = 0 THEN '' ELSE json_extract_string(props, '$.k') END AS k FROM events
UNION ALL SELECT event_id, 'label', 'value', 'k' FROM events WHERE event_type = 'error'"""


@query("p7_median_imputer", f"""
WITH d AS (SELECT * FROM ({_DIRTY_SQL}) WHERE label <> 'label'),
n AS (SELECT row_id, label, TRY_CAST(value AS DOUBLE) AS v, TRY_CAST(k AS DOUBLE) AS k FROM d),
f AS (SELECT row_id, label, CASE WHEN isfinite(v) THEN v END AS v, CASE WHEN isfinite(k) THEN k END AS k FROM n),
m AS (SELECT quantile_cont(v, 0.5) AS mv, quantile_cont(k, 0.5) AS mk FROM f)
SELECT row_id, label, round(coalesce(v, mv), 6) AS value, round(coalesce(k, mk), 6) AS k FROM f, m""")
def p7_median_imputer(spark, d):
    """P-4, P-6, P-7, P-8 on text with junk, blanks, NaN, infinities and header lines: rows cleaned, medians filled in."""
    df = dirty_events(spark, d).where(~F.col("label").eqNullSafe("label"))
    return fit_imputer(df, ["value", "k"]).transform(df).select("row_id", "label", r6("value").alias("value"), r6("k").alias("k"))


@query("p4_clean_dirty", f"""
WITH n AS (SELECT row_id, TRY_CAST(value AS DOUBLE) AS v FROM ({_DIRTY_SQL}) WHERE label <> 'label')
SELECT row_id, round(CASE WHEN isfinite(v) THEN v ELSE 0.0 END, 6) AS value, v IS NULL AS was_junk FROM n""")
def p4_clean_dirty(spark, d):
    """P-4, P-6 and P-8 with the constant fill, on the same dirty text."""
    df = dirty_events(spark, d).where(~F.col("label").eqNullSafe("label"))
    return df.select("row_id", r6(clean_double("value")).alias("value"), F.col("value").try_cast("double").isNull().alias("was_junk"))


@query("f1_sparse_one_hot", """
WITH v AS (SELECT 0 AS pos, p_name AS value FROM part UNION SELECT 1, p_brand FROM part UNION SELECT 2, p_type FROM part),
r AS (SELECT pos, value, row_number() OVER (ORDER BY pos, value) - 1 AS idx FROM v),
l AS (SELECT p_partkey AS row_id, idx FROM part JOIN r ON pos = 0 AND value = p_name
      UNION ALL SELECT p_partkey, idx FROM part JOIN r ON pos = 1 AND value = p_brand
      UNION ALL SELECT p_partkey, idx FROM part JOIN r ON pos = 2 AND value = p_type)
SELECT row_id, CAST((SELECT count(*) FROM r) AS INTEGER) AS size, array_to_string(list(idx ORDER BY idx), ',') AS indices
FROM l GROUP BY row_id""")
def f1_sparse_one_hot(spark, d):
    """F-1 sparse: names, brands and types of parts over one vocabulary table."""
    df = read_table(spark, d, "part", ["p_partkey", "p_name", "p_brand", "p_type"]).withColumnRenamed("p_partkey", "row_id")
    out = fit_vocabulary(df, ["p_name", "p_brand", "p_type"]).encode(df)
    return out.select("row_id", "onehot.size", F.concat_ws(",", F.col("onehot.indices").cast("array<string>")).alias("indices"))


# =========================================================================== silhouette, remaining detectors

from ..operators import forest as FR  # noqa: E402
from ..operators.detect import fit_kmeans, fit_reconstruction, presumed_normal  # noqa: E402


def _label_clusters(spark, d):
    return embedding_vectors(spark, d).df.select("row_id", "x", F.col("label").cast("int").alias("cluster"))


_SIL_SQL = """
WITH v AS (SELECT vec_id AS row_id, label AS cluster, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
pr AS (SELECT a.row_id AS q, a.cluster AS c, b.cluster AS rc, {dist} AS d FROM v a, v b WHERE a.row_id <> b.row_id),
m AS (SELECT q, c, rc, avg(d) AS md FROM pr GROUP BY ALL),
ab AS (SELECT q, c, max(md) FILTER (WHERE rc = c) AS a, min(md) FILTER (WHERE rc <> c) AS b FROM m GROUP BY q, c)
SELECT q AS row_id, c AS cluster, round(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette
FROM ab"""


@query("a16_silhouette_exact", _SIL_SQL.format(dist="list_distance(a.x, b.x)"))
def a16_silhouette_exact(spark, d):
    return NB.silhouette_exact(_label_clusters(spark, d)).select("row_id", "cluster", r6("silhouette").alias("silhouette"))


@query("a16_silhouette_squared", _SIL_SQL.format(dist="pow(list_distance(a.x, b.x), 2)"))
def a16_silhouette_squared(spark, d):
    return NB.silhouette_squared(_label_clusters(spark, d)).select("row_id", "cluster",
                                                                    r6("silhouette").alias("silhouette"))


@query("d8_presumed_normal", f"""
WITH s AS ({_EVENT_SCORES}), q AS (SELECT quantile_cont(-score, CAST('0.3' AS DOUBLE)) AS cut FROM s)
SELECT row_id FROM s, q WHERE -score >= cut""")
def d8_presumed_normal(spark, d):
    return presumed_normal(_event_scores(spark, d), y=None, score="score", contamination_frac=0.3).select("row_id")


@query("d9_threshold_decision", f"""
SELECT row_id, y, CASE WHEN score > 50.0 THEN 1 ELSE 0 END AS pred FROM ({_EVENT_SCORES})""")
def d9_threshold_decision(spark, d):
    return M.threshold_decision(_event_scores(spark, d), "score", 50.0).select("row_id", "y", "pred")


def _detector_metrics(scored: DataFrame, contamination: float) -> DataFrame:
    """A-9 cut, then accuracy / P / R / F1 and AUC of the detector (E-7)."""
    scored = cut_lineage(scored.select("y", "score"))      # read by the quantile, the metrics and the curve
    cut = A.contamination_cut(scored, "score", contamination)
    met = M.binary_metrics(cut)
    auc = M.roc_auc(scored, "score", "y").collect()[0]["auc"]
    return _round_cols(met.select("accuracy", "precision", "recall", "f1", F.lit(auc).cast("double").alias("auc")))


@query("d2_kmeans_distance")
def d2_kmeans_distance(spark, d):
    """D-2: min distance to k-means centres (fit on all rows), 10 % cut.  Randomised init: rows-only check."""
    v = embedding_vectors(spark, d).df
    km = fit_kmeans(v, "x", 3)
    return _detector_metrics(km.score(v, "x"), 0.1)


@query("d3_isolation_forest")
def d3_isolation_forest(spark, d):
    """D-3: isolation forest (100 trees x 256 rows), 10 % cut.  Randomised: rows-only check."""
    v = embedding_vectors(spark, d).df
    m = FR.fit_isolation_forest(v, "x")
    return _detector_metrics(m.score(v, "x"), 0.1)


@query("d4_one_class_svm")
def d4_one_class_svm(spark, d):
    """D-4: nu-one-class SVM on random Fourier features, fit on normal rows, cut at nu."""
    v = embedding_vectors(spark, d).df
    m = FR.fit_one_class_svm(normal_rows(v), "x", nu=0.05, kernel="rbf", gamma="scale")
    return _detector_metrics(m.score(v, "x"), 0.05)


@query("d7_reconstruction_error")
def d7_reconstruction_error(spark, d):
    """D-7: PCA reconstruction error (latent min(32, d/2)), fit on normal rows, 10 % cut."""
    v = embedding_vectors(spark, d).df
    m = fit_reconstruction(normal_rows(v), "x", width=64)
    return _detector_metrics(m.score(v, "x"), 0.1)


# =========================================================================== grid argmax / comparison (O-4, M-11)

CONTAMINATION_GRID = [0.01, 0.03, 0.05, 0.1, 0.15]


def _grid_sql() -> str:
    parts = []
    for col in ("value", "k"):
        fr = ", ".join(O.dbl(1.0 - c) for c in CONTAMINATION_GRID)
        cs = ", ".join(O.dbl(c) for c in CONTAMINATION_GRID)
        parts.append(f"""
SELECT '{col}' AS model, i, [{cs}][i] AS contamination, (q.qs)[i] AS threshold,
       count(*) FILTER (WHERE f.{col} >= (q.qs)[i] AND f.y = 1) AS tp,
       count(*) FILTER (WHERE f.{col} >= (q.qs)[i] AND f.y <> 1) AS fp,
       count(*) FILTER (WHERE f.y = 1) AS P
FROM f, (SELECT quantile_cont({col}, [{fr}]) AS qs FROM f) q, range(1, {len(CONTAMINATION_GRID) + 1}) t(i)
GROUP BY ALL""")
    return f"""
WITH f AS ({O.EVENT_FLOWS}),
g AS ({' UNION ALL '.join(parts)}),
m AS (SELECT model, i, contamination, threshold,
             COALESCE(CAST(2 * tp AS DOUBLE) / NULLIF(tp + fp + P, 0), 0.0) AS f1 FROM g)
SELECT model, round(contamination, 6) AS contamination, round(threshold, 6) AS threshold, round(f1, 6) AS f1,
       CASE WHEN row_number() OVER (PARTITION BY model ORDER BY f1 DESC, i) = 1 THEN 1 ELSE 0 END AS best
FROM m"""


@query("o4_grid_argmax", _grid_sql())
def o4_grid_argmax(spark, d):
    """O-4 + M-11: per-model F1 over a contamination grid; first best in grid order."""
    df = event_flows(spark, d).df
    out = None
    for col in ("value", "k"):
        sw = M.contamination_sweep(df, col, "y", CONTAMINATION_GRID).select(F.lit(col).alias("model"), "*")
        out = sw if out is None else out.unionByName(sw)
    return _round_cols(out)


@query("m7_guarded_auc", """
WITH s AS (SELECT quality AS y, CAST(toxic AS DOUBLE) AS score FROM labels),
g AS (SELECT score, count(*) AS c, count(*) FILTER (WHERE y = 1) AS p FROM s GROUP BY score),
c AS (SELECT score, c, p, sum(c) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) - c AS below FROM g),
a AS (SELECT CASE WHEN sum(p) > 0 AND sum(c) - sum(p) > 0 THEN
        (sum(p * (below + (c + 1) / 2.0)) - sum(p) * (sum(p) + 1) / 2.0) / (CAST(sum(p) AS DOUBLE) * (sum(c) - sum(p)))
      END AS auc FROM c)
SELECT 'all' AS part, round(auc, 6) AS auc FROM a
UNION ALL SELECT 'positives_only', NULL FROM (SELECT 1)""")
def m7_guarded_auc(spark, d):
    """M-7: AUC only when both classes are present (else NULL)."""
    s = read_table(spark, d, "labels").select(F.col("quality").alias("y"), F.col("toxic").cast("double").alias("score"))
    a = M.roc_auc(s, "score", "y").select(F.lit("all").alias("part"), r6("auc").alias("auc"))
    b = M.roc_auc(s.where(F.col("y") == 1), "score", "y").select(F.lit("positives_only").alias("part"),
                                                                  r6("auc").alias("auc"))
    return a.unionByName(b)


# =========================================================================== model runs (rows-only: randomised / iterative fits)

from . import experiments as E  # noqa: E402


@query("m1_decision_tree")
def m1_decision_tree(spark, d):
    """M-1 via E-1: unweighted tree (D1), no depth limit."""
    return E.run_supervised(spark, d, "tree", weighted=False).drop("train_s", "eval_s")


@query("m2_random_forest")
def m2_random_forest(spark, d):
    """M-2 via E-1: 200 trees on bootstraps, sqrt of the features a node, balanced class weights, no depth limit."""
    return E.run_supervised(spark, d, "forest", weighted=True).drop("train_s", "eval_s")


@query("m3_linear_svc")
def m3_linear_svc(spark, d):
    """M-3 via E-1: linear SVM, C = 1, class-weighted, scaled."""
    return E.run_supervised(spark, d, "linear_svc", weighted=True).drop("train_s", "eval_s")


@query("m4_rbf_svm")
def m4_rbf_svm(spark, d):
    """M-4: rbf SVM via random Fourier features (D = 512) + LinearSVC."""
    return E.run_kernel_svm_features(spark, d, "rbf")


@query("m5_poly_svm")
def m5_poly_svm(spark, d):
    """M-5: poly SVM via a Nystrom map (512 hash-sampled landmarks) + LinearSVC."""
    return E.run_kernel_svm_features(spark, d, "poly")


@query("m5_sigmoid_svm")
def m5_sigmoid_svm(spark, d):
    """M-5 sigmoid kernel: Nystrom features of its positive part, 512 landmarks."""
    return _round_cols(E.run_kernel_svm_features(spark, d, "sigmoid"))


@query("m8_fidelity_kernel_svm")
def m8_fidelity_kernel_svm(spark, d):
    """M-8 / E-6: one-layer ZZ (linear) fidelity-kernel SVM as LinearSVC on density vectors."""
    return E.run_kernel_svm(spark, d)


@query("m9_angle_logit")
def m9_angle_logit(spark, d):
    """M-9 re-aimed: logistic head on the angle encoding."""
    return E.run_angle_logit(spark, d)


@query("e4_kernel_clustering")
def e4_kernel_clustering(spark, d):
    """E-4: kernel k-means (ZZ, 4 components) vs k-means baseline (G-6..G-8)."""
    return E.run_kernel_clustering(spark, d)


@query("e4_landmark_clustering")
def e4_landmark_clustering(spark, d):
    """E-4 at eight angles through 256 landmark rows (65,536 entries a row otherwise)."""
    from .experiments import run_kernel_clustering

    return _round_cols(run_kernel_clustering(spark, d, n_qubits=8, landmarks=256))


@query("e3_compare_detectors")
def e3_compare_detectors(spark, d):
    """E-3: PCA 30 -> 80/10/10 -> grid search in one sweep -> test metrics and status per detector."""
    return E.compare_detectors(spark, d)


# =========================================================================== more feature / set operators

@query("u2_stack_train_val", f"""
WITH f AS ({O.EVENT_FLOWS}),
{O.split_ctes('f', 'row_id', 'y', 0.2, 'a')},
h AS (SELECT * EXCLUDE (split) FROM a_split WHERE split = 'test'),
{O.split_ctes('h', 'row_id', 'y', 0.5, 'b')},
parts AS (SELECT row_id, y, 'train' AS part FROM a_split WHERE split = 'train'
          UNION ALL SELECT row_id, y, CASE WHEN split = 'train' THEN 'val' ELSE 'test' END FROM b_split)
SELECT part, y, count(*) AS n FROM (
  SELECT row_id, y, 'train_val' AS part FROM parts WHERE part IN ('train', 'val')
  UNION ALL SELECT row_id, y, part FROM parts WHERE part = 'test')
GROUP BY part, y""")
def u2_stack_train_val(spark, d):
    """X-3 twice (80/10/10) then U-2: train and validation stacked (as the LOF refit uses)."""
    df = event_flows(spark, d).df.select("row_id", "y")
    sp = S.three_way_split(df, 0.2, "row_id", "y")
    tv = sp.where(F.col("split") == "train").unionByName(sp.where(F.col("split") == "val")) \
        .withColumn("part", F.lit("train_val"))
    te = sp.where(F.col("split") == "test").withColumn("part", F.lit("test"))
    return tv.unionByName(te).groupBy("part", "y").agg(F.count(F.lit(1)).alias("n"))


def _scale_all_sql() -> str:
    num = ", ".join(f"({c} - avg({c}) OVER ()) * (1.0 / stddev_pop({c}) OVER ())" for c in _LI_NUM)
    return f"""
WITH f AS ({O.LINEITEM_FLOWS}),
ls AS (SELECT list_sort(list_distinct(list(l_linestatus))) AS cats FROM f),
sy AS (SELECT list_sort(list_distinct(list(ship_year))) AS cats FROM f),
oh AS (SELECT row_id, [{num}] AS num,
              list_concat(list_transform(ls.cats, lambda c: CASE WHEN f.l_linestatus = c THEN 1.0 ELSE 0.0 END),
                          list_transform(sy.cats, lambda c: CASE WHEN f.ship_year = c THEN 1.0 ELSE 0.0 END)) AS cat
       FROM f, ls, sy),
e AS (SELECT i, cat[i] AS v FROM oh, range(1, (SELECT len(cat) FROM oh LIMIT 1) + 1) t(i)),
st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY i),
sl AS (SELECT list(m ORDER BY i) AS m, list(CASE WHEN s > 0 THEN 1.0 / s ELSE 1.0 END ORDER BY i) AS k FROM st)
SELECT oh.row_id,
       list_transform(list_concat(oh.num, list_transform(range(1, len(oh.cat) + 1),
                                                         lambda i: (oh.cat[i] - sl.m[i]) * sl.k[i])),
                      lambda v: round(v, 6)) AS features
FROM oh, sl"""


@query("f3_scale_all_columns", _scale_all_sql())
def f3_scale_all_columns(spark, d):
    """F-3: scale scope 'all' -- numerics and one-hot columns standardised together (F-1, F-2, P-11)."""
    ft = lineitem_flows(spark, d)
    enc = fit_flow_encoder(ft.df, ft.numeric, ft.categorical, scale_scope="all")
    return enc.transform(ft.df, keep=("row_id",)).select("row_id", r6_arr("features").alias("features"))


@query("f4_pca_projection")
def f4_pca_projection(spark, d):
    """F-4 / F-5 / F-7: centred PCA (sign-fixed) fitted on a training split, applied to all rows.
    Eigenvectors are not SQL-expressible: rows-only check; the unit tests compare with numpy."""
    from ..operators.features import fit_pca
    v = embedding_vectors(spark, d).df
    sp = S.stratified_split(v, 0.25, "row_id", "y")
    pca = fit_pca(sp.where(F.col("split") == "train"), "x", 4, 64)
    return sp.select("row_id", "split", r6_arr(pca.project("x")).alias("pc"))


@query("p3_project_strict_cast", f"""
SELECT row_id, y, CAST(value AS DOUBLE) AS value FROM ({O.EVENT_FLOWS})""")
def p3_project_strict_cast(spark, d):
    """P-2 / P-3 / P-5: drop the label, keep the binary target and a strict numeric cast
    (under ANSI a bad value fails the job, as ``astype(float)`` does)."""
    from ..functions.scalars import strict_double
    df = event_flows(spark, d).df.drop("label")
    return df.select("row_id", "y", strict_double("value").alias("value"))


@query("a15_cluster_majority", _kmeans_step_sql() + """,
lab AS (SELECT best.cluster, v.y FROM best JOIN an v ON v.row_id = best.i)
SELECT cluster, CAST(round_even(avg(y), 0) AS INTEGER) AS mapped, count(*) AS n FROM lab GROUP BY cluster""")
def a15_cluster_majority(spark, d):
    """A-15: cluster -> class by the half-to-even rounded mean label (0.5 -> 0), on the G-6 step clusters."""
    fmap = G.build_feature_map(4, 1, "zz", "full")
    st = G.kernel_kmeans_step(G.kernel_vectors(_angles(spark, d, 4), fmap), 2)
    return M.cluster_majority(st, "cluster", "y")


@query("d2_centre_distance_scoring", f"""
WITH v AS ({O.EMBEDDING_VECTORS}),
e AS (SELECT CAST(label AS INTEGER) AS c, i, avg(x[i]) AS m FROM v, range(1, 65) t(i) GROUP BY ALL),
cs AS (SELECT c, list(m ORDER BY i) AS centre FROM e GROUP BY c),
dd AS (SELECT v.row_id, v.y, cs.c, list_distance(v.x, cs.centre) AS d FROM v, cs),
best AS (SELECT row_id, y, min(d) AS score, arg_min(c, d) AS cluster FROM dd GROUP BY row_id, y),
q AS (SELECT quantile_cont(score, CAST('0.9' AS DOUBLE)) AS cut FROM best)
SELECT row_id, y, round(score, 6) AS score, cluster, CASE WHEN score >= cut THEN 1 ELSE 0 END AS pred
FROM best, q""")
def d2_centre_distance_scoring(spark, d):
    """D-2 scoring given centres (J-4 + O-3 + A-9): distance to the nearest of the per-label
    mean vectors, nearest index, 10 % contamination cut.  The k-means fit itself is rows-only."""
    from ..functions.arrays import collect_array_sums
    from ..operators.detect import KMeansDistance
    v = embedding_vectors(spark, d).df.withColumn("c", F.col("label").cast("int"))
    sums = collect_array_sums(v, "x", "c")  # one row per label: bounded
    k = max(sums) + 1
    centres = [[s / sums[c][1] for s in sums[c][0]] for c in range(k)]
    scored = KMeansDistance(centres).score(v, "x")
    cut = A.contamination_cut(scored, "score", 0.1)
    return cut.select("row_id", "y", r6("score").alias("score"), "cluster", "pred")
