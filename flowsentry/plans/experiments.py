"""Composed runs (E-1..E-8): each step is a DataFrame plan; the driver
only orders the jobs and carries bounded fitted state between them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.quantiles import grouped_quantiles
from ..operators.stats import SEPARATION_BOTTOM, SEPARATION_TOP
from ..operators.detect import fit_centroid, normal_rows
from ..operators.features import fit_standardizer
from ..operators.sample import stratified_split
from ..sources.standins import event_flows

SEED = 42


def _round_cols(df: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def event_features(spark: SparkSession, sf_dir: str):
    """events -> standardised ``features`` = [value, k] (scaler fitted on all rows, as the reference)."""
    ft = event_flows(spark, sf_dir)
    sc = fit_standardizer(ft.df, ft.numeric)
    feats = ft.df.select("row_id", "label", "y", F.array(*sc.exprs()).alias("features"))
    return feats


def run_centroid_anomaly(spark: SparkSession, sf_dir: str, val_frac: float = 0.25,
                         eval_split: str = "all") -> DataFrame:
    """E-5: normal-only centroid -> 40-point threshold sweep on a stratified
    validation split -> strict-threshold evaluation (D-1, X-3, O-2, D-9, A-12, A-13, W-2)."""
    feats = event_features(spark, sf_dir)
    centroid = fit_centroid(normal_rows(feats), "features", 2)
    return _centroid_report(centroid.score(feats), val_frac, eval_split)


def run_centroid_flows(spark: SparkSession, sf_dir: str, val_frac: float = 0.25, eval_split: str = "all") -> DataFrame:
    """E-5 on the mixed flow records with all features, scaled and one-hot (F-7, fitted on all rows as the study does).

    Scores are rounded to nine digits, so that rows with equal features tie whatever the order of the sums.
    """
    from ..operators.features import fit_flow_encoder
    from ..sources.standins import lineitem_flows

    ft = lineitem_flows(spark, sf_dir)
    enc = fit_flow_encoder(ft.df, ft.numeric, ft.categorical)
    feats = enc.transform(ft.df, keep=("row_id", "y"))
    scored = fit_centroid(normal_rows(feats), "features", enc.width).score(feats)
    return _centroid_report(scored.withColumn("score", F.round("score", 9)), val_frac, eval_split)


def _centroid_report(scored: DataFrame, val_frac: float, eval_split: str) -> DataFrame:
    """Threshold swept on a validation split, strict cut and metrics on the rows of ``eval_split``."""
    scored = scored.select("row_id", "y", "score").persist()  # split, sweep, eval, AUC reuse it
    split = stratified_split(scored, val_frac, "row_id", "y", SEED)
    val = split.where(F.col("split") == "test").persist()  # 3-4 passes of the exact quantile search + sweep
    sweep = M.threshold_sweep(val, "score", "y")
    best = sweep.where(F.col("best") == 1).collect()[0]
    target = scored if eval_split == "all" else split.where(F.col("split") == eval_split)
    pred = M.threshold_decision(target, "score", best["threshold"])
    met = M.binary_metrics(pred)
    auc = M.roc_auc(target, "score", "y").collect()[0]["auc"]
    out = met.select(
        F.lit(best["pct"]).alias("best_pct"), F.lit(best["threshold"]).alias("threshold"),
        F.lit(best["f1"]).alias("val_f1"), "precision", "recall", "f1", "accuracy",
        F.lit(auc).cast("double").alias("auc"))
    return _round_cols(out)


# =========================================================================== E-1 supervised run

def _flow_split(spark: SparkSession, sf_dir: str, test_frac: float = 0.2):
    from ..sources.standins import lineitem_flows
    ft = lineitem_flows(spark, sf_dir)
    sp = stratified_split(ft.df, test_frac, "row_id", "y", SEED).persist()  # reused by every fit / eval job
    return ft, sp.where(F.col("split") == "train").drop("split"), sp.where(F.col("split") == "test").drop("split")


def run_supervised(spark: SparkSession, sf_dir: str, kind: str = "rf", weighted: bool = True,
                   scaled: bool = True, save_to: str | None = None, run_id: str | None = None, **params) -> DataFrame:
    """E-1: split -> encoder fitted on train (F-7) -> weights (A-3) -> fit -> score -> report.

    With ``save_to`` the run also leaves, in that folder, ``models/<run id>`` (encoder and classifier as one
    ``PipelineModel``, K-2/K-3), ``reports/<run id>`` (A-14's rows) and its record in the ``runs`` table (K-4).
    """
    import time

    from ..operators.features import Standardizer, fit_flow_encoder
    from ..operators.models import RunRecord, evaluate_classifier, fit_classifier, pipeline_of
    from ..sources.sinks import append_run

    ft, train, test = _flow_split(spark, sf_dir)
    enc = fit_flow_encoder(train, ft.numeric, ft.categorical)
    if not scaled:
        enc.scaler = Standardizer(enc.scaler.cols, [0.0] * len(enc.scaler.cols), [1.0] * len(enc.scaler.cols))
    tr = enc.transform(train)
    te = enc.transform(test)
    t0 = time.time()
    fitted = fit_classifier(tr, kind, "features", "y", weighted=weighted, **params)
    train_s = time.time() - t0
    met, auc, eval_s = evaluate_classifier(fitted, te)
    if save_to is not None:
        run_id = append_run(spark, f"{save_to}/runs", RunRecord(
            kind, "lineitem", tr.count(), te.count(), train_s, eval_s, met["accuracy"], met["precision"], met["recall"],
            met["f1"], auc, fitted.status), run_id)
        if kind in ("tree", "forest"):
            fitted.model.save(f"{save_to}/models/{run_id}/forest")
        pipeline_of(enc, fitted).write().overwrite().save(f"{save_to}/models/{run_id}/pipeline")
        M.classification_report(fitted.predict(te)).coalesce(1).write.mode("overwrite").parquet(f"{save_to}/reports/{run_id}")
    row = [(kind, "lineitem", float(train_s), float(eval_s), float(met["accuracy"]), float(met["precision"]),
            float(met["recall"]), float(met["f1"]), None if auc is None else float(auc), enc.width)]
    return spark.createDataFrame(row, "model string, dataset string, train_s double, eval_s double, "
                                      "accuracy double, precision double, recall double, f1 double, auc double, "
                                      "n_features int")


def run_kernel_svm_features(spark: SparkSession, sf_dir: str, kind: str = "rbf", C: float = 1.0,
                            n_components: int = 512) -> DataFrame:
    """M-4 / M-5: kernel SVM through an explicit kernel map and a linear SVM (class-weighted), with its status."""
    from ..operators.forest import fit_kernel_map
    from ..operators.models import evaluate_classifier, fit_classifier
    from ..operators.features import fit_flow_encoder
    from ..session import deal_evenly

    ft, train, test = _flow_split(spark, sf_dir)
    enc = fit_flow_encoder(train, ft.numeric, ft.categorical)
    tr, te = enc.transform(train), enc.transform(test)
    km = fit_kernel_map(tr, "features", kind, "scale", n_components)
    fitted = fit_classifier(tr, "linear_svc", "features", "y", weighted=True, C=C, kernel_map=km)
    fitted.features = "phi"
    met, auc, eval_s = evaluate_classifier(fitted, km.transform(deal_evenly(te), "features", "phi"))
    return spark.createDataFrame(
        [(f"svm_{kind}", float(met["accuracy"]), float(met["precision"]), float(met["recall"]), float(met["f1"]),
          None if auc is None else float(auc), fitted.status)],
        "model string, accuracy double, precision double, recall double, f1 double, auc double, status string")


# =========================================================================== E-4 / E-6 kernel runs

def _reduced_angles(spark: SparkSession, sf_dir: str, n: int, train_frac: float | None = None):
    """embeddings -> PCA(n) -> angle scaling (both fitted on the training part)."""
    from ..operators.features import fit_angle_scaler, fit_pca
    from ..sources.standins import embedding_vectors

    v = embedding_vectors(spark, sf_dir).df
    if train_frac is None:
        fit_on, parts = v, {"all": v}
    else:
        sp = stratified_split(v, 1.0 - train_frac, "row_id", "y", SEED)
        fit_on = sp.where(F.col("split") == "train")
        parts = {"train": fit_on, "test": sp.where(F.col("split") == "test")}
    pca = fit_pca(fit_on, "x", n, 64)
    red = {k: p.select("row_id", "y", pca.project("x").alias("pc")) for k, p in parts.items()}
    sc = fit_angle_scaler(red["train" if train_frac is not None else "all"], "pc", n)
    return {k: p.select("row_id", "y", sc.expr("pc").alias("angle")) for k, p in red.items()}


def run_kernel_clustering(spark: SparkSession, sf_dir: str, n_qubits: int = 4, reps: int = 1,
                          map_type: str = "zz", k: int = 2, max_iter: int = 100, landmarks: int | None = None) -> DataFrame:
    """E-4: fidelity-kernel k-means vs plain k-means on the same angles (G-6, G-7, G-8).

    With ``landmarks`` the kernel is taken through that many landmark rows (any number of angles),
    otherwise exactly, through vectors of 4^n entries.
    """
    from ..operators import kernels as G
    from ..operators.detect import fit_kmeans
    from ..session import cut_lineage

    ang = cut_lineage(_reduced_angles(spark, sf_dir, n_qubits)["all"])
    fmap = G.build_feature_map(n_qubits, reps, map_type)
    vecs = G.density_rows(ang, fmap) if landmarks is None else G.landmark_features(ang, fmap, landmarks)
    clustered, steps = G.kernel_kmeans(vecs, k, max_iter)
    clustered = clustered.select("row_id", "y", "cluster")
    q = M.binary_metrics(M.clusters_to_prediction(clustered, "cluster", "y")).collect()[0]
    km = fit_kmeans(ang, "angle", k)
    base = km.score(ang, "angle")
    c = M.binary_metrics(M.clusters_to_prediction(base, "cluster", "y")).collect()[0]
    rows = [("kernel_kmeans", steps, float(q["accuracy"]), float(q["precision"]), float(q["recall"]), float(q["f1"])),
            ("kmeans_baseline", None, float(c["accuracy"]), float(c["precision"]), float(c["recall"]), float(c["f1"]))]
    return spark.createDataFrame(rows, "method string, iterations int, accuracy double, precision double, "
                                       "recall double, f1 double")


def run_kernel_svm(spark: SparkSession, sf_dir: str, n_qubits: int = 2, reps: int = 1,
                   entanglement: str = "linear", C: float = 1.0) -> DataFrame:
    """E-6 / M-8: fidelity-kernel SVM = linear SVM on the density vectors (exact primal form), with its status."""
    from ..operators import kernels as G
    from ..operators.models import evaluate_classifier, fit_classifier

    parts = _reduced_angles(spark, sf_dir, n_qubits, train_frac=0.75)
    fmap = G.build_feature_map(n_qubits, reps, "zz", entanglement)
    tr = G.density_rows(parts["train"], fmap)
    te = G.density_rows(parts["test"], fmap)
    fitted = fit_classifier(tr, "linear_svc", "v", "y", weighted=False, C=C)
    met, auc, eval_s = evaluate_classifier(fitted, te)
    return spark.createDataFrame(
        [("kernel_svm", float(met["accuracy"]), float(met["precision"]), float(met["recall"]), float(met["f1"]), fitted.status)],
        "model string, accuracy double, precision double, recall double, f1 double, status string")


def run_angle_logit(spark: SparkSession, sf_dir: str, n_qubits: int = 2) -> DataFrame:
    """M-9 re-aimed: logistic head on cos/sin of the angle encoding; M-10 cut at 0.5."""
    from ..operators.models import angle_trig_features, evaluate_classifier, fit_classifier

    parts = _reduced_angles(spark, sf_dir, n_qubits, train_frac=0.75)
    tr = parts["train"].select("row_id", "y", angle_trig_features("angle").alias("trig"))
    te = parts["test"].select("row_id", "y", angle_trig_features("angle").alias("trig"))
    fitted = fit_classifier(tr, "logreg", "trig", "y")
    met, auc, _ = evaluate_classifier(fitted, te)
    return spark.createDataFrame(
        [("angle_logit", float(met["accuracy"]), float(met["precision"]), float(met["recall"]), float(met["f1"]),
          None if auc is None else float(auc))],
        "model string, accuracy double, precision double, recall double, f1 double, auc double")


# =========================================================================== E-2 / E-3 detector comparison

# fixed values: the study's grids
CUTS = (0.01, 0.03, 0.05, 0.1)
FOREST_CUTS = (0.01, 0.03, 0.05, 0.1, 0.15)
NEIGHBOURS = (10, 20, 35)
CLUSTERS = (2, 3, 4)
KERNEL_MAPS = tuple((kernel, gamma) for gamma in ("scale", "auto") for kernel in ("rbf", "poly"))


@dataclass
class Candidate:
    """One fitted model: how it scores rows, and the cuts that share its scores."""

    detector: str
    params: dict
    cuts: tuple
    score: Callable[[DataFrame], DataFrame] | None = None
    status: str = "ok"
    silhouette: Callable[[], float | None] | None = None


def candidates(train: DataFrame, held: DataFrame) -> list[Candidate]:
    """E-2: every model of the grids, fitted once; a fit that fails stays in the list with its reason (E-8).

    ``held`` holds the rows that the grids are compared on: all neighbour counts of LOF share one
    neighbour search of them, and the silhouettes of k-means are taken there.
    """
    from ..operators import forest as FR
    from ..operators import neighbors as NB
    from ..operators.detect import fit_kmeans

    def one_class():
        maps = {km: FR.fit_kernel_map(train, "x", *km) for km in KERNEL_MAPS}
        fits = FR.fit_one_class_grid(train, "x", CUTS, maps)
        return [({"kernel": k, "gamma": g, "nu": nu, "gap": round(fits[(k, g), nu].gap, 5)}, (nu,),
                 fits[(k, g), nu].model.score) for nu in CUTS for k, g in KERNEL_MAPS]

    def lof():
        scores = NB.lof_scores_grid(train, held.select("row_id", "x"), NEIGHBOURS)

        def score(k):
            return lambda rows: scores.where(F.col("k") == k).drop("k").join(rows.select("row_id", "y"), "row_id")
        return [({"n_neighbors": k}, CUTS, score(k)) for k in NEIGHBOURS]

    def k_means(k):
        model = fit_kmeans(train, "x", k)

        def silhouette():
            clustered = model.score(held, "x").select("row_id", "x", "cluster")
            if clustered.select("cluster").distinct().count() < 2:
                return None
            return NB.silhouette_score(NB.silhouette_exact(clustered))
        return {"n_clusters": k}, CUTS, lambda rows: model.score(rows, "x"), silhouette

    families = [
        ("IsolationForest", lambda: [({}, FOREST_CUTS, FR.fit_isolation_forest(train, "x").score)]),
        ("OneClassSVM", one_class),
        ("LocalOutlierFactor", lof),
        ("KMeans-distance", lambda: [k_means(k) for k in CLUSTERS]),
    ]
    out = []
    for name, fit in families:
        try:
            out += [Candidate(name, p, cuts, score, "ok", *rest) for p, cuts, score, *rest in fit()]
        except Exception as e:
            out.append(Candidate(name, {}, (), None, f"failed: {type(e).__name__}: {str(e)[:120]}"))
    return out


def score_all(models: list[Candidate], rows: DataFrame) -> DataFrame:
    """``fit, y, score`` of every model over ``rows``, written once; scoring failures set the status."""
    from functools import reduce

    from ..session import cut_lineage

    parts = []
    for i, m in enumerate(models):
        if m.status == "ok":
            try:
                parts.append(m.score(rows).select(F.lit(i).alias("fit"), "y", F.col("score").cast("double").alias("score")))
            except Exception as e:
                m.status = f"failed: {type(e).__name__}: {str(e)[:120]}"
    return cut_lineage(reduce(DataFrame.unionAll, parts)) if parts else None


def cut_counts(scores: DataFrame, models: list[Candidate]) -> DataFrame:
    """``fit, cut, threshold, tp, fp, p, n`` at every cut of every model.

    The threshold is A-9's: the interpolated ``1 - cut`` quantile of the model's own scores, for all models
    in one selection; flagged rows reach it (inclusive).  Two scans besides that selection's.
    """
    grid = [(i, float(c)) for i, m in enumerate(models) if m.status == "ok" for c in m.cuts]
    levels = sorted({1.0 - c for _, c in grid})
    marks = grouped_quantiles(scores, "score", levels, "fit") if grid else {}
    cuts = scores.sparkSession.createDataFrame(
        [(i, c, marks[i][levels.index(1.0 - c)]) for i, c in grid if i in marks], "fit int, cut double, threshold double")
    hit = F.col("score") >= F.col("threshold")      # one row per grid point: broadcast
    return scores.join(F.broadcast(cuts), "fit").groupBy("fit", "cut", "threshold").agg(
        F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") != 1)).alias("fp"),
        F.count_if(F.col("y") == 1).alias("p"), F.count(F.lit(1)).alias("n"))


def unsupervised_measure(scores: DataFrame, models: list[Candidate]) -> dict[int, float]:
    """The study's measure without labels, per model: silhouette of the clusters for k-means, A-17 for the others."""
    plain = [i for i, m in enumerate(models) if m.status == "ok" and m.silhouette is None]
    marks = grouped_quantiles(scores.where(F.col("fit").isin(plain)), "score", [*SEPARATION_TOP, *SEPARATION_BOTTOM], "fit")
    out = {i: sum(q[:3]) / 3.0 - sum(q[3:]) / 3.0 for i, q in marks.items()}
    for i, m in enumerate(models):
        if m.status == "ok" and m.silhouette is not None:
            value = m.silhouette()
            if value is not None:
                out[i] = value
    return out


def quality(r) -> dict:
    """Metrics of one cut from its counts."""
    tp, fp, p, n = (int(r[k]) for k in ("tp", "fp", "p", "n"))
    return {"accuracy": (n - fp - (p - tp)) / n if n else 0.0, "precision": tp / (tp + fp) if tp + fp else 0.0,
            "recall": tp / p if p else 0.0, "f1": 2 * tp / (tp + fp + p) if tp + fp + p else 0.0, "flagged": tp + fp, "rows": n}


def pick(models: list[Candidate], counts: list, measure: dict[int, float] | None = None) -> dict:
    """O-4: per detector the first grid point of the largest F1, or of the largest ``measure`` of its model.

    A measure without labels does not depend on the cut, so there the first cut of the best model is taken.
    """
    by = {(r["fit"], r["cut"]): r for r in counts}
    best: dict = {}
    for i, m in enumerate(models):
        for c in m.cuts if m.status == "ok" else ():
            r = by.get((i, float(c)))
            value = (quality(r)["f1"] if r is not None else None) if measure is None else measure.get(i)
            if value is not None and (m.detector not in best or value > best[m.detector][2]):
                best[m.detector] = (i, c, value)
    return best


def compare_detectors(spark: SparkSession, sf_dir: str, pca_components: int = 30, supervised: bool = True,
                      hold_frac: float = 0.2) -> DataFrame:
    """E-3: PCA -> 80/10/10 -> one sweep over the grids -> test metrics per detector, with its status (E-7, E-8)."""
    from ..operators import neighbors as NB
    from ..operators.detect import fit_reconstruction, presumed_normal
    from ..operators.features import fit_pca
    from ..operators.sample import three_way_split
    from ..session import cut_lineage
    from ..sources.standins import embedding_vectors

    v = embedding_vectors(spark, sf_dir).df
    sp = cut_lineage(three_way_split(v, hold_frac, "row_id", "y", SEED))
    pca = fit_pca(sp.where(F.col("split") == "train"), "x", pca_components, 64)
    red = cut_lineage(sp.select("row_id", "y", "split", pca.project("x").alias("x")) if pca else sp)
    tr, va, te = (red.where(F.col("split") == s).drop("split") for s in ("train", "val", "test"))
    models = candidates(tr, va)
    scores = score_all(models, va)
    best = {}
    if scores is not None:
        best = pick(models, cut_counts(scores, models).collect(), None if supervised else unsupervised_measure(scores, models))

    final = []
    for name in dict.fromkeys(m.detector for m in models):
        if name not in best:
            why = next((m.status for m in models if m.detector == name and m.status != "ok"), "failed: no score")
            final.append(Candidate(name, {}, (), None, why))
            continue
        i, c, _ = best[name]
        score = models[i].score
        if name == "LocalOutlierFactor":        # U-2: refits on train and validation
            n = models[i].params["n_neighbors"]
            both = tr.unionByName(va)
            score = lambda rows: NB.lof_scores(both, rows.select("row_id", "x"), n).join(
                rows.select("row_id", "y"), "row_id")
        final.append(Candidate(name, {**models[i].params, "contamination": c}, (c,), score))
    try:
        if supervised:
            normal = presumed_normal(tr)
        else:       # without labels the forest's scores say which rows to trust
            forest = next(m for m in models if m.detector == "IsolationForest" and m.status == "ok")
            normal = presumed_normal(forest.score(tr), y=None, score="score").drop("score")
        width = pca_components if pca else 64
        rec = fit_reconstruction(normal, "x", width=width)
        final.append(Candidate("Reconstruction", {"latent": min(32, width // 2), "contamination": 0.1}, (0.1,),
                               lambda rows: rec.score(rows, "x")))
    except Exception as e:
        final.append(Candidate("Reconstruction", {}, (), None, f"failed: {type(e).__name__}: {str(e)[:120]}"))
    scores = score_all(final, te)
    counts = {r["fit"]: quality(r) for r in (cut_counts(scores, final).collect() if scores is not None else [])}
    rows = []
    for i, m in enumerate(final):
        q = counts.get(i)
        auc = M.roc_auc(scores.where(F.col("fit") == i), "score", "y").first()["auc"] if q else None
        rows.append((m.detector, str(m.params), *((q[k] for k in ("accuracy", "precision", "recall", "f1"))
                                                  if q else [None] * 4), auc, q and q["flagged"], q and q["rows"], m.status))
    return spark.createDataFrame(rows, "detector string, params string, accuracy double, precision double, recall double, "
                                       "f1 double, auc double, flagged long, rows long, status string")
