"""Feature transforms (F-1..F-7, P-11, A-4, A-5).

Each transform is fitted with one aggregation whose result is bounded by
the feature width (means, stds, category lists, loadings), then applied as
literal column expressions -- a narrow projection inside whole-stage
codegen, no join and no Python in the hot path.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import affine, assemble, collect_array_sums, lit_vector, matvec
from ..functions.blocks import matrix

ANGLE_EPS = 1e-9


# --------------------------------------------------------------------------- one-hot (F-1)

@dataclass
class OneHot:
    """Categories sorted per column; unknown values encode as all zeros."""

    cols: list[str]
    categories: dict[str, list[str]]

    @property
    def width(self) -> int:
        return sum(len(v) for v in self.categories.values())

    def names(self) -> list[str]:
        return [f"{c}={v}" for c in self.cols for v in self.categories[c]]

    def expr(self):
        parts = []
        for c in self.cols:
            s = F.col(c).cast("string")
            parts += [F.when(s == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)) for v in self.categories[c]]
        return F.array(*parts) if parts else F.array().cast("array<double>")


def fit_one_hot(df: DataFrame, cols: Sequence[str]) -> OneHot:
    """Vocabulary per column (bounded by the categorical cardinality)."""
    if not cols:
        return OneHot([], {})
    row = df.agg(*[F.collect_set(F.col(c).cast("string")).alias(c) for c in cols]).collect()[0]  # one job
    return OneHot(list(cols), {c: sorted(row[c]) for c in cols})


# --------------------------------------------------------------------------- standard scaler (F-2)

@dataclass
class Standardizer:
    """Population-std scaling; a constant column scales by 1 (-> zeros)."""

    cols: list[str]
    mean: list[float]
    std: list[float]

    def scale(self) -> list[float]:
        return [1.0 / s if s and s > 0 else 1.0 for s in self.std]

    def exprs(self):
        return [((F.col(c) - F.lit(m)) * F.lit(k)).alias(c)
                for c, m, k in zip(self.cols, self.mean, self.scale())]

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in self.cols]
        return df.select(*keep, *self.exprs())

    def array_expr(self, arr):
        return affine(arr, self.mean, self.scale())


def fit_standardizer(df: DataFrame, cols: Sequence[str]) -> Standardizer:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    r = df.agg(*aggs).collect()[0]
    return Standardizer(list(cols), [r[f"m_{c}"] or 0.0 for c in cols], [r[f"s_{c}"] or 0.0 for c in cols])


def fit_array_standardizer(df: DataFrame, arr: str, width: int) -> Standardizer:
    """F-2 on an ``array<double>`` column."""
    aggs = []
    for i in range(width):
        e = F.element_at(arr, i + 1)
        aggs += [F.avg(e).alias(f"m{i}"), F.stddev_pop(e).alias(f"s{i}")]
    r = df.agg(*aggs).collect()[0]
    return Standardizer([f"{arr}[{i}]" for i in range(width)],
                        [r[f"m{i}"] or 0.0 for i in range(width)], [r[f"s{i}"] or 0.0 for i in range(width)])


# --------------------------------------------------------------------------- assembled flow features

@dataclass
class FlowEncoder:
    """F-7: fitted on one split, applied to any; F-3 decides what is scaled."""

    numeric: list[str]
    one_hot: OneHot
    scaler: Standardizer
    scale_scope: str = "numeric"  # "numeric" | "all"
    onehot_scaler: Standardizer | None = None

    @property
    def width(self) -> int:
        return len(self.numeric) + self.one_hot.width

    def features(self):
        num = F.array(*self.scaler.exprs()) if self.numeric else F.array().cast("array<double>")
        cat = self.one_hot.expr()
        if self.scale_scope == "all" and self.onehot_scaler is not None:
            cat = self.onehot_scaler.array_expr(cat)
        return assemble([num, cat])

    def transform(self, df: DataFrame, keep: Sequence[str] = ("row_id", "label", "y"), out: str = "features"):
        return df.select(*[c for c in keep if c in df.columns], self.features().alias(out))


def fit_flow_encoder(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                     scale_scope: str = "numeric") -> FlowEncoder:
    oh = fit_one_hot(df, categorical)
    sc = fit_standardizer(df, numeric)
    enc = FlowEncoder(list(numeric), oh, sc, scale_scope)
    if scale_scope == "all" and oh.width:
        tmp = df.select(oh.expr().alias("_oh"))
        enc.onehot_scaler = fit_array_standardizer(tmp, "_oh", oh.width)
    return enc


# --------------------------------------------------------------------------- PCA (F-4, F-5)

@dataclass
class PCAFit:
    mean: list[float]
    components: list[list[float]]  # k rows of length d
    explained_variance: list[float] = field(default_factory=list)

    def project(self, arr):
        """Centre, then project: (x - mean) . components^T."""
        centred = F.zip_with(F.col(arr) if isinstance(arr, str) else arr, lit_vector(self.mean), lambda a, m: a - m)
        return matvec(self.components, centred)


def _centred_gram(df: DataFrame, arr: str, mean: np.ndarray) -> np.ndarray:
    """Sum of the outer products of the centred rows: one matrix per partition, added up in Spark."""
    width = len(mean)

    def run(batches):
        gram = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0)) - mean if batch.num_rows else np.zeros((0, width))
            gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([gram.reshape(-1)], pa.list_(pa.float64()))], ["gram"])

    parts = df.select(F.col(arr).cast("array<double>")).mapInArrow(run, "gram array<double>")
    sums, _ = collect_array_sums(parts, "gram").get(None, ([0.0] * width ** 2, 0))
    return np.asarray(sums).reshape(width, width)


def fit_pca(df: DataFrame, arr: str, k: int, width: int | None = None) -> PCAFit | None:
    """Centred PCA with scikit-learn's sign rule (largest |loading| positive), variances over n - 1.

    Two scans: means and row count, then the Gram matrix of the centred rows.  Only means and that
    matrix (width^2 numbers) reach the driver.  Returns ``None`` when ``k`` is out of range (F-5 bypass).
    """
    if width is None:
        width = df.select(F.size(arr).alias("w")).first()["w"]
    if not (0 < k < width):
        return None
    first = df.agg(F.count(arr).alias("n"), *[F.avg(F.element_at(arr, i + 1)).alias(f"m{i}") for i in range(width)]).first()
    if not first["n"]:
        raise ValueError("no rows to fit a PCA on")
    mean = np.asarray([first[f"m{i}"] for i in range(width)], np.float64)
    values, vectors = np.linalg.eigh(_centred_gram(df.where(F.col(arr).isNotNull()), arr, mean))
    order = np.argsort(-values, kind="stable")[:k]
    comps = vectors[:, order].T
    largest = np.take_along_axis(comps, np.abs(comps).argmax(axis=1)[:, None], axis=1)
    comps = np.where(largest < 0, -comps, comps)
    variances = np.maximum(values[order], 0.0) / max(first["n"] - 1, 1)
    return PCAFit(mean.tolist(), comps.tolist(), variances.tolist())


# --------------------------------------------------------------------------- angle scaling (F-6)

@dataclass
class AngleScaler:
    mean: list[float]
    std: list[float]
    gmin: float
    gmax: float
    per_column: bool = False
    cmin: list[float] | None = None
    cmax: list[float] | None = None

    def expr(self, arr):
        z = F.zip_with(F.zip_with(F.col(arr) if isinstance(arr, str) else arr, lit_vector(self.mean),
                                  lambda a, m: a - m),
                       lit_vector([1.0 / (s + ANGLE_EPS) for s in self.std]), lambda a, s: a * s)
        if self.per_column:
            lo = lit_vector(self.cmin)
            span = lit_vector([1.0 / (hi - lo_ + ANGLE_EPS) for lo_, hi in zip(self.cmin, self.cmax)])
            u = F.zip_with(F.zip_with(z, lo, lambda a, m: a - m), span, lambda a, s: a * s)
        else:
            u = F.transform(z, lambda a: (a - F.lit(self.gmin)) / F.lit(self.gmax - self.gmin + ANGLE_EPS))
        return F.transform(u, lambda a: a * F.lit(math.pi))


def fit_angle_scaler(df: DataFrame, arr: str, width: int, per_column: bool = False) -> AngleScaler:
    """Standardise each component (+1e-9), min-max over ALL entries (+1e-9), times pi.

    The global min / max is the reference's arithmetic (defect D10);
    ``per_column=True`` gives the per-component variant its comment intended.
    """
    st = fit_array_standardizer(df, arr, width)
    std = st.std
    z = F.zip_with(F.zip_with(F.col(arr), lit_vector(st.mean), lambda a, m: a - m),
                   lit_vector([1.0 / (s + ANGLE_EPS) for s in std]), lambda a, s: a * s)
    aggs = [F.min(F.array_min(z)).alias("gmin"), F.max(F.array_max(z)).alias("gmax")]
    for i in range(width):
        aggs += [F.min(F.element_at(z, i + 1)).alias(f"lo{i}"), F.max(F.element_at(z, i + 1)).alias(f"hi{i}")]
    r = df.agg(*aggs).collect()[0]
    return AngleScaler(st.mean, std, r["gmin"], r["gmax"], per_column,
                       [r[f"lo{i}"] for i in range(width)], [r[f"hi{i}"] for i in range(width)])


def to_float32(arr):
    """P-12: float64 -> float32."""
    return (F.col(arr) if isinstance(arr, str) else arr).cast("array<float>")
