"""Fidelity kernels of angle-encoded feature maps and kernel k-means (G-1..G-8, J-5, J-7, A-20).

The feature-map circuits of the reference are diagonal phase layers
between Hadamard layers (or single-qubit RX rotations), so their states
have closed-form amplitudes: per basis state z of n bits the ZZ map gives
the phase

    phi(z) = sum_i 2 x_i z_i + sum_(i,j) in pairs 2 (pi - x_i)(pi - x_j) (z_i xor z_j)

(published ZZ feature map, Havlicek et al. 2019).  No circuit is
simulated: amplitudes are column arithmetic.

The state fidelity is linear in the density matrix, K(x, y) = |<a_x|a_y>|^2
= tr(rho_x rho_y) = <v_x, v_y>, with v the 4^n real entries of rho (off
diagonals scaled by sqrt 2).  Hence every kernel quantity the reference
gets from an n x n matrix is a vector aggregate:

* sum over y in C of K(x, y) = <v_x, S_C>,   S_C = sum over C of v
* sum over y, z in C of K(y, z) = |S_C|^2

so kernel k-means runs as Lloyd iterations over v: one grouped sum per
step, k x 4^n numbers to the driver, no pair table and no n^2 memory.

Expressions are generated as SQL text so the same closed form can be
checked against a brute-force pair computation in any SQL engine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import argmin, collect_array_sums, dot, lit_vector, sq_norm
from ..functions.blocks import matrix
from ..functions.scalars import hash_key, hash_unit
from ..session import cut_lineage

MAP_TYPES = ("zz", "pauli", "z", "rx")


def entanglement_pairs(n: int, entanglement: str = "full") -> list[tuple[int, int]]:
    if entanglement == "full":
        return [(i, j) for i in range(n) for j in range(i + 1, n)]
    if entanglement == "linear":
        return [(i, i + 1) for i in range(n - 1)]
    raise ValueError(f"unknown entanglement {entanglement!r}")


def _bit(z: int, i: int) -> int:
    return (z >> i) & 1


def phase_sql(n: int, z: int, pairs: Sequence[tuple[int, int]], xs: Sequence[str]) -> str:
    terms = [f"2.0 * {xs[i]}" for i in range(n) if _bit(z, i)]
    terms += [f"2.0 * (pi() - {xs[i]}) * (pi() - {xs[j]})" for i, j in pairs if _bit(z, i) ^ _bit(z, j)]
    return " + ".join(terms) if terms else "0.0"


@dataclass
class FeatureMap:
    """A feature map's amplitude program: list of SELECT stages (name -> SQL expr)."""

    n: int
    reps: int
    map_type: str
    entanglement: str

    @property
    def dim(self) -> int:
        return 2 ** self.n

    def stages(self, xs: Sequence[str]) -> list[dict[str, str]]:
        """Stages computing ``re{z}`` / ``im{z}`` from angle columns ``xs``."""
        n, dim = self.n, self.dim
        if self.map_type == "rx":
            out = {}
            for z in range(dim):
                mag = " * ".join(f"sin({xs[i]} / 2.0)" if _bit(z, i) else f"cos({xs[i]} / 2.0)" for i in range(n))
                k = bin(z).count("1") % 4
                re_, im_ = {0: (mag, "0.0"), 1: ("0.0", f"-({mag})"), 2: (f"-({mag})", "0.0"), 3: ("0.0", mag)}[k]
                out[f"re{z}"], out[f"im{z}"] = re_, im_
            return [out]
        pairs = [] if self.map_type == "z" else entanglement_pairs(n, self.entanglement)
        norm = repr(2.0 ** (-n / 2.0))
        st = [{f"ph{z}": phase_sql(n, z, pairs, xs) for z in range(dim)}]
        first = {}
        for z in range(dim):
            first[f"re{z}"] = f"{norm} * cos(ph{z})"
            first[f"im{z}"] = f"{norm} * sin(ph{z})"
        st.append(first)
        return st


    def states(self, x: np.ndarray) -> np.ndarray:
        """Amplitudes of a block of angle rows as one complex matrix (rows x 2^n), the same closed form."""
        bits = (np.arange(self.dim)[:, None] >> np.arange(self.n)) & 1
        if self.map_type == "rx":
            out = np.ones((len(x), self.dim), complex)
            for i in range(self.n):
                out *= np.where(bits[:, i], -1j * np.sin(x[:, i:i + 1] / 2), np.cos(x[:, i:i + 1] / 2))
            return out
        phase = 2.0 * x @ bits.T
        for i, j in [] if self.map_type == "z" else entanglement_pairs(self.n, self.entanglement):
            phase += np.outer(2.0 * (np.pi - x[:, i]) * (np.pi - x[:, j]), bits[:, i] ^ bits[:, j])
        return np.exp(1j * phase) * 2.0 ** (-self.n / 2.0)


def build_feature_map(n: int, reps: int = 1, map_type: str = "zz", entanglement: str = "full") -> FeatureMap:
    """G-1..G-5.  ``pauli`` with Z and ZZ terms is the ZZ map (full pairs)."""
    if map_type not in MAP_TYPES:
        raise ValueError(f"feature map {map_type!r}; known maps: {', '.join(MAP_TYPES)}")
    if reps != 1:
        raise ValueError("only one-layer maps have the closed form used here")
    if map_type == "pauli":
        entanglement = "full"
    return FeatureMap(n, reps, map_type, entanglement)


def amplitudes(df: DataFrame, fmap: FeatureMap, angle: str = "angle", keep: Sequence[str] = ("row_id", "y")) -> DataFrame:
    """Adds ``re``/``im`` arrays (length 2^n) computed from the ``angle`` array.

    Phases are plain column expressions of the closed one-layer form.
    """
    keep = [c for c in keep if c in df.columns]
    xs = [f"_x{i}" for i in range(fmap.n)]
    cur = df.select(*keep, *[F.element_at(angle, i + 1).alias(x) for i, x in enumerate(xs)])
    dim = fmap.dim
    if fmap.map_type == "rx":
        (stage,) = fmap.stages(xs)
        return cur.select(*keep, F.array(*[F.expr(stage[f"re{z}"]) for z in range(dim)]).alias("re"),
                          F.array(*[F.expr(stage[f"im{z}"]) for z in range(dim)]).alias("im"))
    phases = fmap.stages(xs)[0]
    cur = cur.select(*keep, F.array(*[F.expr(phases[f"ph{z}"]) for z in range(dim)]).alias("ph"))
    norm = F.lit(2.0 ** (-fmap.n / 2.0))
    cur = cur.select(*keep, "ph", F.transform("ph", lambda p: norm * F.cos(p)).alias("re"),
                     F.transform("ph", lambda p: norm * F.sin(p)).alias("im"))
    return cur.select(*keep, "re", "im")


def density_vector(re: str = "re", im: str = "im", dim: int | None = None):
    """v(x) with <v_x, v_y> = |<a_x|a_y>|^2 (length dim^2): diagonal, then per i<j (re, im) * sqrt 2."""
    r, m = F.col(re), F.col(im)
    s2 = F.lit(math.sqrt(2.0))
    diag = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: r[i] * r[i] + m[i] * m[i])
    off = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(dim - 2)), lambda i: F.flatten(F.transform(
        F.sequence(i + 1, F.lit(dim - 1)),
        lambda j: F.array(s2 * (r[i] * r[j] + m[i] * m[j]), s2 * (m[i] * r[j] - r[i] * m[j])))))) \
        if dim > 1 else F.array().cast("array<double>")
    return F.concat(diag, off)


def kernel_vectors(df: DataFrame, fmap: FeatureMap, angle: str = "angle",
                   keep: Sequence[str] = ("row_id", "y")) -> DataFrame:
    """Per-row kernel feature ``v`` (array<double> of 4^n)."""
    amp = amplitudes(df, fmap, angle, keep)
    return amp.select(*[c for c in keep if c in amp.columns], density_vector("re", "im", fmap.dim).alias("v"))


def kernel_row_sums(vecs: DataFrame, v: str = "v", width: int | None = None, out: str = "k_sum") -> DataFrame:
    """sum_y K(x, y) over all rows y, for every x (A-20 with C = everything)."""
    S, _ = collect_array_sums(vecs, v)[None]
    return vecs.withColumn(out, dot(v, lit_vector(S)))


def kernel_to_landmarks(vecs: DataFrame, landmarks: Sequence[tuple], v: str = "v", out: str = "k") -> DataFrame:
    """J-5 / J-7 against a bounded landmark list ``[(id, vector), ...]``: ``(row_id, landmark, k)``."""
    cols = [F.struct(F.lit(lid).alias("landmark"), dot(v, lit_vector(vec)).alias(out)) for lid, vec in landmarks]
    return vecs.select("row_id", F.explode(F.array(*cols)).alias("_l")).select("row_id", "_l.landmark", f"_l.{out}")


# --------------------------------------------------------------------------- kernel k-means (G-6)

def initial_clusters(df: DataFrame, k: int, key: str = "row_id", seed: int = 42):
    """Seeded random labels in [0, k): floor(u * k) with u from md5(key:seed)."""
    return F.least(F.floor(hash_unit(hash_key(key, seed)) * F.lit(k)), F.lit(k - 1)).cast("int")


@dataclass
class ClusterState:
    sums: list[list[float] | None]
    sizes: list[int]

    def distances(self, v: str = "v"):
        """d(x, C) = K(x,x) - 2 <v_x, S_C>/|C| + |S_C|^2/|C|^2; empty cluster -> +inf."""
        ds = []
        for S, n in zip(self.sums, self.sizes):
            if not n:
                ds.append(F.lit(float("inf")))
                continue
            q = sum(s * s for s in S) / (n * n)
            ds.append(sq_norm(v) - F.lit(2.0 / n) * dot(v, lit_vector(S)) + F.lit(q))
        return F.array(*ds)


def cluster_state(df: DataFrame, label, k: int, v: str, width: int | None = None) -> ClusterState:
    """Per-cluster vector sums and sizes (k x 4^n numbers)."""
    got = collect_array_sums(df.select(label.alias("_c"), v), v, "_c")
    sums, sizes = [None] * k, [0] * k
    for c, (S, n) in got.items():
        sums[c], sizes[c] = [float(x) for x in S], n
    return ClusterState(sums, sizes)


class _Centres:
    """Cluster sums and sizes of one Lloyd step, and the assignment of rows to them."""

    def __init__(self, sums: np.ndarray, sizes: np.ndarray):
        self.sums, self.sizes = sums, sizes

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Nearest cluster mean, the smaller number on ties; an empty cluster wins nothing."""
        mean = self.sums / np.maximum(self.sizes, 1)[:, None]
        d = (x * x).sum(axis=1)[:, None] - 2.0 * x @ mean.T + (mean * mean).sum(axis=1)
        return np.where(self.sizes > 0, d, np.inf).argmin(axis=1)


def _lloyd_step(base: DataFrame, new: _Centres | None, old: _Centres | None, k: int, v: str) -> tuple[_Centres, int]:
    """Cluster sums under the labels that ``new`` gives (the initial ones if None) and how many labels changed from ``old``.

    Each partition turns its blocks into ``k`` sums by a matrix product; the sums are added in Spark.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    def run(batches):
        sums = sizes = None
        changed = 0
        for batch in batches:
            x, first = matrix(batch.column(0)), batch.column(1).to_numpy()
            to = first if new is None else new.assign(x)
            before = to if new is None else first if old is None else old.assign(x)
            one = (to[:, None] == np.arange(k)).astype(np.float64)
            sums = one.T @ x + (0 if sums is None else sums)
            sizes = one.sum(axis=0) + (0 if sizes is None else sizes)
            changed += int((to != before).sum())
        if sums is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(k, dtype=np.int32)), pa.array(sizes.astype(np.int64)),
                 pa.array([changed] + [0] * (k - 1), pa.int64()), pa.array(list(sums), pa.list_(pa.float64()))],
                ["c", "n", "changed", "s"])

    parts = base.select(v, "_c0").mapInArrow(run, "c int, n long, changed long, s array<double>")
    rows = parts.groupBy("c").agg(Summarizer.sum(array_to_vector("s")).alias("s"), F.sum("n").alias("n"),
                                  F.sum("changed").alias("changed")).collect()
    if not rows:
        return _Centres(np.zeros((k, 1)), np.zeros(k)), 0
    rows.sort(key=lambda r: r["c"])
    return (_Centres(np.array([r["s"].toArray() for r in rows]), np.array([r["n"] for r in rows], np.float64)),
            sum(r["changed"] for r in rows))


def kernel_kmeans(vecs: DataFrame, k: int = 2, max_iter: int = 100, v: str = "v", seed: int = 42,
                  key: str = "row_id") -> tuple[DataFrame, int]:
    """G-6: Lloyd iterations in kernel space; stops when no label changes.

    ``v`` holds vectors whose inner products are the kernel: density vectors (exact), or landmark
    features.  Each step is ONE pass over the written vector table: rows are assigned by the
    step's k x width sums, summed per new cluster with matrix products in the tasks, and changed
    labels are counted.  Returns ``(vecs + cluster, steps)``.
    """
    base = cut_lineage(vecs.withColumn("_c0", initial_clusters(vecs, k, key, seed)))
    state, _ = _lloyd_step(base, None, None, k, v)
    old, steps, changed = None, 0, 0
    for _ in range(max_iter):
        after, changed = _lloyd_step(base, state, old, k, v)
        steps += 1
        if changed == 0:
            break
        old, state = state, after
    last, at = (state, old)[changed > 0 and old is not None], base.columns.index(v)

    def label(batches):
        for batch in batches:
            rows = pa.array(last.assign(matrix(batch.column(at))).astype(np.int32)) if batch.num_rows else pa.array([], pa.int32())
            yield batch.set_column(batch.num_columns - 1, "cluster", rows)

    schema = T.StructType(base.schema.fields[:-1] + [T.StructField("cluster", T.IntegerType())])
    return base.mapInArrow(label, schema), steps


# --------------------------------------------------------------------------- numpy vectors, landmark mode

def _map_rows(df: DataFrame, angle: str, keep: Sequence[str], fn) -> DataFrame:
    """``keep`` columns and ``v = fn(angles)`` per block of rows."""
    keep = [c for c in keep if c in df.columns]
    rows = df.select(*keep, F.col(angle).cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                out = fn(matrix(part.column(len(keep))))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), flat], [*keep, "v"])

    return rows.mapInArrow(run, rows.schema)


def density_rows(df: DataFrame, fmap: FeatureMap, angle: str = "angle", keep: Sequence[str] = ("row_id", "y")) -> DataFrame:
    """``kernel_vectors`` by matrix arithmetic per block of rows (same order of entries)."""
    i, j = np.triu_indices(fmap.dim, 1)

    def vectors(x):
        a = fmap.states(x)
        off = a[:, i] * a[:, j].conj() * math.sqrt(2.0)
        return np.concatenate([np.abs(a) ** 2, np.stack([off.real, off.imag], axis=2).reshape(len(x), -1)], axis=1)

    return _map_rows(df, angle, keep, vectors)


def landmark_features(df: DataFrame, fmap: FeatureMap, landmarks: int = 256, angle: str = "angle", key: str = "row_id",
                      keep: Sequence[str] = ("row_id", "y"), seed: int = 42) -> DataFrame:
    """G-6 landmark mode: Nystrom features ``v`` of the fidelity kernel from hash-chosen landmark rows.

    ``<v_x, v_y>`` is the kernel projected on the span of the landmarks, exact for landmarks
    themselves.  A row costs ``landmarks`` numbers instead of 4^n, whatever the number of angles.
    """
    from .sample import random_sample

    chosen = random_sample(df, landmarks, key, seed).select(F.col(angle).cast("array<double>").alias("a")).collect()
    marks = fmap.states(np.array([r["a"] for r in chosen], np.float64)).conj().T
    gram = np.abs(fmap.states(np.array([r["a"] for r in chosen], np.float64)) @ marks) ** 2
    values, vectors = np.linalg.eigh(gram)
    solid = values > 1e-10 * values.max()
    root = vectors[:, solid] / np.sqrt(values[solid])
    return _map_rows(df, angle, keep, lambda x: np.abs(fmap.states(x) @ marks) ** 2 @ root)


def kernel_kmeans_step(vecs: DataFrame, k: int = 2, v: str = "v", seed: int = 42, key: str = "row_id") -> DataFrame:
    """One assignment step from the seeded labels, with the distances (for checking)."""
    width = None
    vecs = cut_lineage(vecs)
    label = initial_clusters(vecs, k, key, seed)
    state = cluster_state(vecs, label, k, v, width)
    d = state.distances(v)
    extra = [c for c in ("y",) if c in vecs.columns]
    return vecs.select("row_id", *extra, label.alias("c0"), d.alias("dist"), argmin(d).alias("cluster"))
