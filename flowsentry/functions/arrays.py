"""Dense-vector arithmetic on ``array<double>`` columns.

Vectors are short (2..128 entries), so the higher-order functions stay
cheap; when the width is known and tiny, callers may unroll to plain
column arithmetic instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col_


def lit_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def lit_matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[lit_vector(r) for r in rows])


def assemble(cols: Sequence) -> Column:
    """P-11: horizontal stack of scalar columns / arrays into one ``array<double>``."""
    parts = []
    for c in cols:
        parts.append(c if isinstance(c, Column) else F.array(F.col(c).cast("double")))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def sq_dist(a, b) -> Column:
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, v: acc + v)


def l2_dist(a, b) -> Column:
    return F.sqrt(sq_dist(a, b))


def sq_norm(a) -> Column:
    return F.aggregate(col_(a), F.lit(0.0), lambda acc, v: acc + v * v)


def vsub(a, b) -> Column:
    return F.zip_with(col_(a), col_(b), lambda x, y: x - y)


def vscale(a, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(col_(a), lambda x: x * s)


def mean_sq_residual(x, r) -> Column:
    """A-18: mean squared residual per row."""
    return sq_dist(x, r) / F.size(col_(x)).cast("double")


def affine(a, shift: Sequence[float], scale: Sequence[float]) -> Column:
    """(a - shift) * scale element-wise, with literal shift/scale vectors."""
    return F.zip_with(F.zip_with(col_(a), lit_vector(shift), lambda x, m: x - m), lit_vector(scale),
                      lambda x, s: x * s)


def matvec(matrix_rows: Sequence[Sequence[float]], a) -> Column:
    """Project ``a`` onto literal row vectors: result[i] = <rows[i], a>."""
    return F.array(*[dot(lit_vector(r), a) for r in matrix_rows])


def distances_to(points: Sequence[Sequence[float]], a, squared: bool = False) -> Column:
    """J-4: distance of ``a`` to every literal point (bounded list, e.g. centroids)."""
    ds = [sq_dist(a, lit_vector(p)) for p in points]
    if not squared:
        ds = [F.sqrt(d) for d in ds]
    return F.array(*ds)


def argmin(arr) -> Column:
    """O-3: 0-based index of the smallest entry; ties -> lowest index (numpy rule).

    Use +inf (not NULL) for entries that must never win, e.g. empty clusters.
    """
    a = col_(arr)
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def vector_sum_agg(arr, width: int) -> Column:
    """Element-wise SUM aggregate of a fixed-width array (partial aggregation friendly)."""
    return F.array(*[F.sum(F.element_at(col_(arr), i + 1)) for i in range(width)])


def vector_avg_agg(arr, width: int) -> Column:
    return F.array(*[F.avg(F.element_at(col_(arr), i + 1)) for i in range(width)])


def collect_array_sums(df, arr, by=None) -> dict:
    """Element-wise sums of an array column, optionally per group: {group: (sums, row count)}.

    One vector aggregate per group (Spark ML ``Summarizer``, partial +
    final), so every row is read once and only groups x width numbers
    reach the driver.  (Exploding the array instead would let Catalyst
    evaluate per-row label expressions once per array element.)
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    keys = [by] if by else []
    summ = Summarizer.metrics("sum", "count").summary(array_to_vector(arr)).alias("s")
    rows = df.groupBy(*keys).agg(summ).collect()
    return {(r[by] if by else None): ([float(x) for x in r["s"]["sum"].toArray()], int(r["s"]["count"]))
            for r in rows}
