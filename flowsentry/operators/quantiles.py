"""Exact quantiles of one column, of many columns or of many groups at once, by counts only (A-8).

Radix selection: every value has a cell on a path of ever finer cells, and the path is monotone in
the value.  The first cell is sign and binary exponent (-inf, 0 and +inf have cells of their own);
below it a cell is cut into ``bins`` equal parts between the smallest and the largest value
that it holds.  One aggregation a round counts the cells that hold wanted ranks, for
all groups together.  A rank is found when its cell holds one distinct value (ties end by their
count, whatever their number) or when it is the first or last of the cell.  Two different
doubles of one cell always fall into different parts, so every round makes progress: 512
parts end after 6 rounds at most, and only counts, minima and maxima reach the driver,
at most (wanted ranks x ``bins``) rows a round.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BINS = 512
_BEYOND = 4000      # cell of infinity; finite exponents lie within 26..2124


def _exponent_cell(v):
    """Sign and binary exponent as one int, ascending with the value."""
    size = F.floor(F.log2(F.abs(v))).cast("int") + 1100
    finite = F.when(v > 0, size).otherwise(-size)
    return (F.when(v == 0, 0).when(v == float("inf"), _BEYOND).when(v == -float("inf"), -_BEYOND)
            .otherwise(finite).cast("int"))


class _Open(NamedTuple):
    """A cell that holds wanted ranks which are neither its first nor its last."""

    group: object
    parent: object      # the group at first, then the number of the cell it is part of
    key: int
    first: int          # rank of its smallest value
    lo: float
    hi: float


def _settle(group, parent, rows: list, first: int, ranks: Sequence[int], found: dict) -> list[_Open]:
    """Find the ranks that cells ``(key, n, lo, hi)`` decide; the others stay open with their cell."""
    still = []
    for key, n, lo, hi in sorted(rows, key=lambda r: r[0]):
        inside = ranks[bisect_left(ranks, first):bisect_left(ranks, first + n)]
        for r in inside:
            if lo == hi or r == first:
                found[r] = lo
            elif r == first + n - 1:
                found[r] = hi
        if any(r not in found for r in inside):
            still.append(_Open(group, parent, key, first, lo, hi))
        first += n
    return still


def rank_values(vals: DataFrame, wanted, bins: int = BINS) -> tuple[dict, dict]:
    """Row counts, and values at 0-based ranks, per group of ``vals`` (``g``, ``v`` without NULL and NaN).

    ``wanted(n)`` gives the ranks for a group of ``n`` rows.  Returns ``({g: n}, {g: {rank: value}})``.
    """
    spark = vals.sparkSession
    cur = vals.select("g", "v", _exponent_cell(F.col("v")).alias("cell"))
    stats = (F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    by_group: dict = {}
    for r in cur.groupBy("g", "cell").agg(*stats).collect():
        by_group.setdefault(r["g"], []).append((r["cell"], r["n"], r["lo"], r["hi"]))
    totals = {g: sum(c[1] for c in cells) for g, cells in by_group.items()}
    ranks = {g: sorted(set(wanted(n))) for g, n in totals.items()}
    found: dict = {g: {} for g in totals}
    cells = [c for g, rows in by_group.items() for c in _settle(g, g, rows, 0, ranks[g], found[g])]
    parent, p_type, rounds = "g", vals.schema["g"].dataType.simpleString(), 0
    while cells:
        # one cell per wanted rank at most, so the list may be broadcast
        table = spark.createDataFrame([(i, c.parent, c.key, c.lo, c.hi) for i, c in enumerate(cells)],
                                      f"id int, p {p_type}, c int, lo double, hi double")
        here = cur.join(F.broadcast(table), cur[parent].eqNullSafe(table["p"]) & (cur["cell"] == table["c"]))
        part = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
        cur = here.select(table["id"].alias("up"), "v", F.least(part, F.lit(bins - 1)).cast("int").alias("cell"))
        rounds += 1
        if rounds == 2:     # few rows are left in open cells: later rounds read these only
            cur = cut_lineage(cur)
        per: dict = {}
        for r in cur.groupBy("up", "cell").agg(*stats).collect():
            per.setdefault(r["up"], []).append((r["cell"], r["n"], r["lo"], r["hi"]))
        cells = [x for i, c in enumerate(cells) for x in _settle(c.group, i, per[i], c.first, ranks[c.group], found[c.group])]
        parent, p_type = "up", "int"
    return totals, found


def grouped_quantiles(df: DataFrame, value: str, fracs: Sequence[float], by: str | None = None,
                      bins: int = BINS) -> dict:
    """``{group: [quantile, ...]}`` with linear interpolation (numpy ``linear``, SQL ``quantile_cont``).

    NULL and NaN are ignored; a group without any other value is left out.  Meant for groups whose
    number is bounded (models, columns), as each has its own open cells.
    """
    fracs = [float(f) for f in fracs]
    g = F.lit(0).alias("g") if by is None else F.col(by).alias("g")
    vals = df.select(g, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))

    def wanted(n):
        return [r for f in fracs for r in (math.floor(f * (n - 1)), math.ceil(f * (n - 1)))]

    totals, found = rank_values(vals, wanted, bins)
    out = {}
    for key, n in totals.items():
        qs = []
        for f in fracs:
            h = f * (n - 1)
            lo, hi = found[key][math.floor(h)], found[key][math.ceil(h)]
            qs.append(float(lo if lo == hi else lo + (hi - lo) * (h - math.floor(h))))
        out[key] = qs
    return out


def column_quantiles(df: DataFrame, cols: Sequence[str], fracs: Sequence[float], bins: int = BINS) -> dict:
    """``{column: [quantile, ...]}`` of many columns in one selection; ``[None, ...]`` for a column without values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("g"), F.col(c).cast("double").alias("v")) for c in cols]))
    got = grouped_quantiles(df.select(pairs.alias("p")).select("p.g", "p.v"), "v", fracs, "g", bins)
    return {c: got.get(c, [None] * len(fracs)) for c in cols}
