"""Reproducible exact-size sampling and splitting (X-1..X-5, W-5, P-15).

Rows are ordered inside their stratum by ``md5(key:seed)`` (ties: key), so
the result does not depend on partitioning and can be replayed in SQL as
``row_number() over (partition by stratum order by md5(...), key)``.

A global or per-class window over all rows would put a whole class into
one task.  Instead the hash is read as a uniform number ``u``: for a cut
at rank ``c`` in a class of ``N`` rows, ``u`` of the cut lies, with
overwhelming probability, in a narrow band around ``c / N``.  One counting
pass verifies the band; rows below or above it are decided by a filter,
and only the band rows (about ``12 sqrt(N)`` per cut) are ranked with a
window.  If a band ever misses, it is widened and re-verified, so the cut
is exact, never approximate.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import broadcast_if_small, hash_key, hash_unit

_NULL_STRATUM = "\u0000null"
_SIGMAS = 7.0


def allocate(counts: Mapping, n_take: int) -> dict:
    """Largest-remainder allocation of ``n_take`` over class counts.

    Same arithmetic as scikit-learn's stratified splitters: floor of
    ``count / total * n``, then one extra row to the largest remainders;
    ties go to the smaller class label (the reference breaks them at random).
    """
    total = sum(counts.values())
    if total == 0:
        return {k: 0 for k in counts}
    cont = {k: (v / total) * n_take for k, v in counts.items()}
    fl = {k: int(math.floor(c)) for k, c in cont.items()}
    need = int(n_take - sum(fl.values()))
    order = sorted(counts, key=lambda k: (-(cont[k] - fl[k]), str(k)))
    for k in order[:max(need, 0)]:
        fl[k] += 1
    return fl


def _stratum(df: DataFrame, strata: str | None):
    if strata is None:
        return F.lit("all")
    return F.coalesce(F.col(strata).cast("string"), F.lit(_NULL_STRATUM))


def _class_counts(df: DataFrame, strata: str | None) -> dict:
    rows = df.select(_stratum(df, strata).alias("_s")).groupBy("_s").count().collect()
    return {r["_s"]: r["count"] for r in rows}


def _map_lit(d: Mapping, cast: str):
    if not d:
        return F.create_map().cast(f"map<string,{cast}>")
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v).cast(cast)]
    return F.create_map(*items)


def assign_segments(df: DataFrame, key: str, strata: str | None, cuts: Mapping[str, Sequence[int]],
                    counts: Mapping[str, int], seed: int = 42, out: str = "segment") -> DataFrame:
    """Tag every row with the number of class cuts its hash rank has passed.

    ``cuts[class]`` are 0-based rank positions; a row of rank ``r`` gets
    ``segment = #{c in cuts : r >= c}``.  Exact; shuffles only band rows.
    """
    h = hash_key(key, seed)
    base = df.withColumn("_s", _stratum(df, strata)).withColumn("_h", h).withColumn("_u", hash_unit("_h"))
    # bands per (class, cut); all bookkeeping is bounded by (#classes x #cuts)
    ncut = max((len(v) for v in cuts.values()), default=0)
    bands: dict[tuple[str, int], list] = {}
    for s, cs in cuts.items():
        n = counts.get(s, 0)
        for j, c in enumerate(sorted(cs)):
            if n == 0:
                continue
            p = c / n
            d = _SIGMAS * math.sqrt(max(p * (1 - p), 1.0 / n) / n) + 2.0 / n
            bands[(s, j)] = [max(0.0, p - d), min(1.0, p + d), c]
    for _ in range(4):
        if not bands:
            break
        aggs = []
        keys = list(bands)
        for i, (s, j) in enumerate(keys):
            lo, hi, _c = bands[(s, j)][:3]
            in_s = F.col("_s") == F.lit(s)
            aggs += [F.count_if(in_s & (F.col("_u") < F.lit(lo))).alias(f"b{i}"),
                     F.count_if(in_s & (F.col("_u") >= F.lit(lo)) & (F.col("_u") <= F.lit(hi))).alias(f"c{i}")]
        row = base.agg(*aggs).collect()[0]
        bad = False
        for i, kk in enumerate(keys):
            lo, hi, c = bands[kk][:3]
            b, w = row[f"b{i}"], row[f"c{i}"]
            if b <= c <= b + w:
                bands[kk] = [lo, hi, c, b]
            else:
                bands[kk] = [0.0 if b > c else lo, 1.0 if b + w < c else hi, c]
                bad = True
        if not bad:
            break
    # segment for rows outside every band of their class: pure filter arithmetic
    seg = F.lit(0)
    in_any = F.lit(False)
    for j in range(ncut):
        lo_m = _map_lit({s: bands[(s, j)][0] for (s, jj) in bands if jj == j}, "double")
        hi_m = _map_lit({s: bands[(s, j)][1] for (s, jj) in bands if jj == j}, "double")
        lo, hi = F.element_at(lo_m, F.col("_s")), F.element_at(hi_m, F.col("_s"))
        has = lo.isNotNull()
        seg = seg + F.when(has & (F.col("_u") > hi), 1).otherwise(0)
        in_any = in_any | (has & (F.col("_u") >= lo) & (F.col("_u") <= hi))
    outside = base.where(~in_any).withColumn(out, seg)
    inside = base.where(in_any).withColumn("_seg0", seg)
    extra = F.lit(0)
    for j in range(ncut):
        lo_m = _map_lit({s: bands[(s, j)][0] for (s, jj) in bands if jj == j}, "double")
        hi_m = _map_lit({s: bands[(s, j)][1] for (s, jj) in bands if jj == j}, "double")
        b_m = _map_lit({s: bands[(s, j)][3] for (s, jj) in bands if jj == j}, "bigint")
        c_m = _map_lit({s: bands[(s, j)][2] for (s, jj) in bands if jj == j}, "bigint")
        lo, hi = F.element_at(lo_m, F.col("_s")), F.element_at(hi_m, F.col("_s"))
        inb = lo.isNotNull() & (F.col("_u") >= lo) & (F.col("_u") <= hi)
        w = Window.partitionBy("_s", inb).orderBy("_h", key)
        rank = F.element_at(b_m, F.col("_s")) + F.row_number().over(w) - 1
        extra = extra + F.when(inb & (rank >= F.element_at(c_m, F.col("_s"))), 1).otherwise(0)
    inside = inside.withColumn(out, F.col("_seg0") + extra).drop("_seg0")
    return outside.unionByName(inside).drop("_s", "_h", "_u")


def stratified_sample(df: DataFrame, n: int, key: str, strata: str | None = None, seed: int = 42) -> DataFrame:
    """X-2 / X-4 / X-5: exactly ``n`` rows, allocated over strata by largest remainder."""
    counts = _class_counts(df, strata)
    total = sum(counts.values())
    if n >= total:  # X-5 bypass
        return df
    take = allocate(counts, n)
    tagged = assign_segments(df, key, strata, {s: [t] for s, t in take.items()}, counts, seed)
    return tagged.where(F.col("segment") == 0).drop("segment")


def random_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """X-4: simple random sample of exactly ``n`` rows (hash order)."""
    return stratified_sample(df, n, key, None, seed)


def stratified_split(df: DataFrame, test_frac: float, key: str, strata: str | None = None, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """X-3: two-way split; test = ceil(N * frac) rows; train allocated first (as scikit-learn)."""
    counts = _class_counts(df, strata)
    total = sum(counts.values())
    n_test = int(math.ceil(test_frac * total))
    train = allocate(counts, total - n_test)
    tagged = assign_segments(df, key, strata, {s: [t] for s, t in train.items()}, counts, seed)
    return tagged.withColumn(out, F.when(F.col("segment") == 0, "train").otherwise("test")).drop("segment")


def three_way_split(df: DataFrame, hold_frac: float, key: str, strata: str | None = None, seed: int = 42,
                    out: str = "split") -> DataFrame:
    """X-3 twice: train / (val, test) with the hold-out halved, as the detector study does."""
    first = stratified_split(df, hold_frac, key, strata, seed, out)
    hold = first.where(F.col(out) == "test").drop(out)
    second = stratified_split(hold, 0.5, key, strata, seed, out).withColumn(
        out, F.when(F.col(out) == "train", "val").otherwise("test"))
    return first.where(F.col(out) == "train").unionByName(second)


def fixed_split(df: DataFrame, n_train: int, n_test: int, key: str, seed: int = 42, out: str = "split") -> DataFrame:
    """X-1: disjoint unstratified train/test of exact sizes (test = first ranks, then train)."""
    counts = _class_counts(df, None)
    total = counts.get("all", 0)
    if n_train + n_test > total:
        raise ValueError(f"train+test = {n_train + n_test} exceeds {total} rows")
    tagged = assign_segments(df, key, None, {"all": [n_test, n_test + n_train]}, counts, seed)
    return (tagged.where(F.col("segment") < 2)
            .withColumn(out, F.when(F.col("segment") == 0, "test").otherwise("train")).drop("segment"))


def gather(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """P-15: row gather by id = left semi join."""
    return df.join(ids.select(key), on=key, how="left_semi")


def stratum_ordinal(df: DataFrame, key: str, strata: str | None = None, seed: int = 42,
                    rows_per_bucket: int = 1_000_000, out: str = "ordinal") -> DataFrame:
    """W-5: 0-based ordinal of each row inside its stratum, in hash order.

    A window partitioned by the stratum alone would sort a hot class in one
    task.  The hash prefix splits every class into ordered sub-buckets of
    about ``rows_per_bucket`` rows; the ordinal is the in-bucket row number
    plus the bucket's offset from a (classes x buckets)-row count table.
    """
    counts = _class_counts(df, strata)
    nb = {s: max(1, math.ceil(n / rows_per_bucket)) for s, n in counts.items()}
    base = (df.withColumn("_s", _stratum(df, strata)).withColumn("_h", hash_key(key, seed))
            .withColumn("_b", F.least(F.floor(hash_unit("_h") * F.element_at(_map_lit(nb, "int"), F.col("_s"))),
                                      F.element_at(_map_lit(nb, "int"), F.col("_s")) - 1).cast("int")))
    sizes = base.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    wo = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("_s", "_b", F.coalesce(F.sum("_n").over(wo), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_s", "_b").orderBy("_h", key)
    ranked = base.withColumn("_rn", F.row_number().over(w))
    n_offs = sum(nb.values())  # one row per (class, bucket): grows with N / rows_per_bucket, so checked
    return (ranked.join(broadcast_if_small(offs, n_offs), ["_s", "_b"])
            .withColumn(out, F.col("_off") + F.col("_rn") - 1)
            .drop("_s", "_h", "_b", "_rn", "_off"))
