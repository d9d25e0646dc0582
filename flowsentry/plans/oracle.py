"""Plain-SQL statements of the registered queries (DuckDB dialect).

They are written the straightforward way -- full windows, full sorts,
brute-force pairs -- so they serve as an independent check of the
Spark plans, which reach the same numbers by scalable routes.
"""

from __future__ import annotations

from ..operators.metrics import SWEEP_PERCENTILES
from ..sources.standins import EVENT_NORMAL_TYPES, LINEITEM_NORMAL_FLAG

SEED = 42


def _in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def dbl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


EVENT_FLOWS = f"""
  SELECT event_id AS row_id, event_type AS label,
         CASE WHEN event_type IN ({_in_list(EVENT_NORMAL_TYPES)}) THEN 0 ELSE 1 END AS y,
         CAST(value AS DOUBLE) AS value,
         COALESCE(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k
  FROM events"""

LINEITEM_FLOWS = f"""
  SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
         l_returnflag AS label,
         CASE WHEN l_returnflag = '{LINEITEM_NORMAL_FLAG}' THEN 0 ELSE 1 END AS y,
         l_linestatus, CAST(year(l_shipdate) AS VARCHAR) AS ship_year,
         CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice,
         CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax
  FROM lineitem"""

EMBEDDING_VECTORS = """
  SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS label,
         CASE WHEN label = 0 THEN 1 ELSE 0 END AS y,
         CAST(embedding AS DOUBLE[]) AS x
  FROM embeddings"""


def hash_order(key: str, seed: int = SEED) -> str:
    return f"md5(CAST({key} AS VARCHAR) || ':{seed}'), {key}"


def allocation_ctes(src: str, strata: str | None, take_expr: str, prefix: str) -> str:
    """Largest-remainder allocation as CTEs ``{prefix}_take(stratum, take)``.

    ``take_expr`` may use ``total_n`` (total rows).
    """
    s = f"CAST({strata} AS VARCHAR)" if strata else "'all'"
    return f"""
{prefix}_cnt AS (SELECT {s} AS stratum, count(*) AS n FROM {src} GROUP BY 1),
{prefix}_tot AS (SELECT sum(n) AS total_n FROM {prefix}_cnt),
{prefix}_want AS (SELECT CAST({take_expr} AS BIGINT) AS want FROM {prefix}_tot),
{prefix}_cont AS (SELECT stratum, n, (CAST(n AS DOUBLE) / total_n) * want AS cont
                  FROM {prefix}_cnt, {prefix}_tot, {prefix}_want),
{prefix}_fl AS (SELECT stratum, n, floor(cont) AS fl, cont - floor(cont) AS rem FROM {prefix}_cont),
{prefix}_need AS (SELECT (SELECT want FROM {prefix}_want) - sum(fl) AS need FROM {prefix}_fl),
{prefix}_take AS (SELECT stratum, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, stratum)
                         <= (SELECT need FROM {prefix}_need) THEN 1 ELSE 0 END AS BIGINT) AS take
                  FROM {prefix}_fl)"""


def ranked(src: str, key: str, strata: str | None, seed: int = SEED) -> str:
    s = f"CAST({strata} AS VARCHAR)" if strata else "'all'"
    return (f"SELECT *, {s} AS stratum, row_number() OVER (PARTITION BY {s} ORDER BY {hash_order(key, seed)}) - 1"
            f" AS rnk FROM {src}")


def split_ctes(src: str, key: str, strata: str | None, test_frac: float, prefix: str, seed: int = SEED) -> str:
    """``{prefix}_split``: src columns + ``split`` ('train' | 'test'), train allocated first."""
    alloc = allocation_ctes(src, strata, f"total_n - ceil({dbl(test_frac)} * total_n)", prefix)
    return alloc + f""",
{prefix}_rk AS ({ranked(src, key, strata, seed)}),
{prefix}_split AS (SELECT r.* EXCLUDE (stratum, rnk),
                          CASE WHEN r.rnk < t.take THEN 'train' ELSE 'test' END AS split
                   FROM {prefix}_rk r JOIN {prefix}_take t USING (stratum))"""


def sample_ctes(src: str, key: str, strata: str | None, n: int, prefix: str, seed: int = SEED) -> str:
    """``{prefix}_sample``: exactly ``n`` rows (or all when n >= N)."""
    alloc = allocation_ctes(src, strata, f"least({int(n)}, total_n)", prefix)
    return alloc + f""",
{prefix}_rk AS ({ranked(src, key, strata, seed)}),
{prefix}_sample AS (SELECT r.* EXCLUDE (stratum, rnk) FROM {prefix}_rk r JOIN {prefix}_take t USING (stratum)
                    WHERE r.rnk < t.take)"""


def sweep_fracs_list() -> str:
    return "[" + ", ".join(dbl(p / 100.0) for p in SWEEP_PERCENTILES) + "]"


def sweep_ctes(src: str, prefix: str) -> str:
    """``{prefix}_sweep(i, pct, threshold, precision, recall, f1, best)`` on ``src(score, y)``."""
    pcts = "[" + ", ".join(dbl(p) for p in SWEEP_PERCENTILES) + "]"
    return f"""
{prefix}_q AS (SELECT quantile_cont(score, {sweep_fracs_list()}) AS qs FROM {src}),
{prefix}_th AS (SELECT i, {pcts}[i] AS pct, qs[i] AS threshold FROM {prefix}_q, range(1, 41) t(i)),
{prefix}_P AS (SELECT count(*) FILTER (WHERE y = 1) AS P FROM {src}),
{prefix}_cnt AS (SELECT th.i, th.pct, th.threshold,
                        count(*) FILTER (WHERE s.score > th.threshold AND s.y = 1) AS tp,
                        count(*) FILTER (WHERE s.score > th.threshold AND s.y <> 1) AS fp
                 FROM {prefix}_th th, {src} s GROUP BY th.i, th.pct, th.threshold),
{prefix}_m AS (SELECT c.i, c.pct, c.threshold,
                      COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0) AS precision,
                      COALESCE(CAST(tp AS DOUBLE) / NULLIF(P, 0), 0.0) AS recall,
                      COALESCE(CAST(2 * tp AS DOUBLE) / NULLIF(tp + fp + P, 0), 0.0) AS f1
               FROM {prefix}_cnt c, {prefix}_P),
{prefix}_sweep AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY f1 DESC, i) = 1 THEN 1 ELSE 0 END AS best
                   FROM {prefix}_m)"""


def auc_ctes(src: str, prefix: str) -> str:
    """``{prefix}_auc(auc)`` by the rank statistic with averaged ties."""
    return f"""
{prefix}_g AS (SELECT score, count(*) AS c, count(*) FILTER (WHERE y = 1) AS p FROM {src} GROUP BY score),
{prefix}_c AS (SELECT score, c, p, sum(c) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) - c AS below
               FROM {prefix}_g),
{prefix}_auc AS (SELECT CASE WHEN sum(p) > 0 AND sum(c) - sum(p) > 0 THEN
                   (sum(p * (below + (c + 1) / 2.0)) - sum(p) * (sum(p) + 1) / 2.0)
                   / (CAST(sum(p) AS DOUBLE) * (sum(c) - sum(p))) END AS auc FROM {prefix}_c)"""


def metrics_select(src: str) -> str:
    """precision / recall / f1 / accuracy columns over ``src(y, pred)`` (one row)."""
    return f"""SELECT
  COALESCE(CAST(count(*) FILTER (WHERE y = 1 AND pred = 1) AS DOUBLE)
           / NULLIF(count(*) FILTER (WHERE pred = 1), 0), 0.0) AS precision,
  COALESCE(CAST(count(*) FILTER (WHERE y = 1 AND pred = 1) AS DOUBLE)
           / NULLIF(count(*) FILTER (WHERE y = 1), 0), 0.0) AS recall,
  COALESCE(CAST(2 * count(*) FILTER (WHERE y = 1 AND pred = 1) AS DOUBLE)
           / NULLIF(count(*) FILTER (WHERE pred = 1) + count(*) FILTER (WHERE y = 1), 0), 0.0) AS f1,
  CAST(count(*) FILTER (WHERE y = pred) AS DOUBLE) / count(*) AS accuracy
FROM {src}"""


_CENTROID_TAIL = f"""{split_ctes('s', 'row_id', 'y', 0.25, 'sp')},
val AS (SELECT score, y FROM sp_split WHERE split = 'test'),
{sweep_ctes('val', 'sw')},
best AS (SELECT pct, threshold, f1 FROM sw_sweep WHERE best = 1),
pr AS (SELECT s.y, CASE WHEN s.score > best.threshold THEN 1 ELSE 0 END AS pred FROM s, best),
met AS ({metrics_select('pr')}),
{auc_ctes('s', 'au')}
SELECT round(best.pct, 6) AS best_pct, round(best.threshold, 6) AS threshold, round(best.f1, 6) AS val_f1,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(met.f1, 6) AS f1,
       round(accuracy, 6) AS accuracy, round(auc, 6) AS auc
FROM best, met, au_auc
"""

CENTROID_ANOMALY = f"""
WITH f AS ({EVENT_FLOWS}),
st AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM f),
z AS (SELECT row_id, y, (value - mv) * (1.0 / sv) AS z1, (k - mk) * (1.0 / sk) AS z2 FROM f, st),
c AS (SELECT avg(z1) AS c1, avg(z2) AS c2 FROM z WHERE y = 0),
s AS (SELECT row_id, y, sqrt((z1 - c1) * (z1 - c1) + (z2 - c2) * (z2 - c2)) AS score FROM z, c),
{_CENTROID_TAIL}"""


def centroid_flows_sql() -> str:
    """E-5 on the mixed flow records: scaled numbers, one-hot categories by their shares among normal rows."""
    num = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    cats = ["l_linestatus", "ship_year"]
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in num)
    z = ", ".join(f"({c} - m_{c}) * (1.0 / s_{c}) AS z_{c}" for c in num)
    centre = ", ".join(f"avg(z_{c}) AS c_{c}" for c in num)
    shares = ",\n".join(f"""
p_{c} AS (SELECT {c}, count(*) FILTER (WHERE y = 0) / (SELECT CAST(count(*) AS DOUBLE) FROM z WHERE y = 0) AS p FROM z GROUP BY {c}),
q_{c} AS (SELECT sum(p * p) AS q FROM p_{c})""" for c in cats)
    # squared distance of a one-hot vector from the shares: 1 - 2 p(own category) + sum of p^2
    far = " + ".join([f"pow(z_{c} - c_{c}, 2)" for c in num] + [f"(1.0 - 2.0 * p_{c}.p + q_{c}.q)" for c in cats])
    joins = " ".join(f"JOIN p_{c} USING ({c}) CROSS JOIN q_{c}" for c in cats)
    return f"""
WITH f AS ({LINEITEM_FLOWS}),
st AS (SELECT {stats} FROM f),
z AS (SELECT row_id, y, {', '.join(cats)}, {z} FROM f, st),
cn AS (SELECT {centre} FROM z WHERE y = 0),{shares},
s AS (SELECT row_id, y, round(sqrt({far}), 9) AS score FROM z CROSS JOIN cn {joins}),
{_CENTROID_TAIL}"""


# --------------------------------------------------------------------------- kernels

HASH_SPAN_SQL = "4503599627370496.0"  # 16^13


def hash_unit_sql(key: str, seed: int = SEED) -> str:
    return (f"CAST(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 13) AS BIGINT) AS DOUBLE)"
            f" / {HASH_SPAN_SQL}")


def angle_ctes(n: int, prefix: str = "an") -> str:
    """F-6 on ``n`` sums of equal blocks of all coordinates: ``{prefix}(row_id, y, x0..x{n-1})``."""
    width = 64 // n
    ps = ", ".join("(" + " + ".join(f"x[{width * i + j + 1}]" for j in range(width)) + f") AS p{i}" for i in range(n))
    stats = ", ".join(f"avg(p{i}) AS m{i}, stddev_pop(p{i}) AS s{i}" for i in range(n))
    zs = ", ".join(f"(p{i} - m{i}) * (1.0 / (s{i} + 1e-9)) AS z{i}" for i in range(n))
    mins = ", ".join(f"min(z{i})" for i in range(n))
    maxs = ", ".join(f"max(z{i})" for i in range(n))
    xs = ", ".join(f"(z{i} - gmin) / (gmax - gmin + 1e-9) * pi() AS x{i}" for i in range(n))
    return f"""
{prefix}_v AS ({EMBEDDING_VECTORS}),
{prefix}_p AS (SELECT row_id, y, {ps} FROM {prefix}_v),
{prefix}_st AS (SELECT {stats} FROM {prefix}_p),
{prefix}_z AS (SELECT row_id, y, {zs} FROM {prefix}_p, {prefix}_st),
{prefix}_mm AS (SELECT least({mins}) AS gmin, greatest({maxs}) AS gmax FROM {prefix}_z),
{prefix} AS (SELECT row_id, y, {xs} FROM {prefix}_z, {prefix}_mm)"""


def kernel_pairs_cte(map_type: str, n: int, entanglement: str = "full", src: str = "an", name: str = "kp") -> str:
    """K(i, j) of all pairs of ``src(row_id, x0..)`` from textbook forms, without amplitudes or basis states.

    Z and RX maps are products of one-qubit overlaps, cos^2 of the angle difference (of half of it for RX).
    The ZZ map is exp(i sum x_i s_i + i sum (pi - x_i)(pi - x_j) s_i s_j) over spins s = +-1, so the
    kernel is the squared modulus of the mean over all spins of exp(i times the difference of both sums).
    """
    if map_type in ("z", "rx"):
        scale = " / 2.0" if map_type == "rx" else ""
        k = " * ".join(f"pow(cos((a.x{i} - b.x{i}){scale}), 2)" for i in range(n))
        return f"{name} AS (SELECT a.row_id AS i, b.row_id AS j, {k} AS k FROM {src} a, {src} b)"
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if entanglement == "full" or j == i + 1]
    spins = ", ".join(f"1 - 2 * ((z >> {i}) & 1) AS s{i}" for i in range(n))
    terms = [f"(a.x{i} - b.x{i}) * s{i}" for i in range(n)]
    terms += [f"((pi() - a.x{i}) * (pi() - a.x{j}) - (pi() - b.x{i}) * (pi() - b.x{j})) * s{i} * s{j}" for i, j in pairs]
    return f"""{name}_spins AS (SELECT {spins} FROM range({2 ** n}) t(z)),
{name}_turn AS (SELECT a.row_id AS i, b.row_id AS j, {' + '.join(terms)} AS d FROM {src} a, {src} b, {name}_spins),
{name} AS (SELECT i, j, pow(avg(cos(d)), 2) + pow(avg(sin(d)), 2) AS k FROM {name}_turn GROUP BY i, j)"""


# --------------------------------------------------------------------------- neighbours / LOF

def knn_ctes(q_src: str, r_src: str, k: int, exclude_self: bool, prefix: str) -> str:
    """``{prefix}_nn(q, r, d, rk)``: k nearest rows of ``r_src`` for each row of ``q_src`` (brute force)."""
    cond = "WHERE a.row_id <> b.row_id" if exclude_self else ""
    return f"""
{prefix}_pr AS (SELECT a.row_id AS q, b.row_id AS r, list_distance(a.x, b.x) AS d FROM {q_src} a, {r_src} b {cond}),
{prefix}_nn AS (SELECT q, r, d, row_number() OVER (PARTITION BY q ORDER BY d, r) AS rk FROM {prefix}_pr
                QUALIFY rk <= {k})"""


def lof_ctes(train: str, evaluate: str | None, k: int, prefix: str = "lf") -> str:
    """``{prefix}_lof(row_id, score)`` -- LOF in outlier (evaluate=None) or novelty mode."""
    s = knn_ctes(train, train, k, True, f"{prefix}_t") + f""",
{prefix}_kd AS (SELECT q, max(d) AS kdist FROM {prefix}_t_nn GROUP BY q),
{prefix}_lrd AS (SELECT n.q, 1.0 / (avg(greatest(kd.kdist, n.d)) + 1e-10) AS lrd
                 FROM {prefix}_t_nn n JOIN {prefix}_kd kd ON kd.q = n.r GROUP BY n.q)"""
    if evaluate is None:
        qn, ql = f"{prefix}_t_nn", f"{prefix}_lrd"
    else:
        s += "," + knn_ctes(evaluate, train, k, False, f"{prefix}_e") + f""",
{prefix}_elrd AS (SELECT n.q, 1.0 / (avg(greatest(kd.kdist, n.d)) + 1e-10) AS lrd
                  FROM {prefix}_e_nn n JOIN {prefix}_kd kd ON kd.q = n.r GROUP BY n.q)"""
        qn, ql = f"{prefix}_e_nn", f"{prefix}_elrd"
    s += f""",
{prefix}_lof AS (SELECT n.q AS row_id, avg(o.lrd) / l.lrd AS score
                 FROM {qn} n JOIN {prefix}_lrd o ON o.q = n.r JOIN {ql} l ON l.q = n.q GROUP BY n.q, l.lrd)"""
    return s
