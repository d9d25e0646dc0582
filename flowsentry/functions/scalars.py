"""Scalar column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hex digits of the md5 prefix turned into a number: 13 hex = 52 bits, exact in a double.
_HASH_HEX = 13
_HASH_SPAN = float(16 ** _HASH_HEX)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def binarize(label, normal_values: Iterable[str] | str) -> Column:
    """P-1: normal class(es) -> 0, everything else (NULL included) -> 1."""
    if isinstance(normal_values, str):
        normal_values = [normal_values]
    normal = list(normal_values)
    return F.when(col_(label).isin(normal), F.lit(0)).otherwise(F.lit(1)).cast("int")


def lenient_double(c) -> Column:
    """P-4: bad text -> NULL -> 0 (``to_numeric(errors='coerce').fillna(0)``)."""
    return F.coalesce(col_(c).try_cast("double"), F.lit(0.0))


def strict_double(c) -> Column:
    """P-5: plain cast; under ANSI a bad value fails the job like ``astype(float)``."""
    return col_(c).cast("double")


def finite_or_null(c) -> Column:
    """P-6: NaN and +/-Inf -> NULL (Spark keeps NULL and NaN apart)."""
    x = col_(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def clean_double(c, fill: float = 0.0) -> Column:
    """P-4 + P-6 + P-7: lenient cast, non-finite -> missing -> ``fill``."""
    return F.coalesce(finite_or_null(col_(c).try_cast("double")), F.lit(float(fill)))


def sigmoid(z) -> Column:
    """M-10 logit -> probability."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_(z)))


def bce_with_logits(z, y) -> Column:
    """A-22 numerically stable binary cross-entropy from logits."""
    z, y = col_(z), col_(y).cast("double")
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def safe_ratio(num, den) -> Column:
    """0 on zero division (``zero_division=0``)."""
    return F.coalesce(F.try_divide(col_(num).cast("double"), col_(den).cast("double")), F.lit(0.0))


def hash_key(key, seed: int) -> Column:
    """md5 of ``key:seed`` -- the same string hashes identically in DuckDB."""
    return F.md5(F.concat_ws(":", col_(key).cast("string"), F.lit(str(seed))))


def hash_unit(hex_col) -> Column:
    """Map an md5 hex string to [0, 1), monotone in the string order."""
    return F.conv(F.substring(col_(hex_col), 1, _HASH_HEX), 16, 10).cast("double") / F.lit(_HASH_SPAN)


# Largest side (rows) joined with a broadcast hint; beyond it the join is left to a shuffle.
BROADCAST_ROW_LIMIT = 200_000


def broadcast_if_small(df, n_rows: int, limit: int = BROADCAST_ROW_LIMIT):
    """Broadcast hint only for a side whose row count is known and small."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if n_rows <= limit else df
