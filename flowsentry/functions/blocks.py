"""Numpy on Arrow batches: a list column as a matrix, a computed column added batch by batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as a matrix (rows x width)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _column(values: np.ndarray) -> pa.Array:
    if values.ndim == 1:
        return pa.array(values, pa.float64())
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1), pa.float64()))


def with_block(df: DataFrame, feat: str, out: str, fn: Callable[[np.ndarray], np.ndarray], many: bool = False) -> DataFrame:
    """``df`` with ``out`` = ``fn`` of the matrix that each batch of ``feat`` makes: a number a row, or (``many``) a list."""
    keep = [c for c in df.columns if c != out]
    kind = T.ArrayType(T.DoubleType()) if many else T.DoubleType()
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, kind)])
    at = keep.index(feat)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = np.asarray(fn(matrix(batch.column(at))), np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns, _column(values)], [*keep, out])

    return df.select(*keep).mapInArrow(run, schema)
