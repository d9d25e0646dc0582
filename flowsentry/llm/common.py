"""Helpers shared by the training-data operators: scratch tables, hold-out split, Arrow columns."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.operators.skew import hot_shares, spread_join  # noqa: F401  (shared by the operators here)
from flowsentry.session import ensure_checkpoint_dir


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor costs nothing that was written) and keeps
    Parquet's column pruning for the readers.  ``drop_scratch`` removes it early.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(*frames: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def remainder(doc_id, mod: int):
    """crc32 of the id as text, modulo ``mod`` (NULL for a NULL id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def held_out(doc_id, mod: int, rest: int = 2):
    """The hold-out flag; a NULL id is not held out (and is never learned from)."""
    return F.coalesce(remainder(doc_id, mod) == rest, F.lit(False))


def learnable(doc_id, mod: int, rest: int = 2):
    return F.coalesce(remainder(doc_id, mod) != rest, F.lit(False))


def hash_share(col, share: float, salt: str):
    """Rows whose salted 64-bit hash lies in the lowest ``share`` of the range: a replayable sample."""
    return F.pmod(F.xxhash64(col, F.lit(salt)), F.lit(1 << 40)) < F.lit(int(min(1.0, share) * (1 << 40)))


def text_chunks(column: pa.Array, limit: int = 1 << 19):
    """Cut a string column into runs of whole rows of about ``limit`` bytes (one longer row stays whole).

    Yields ``(first_row, bytes, offsets)``; a NULL counts as an empty text.
    """
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, off_buf, data = column.buffers()
    off = np.frombuffer(off_buf, np.int64)[column.offset:column.offset + n + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, bytes(view[off[i]:off[j]]), off[i:j + 1] - off[i]
        i = j


def keep_rows(docs: DataFrame, test) -> DataFrame:
    """Rows for which ``test(record_batch)`` gives true, unchanged and without a shuffle."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(test(batch), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def read_documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
