"""Sparse one-hot encoding with a vocabulary table (F-1 beyond a few hundred categories).

The vocabulary is a table (column, value, index, row count), never a list on the driver: distinct
values are range-sorted by column and value, and their indices are row numbers inside the
partitions plus the partitions' offsets, so all columns share one index space in the order that
``OneHot`` uses.  Encoding joins the table: as a broadcast while its measured bytes are within
``limit``, otherwise in a shuffle whose hot values are salted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import spread_join

#: bytes of a vocabulary that is sent to every executor
BROADCAST_BYTES = 32 << 20


def _values(df: DataFrame, cols: Sequence[str], *keep: str) -> DataFrame:
    """``keep``, ``pos`` (of the column) and ``value`` of every cell that is not NULL."""
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(c).cast("string").alias("value")) for i, c in enumerate(cols)])
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.pos", "_c.value").where("value IS NOT NULL")


@dataclass
class Vocabulary:
    """``table``: ``pos, value, idx, n`` of every category; ``width`` categories of ``bytes`` bytes."""

    cols: list[str]
    table: DataFrame
    width: int
    bytes: int

    def encode(self, df: DataFrame, key: str = "row_id", out: str = "onehot", limit: int = BROADCAST_BYTES) -> DataFrame:
        """``df`` with ``out``: struct of ``size``, ascending ``indices`` and ``values`` (all 1.0).

        ``key`` must be unique.  Unknown and NULL categories give no index.
        """
        pairs = _values(df, self.cols, key).withColumnRenamed(key, "_key")
        if self.bytes <= limit:
            found = pairs.join(F.broadcast(self.table.drop("n")), ["pos", "value"])
        else:
            found = spread_join(pairs, self.table, ["pos", "value"], "n", ["_key"])
        rows = found.groupBy("_key").agg(F.array_sort(F.collect_list("idx")).alias("_i"))    # one index per column at most
        indices = F.coalesce("_i", F.array().cast("array<int>"))
        return (df.join(rows, df[key] == rows["_key"], "left")
                .withColumn(out, F.struct(F.lit(self.width).alias("size"), indices.alias("indices"),
                                          F.transform(indices, lambda _: F.lit(1.0)).alias("values")))
                .drop("_key", "_i"))


def fit_vocabulary(df: DataFrame, cols: Sequence[str]) -> Vocabulary:
    """Categories of all columns with their indices, column after column, values ascending."""
    counted = _values(df, cols).groupBy("pos", "value").agg(F.count(F.lit(1)).alias("n"))
    ordered = cut_lineage(counted.repartitionByRange("pos", "value").sortWithinPartitions("pos", "value"))
    at = F.monotonically_increasing_id()        # the partition in the upper bits, the row in the lower 33
    placed = ordered.select("pos", "value", "n", F.shiftright(at, 33).alias("_p"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_r"))
    total, sizes = 0, []
    for r in placed.groupBy("_p").agg(F.count(F.lit(1)).alias("c")).orderBy("_p").collect():     # one row per partition
        sizes.append((r["_p"], total))
        total += r["c"]
    if not sizes:
        return Vocabulary(list(cols), ordered.select("pos", "value", F.lit(0).alias("idx"), "n"), 0, 0)
    first = df.sparkSession.createDataFrame(sizes, "_p long, _first long")
    table = cut_lineage(placed.join(F.broadcast(first), "_p")
                        .select("pos", "value", (F.col("_first") + F.col("_r")).cast("int").alias("idx"), "n"))
    size = table.agg(F.sum(F.octet_length("value") + 32)).first()[0]
    return Vocabulary(list(cols), table, total, int(size))


def to_ml_vector(onehot):
    """A Spark ML sparse vector of the struct, for the estimators (Spark has no built-in for it)."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    return F.udf(lambda s: Vectors.sparse(s["size"], s["indices"], s["values"]), VectorUDT())(onehot)
