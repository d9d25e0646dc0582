"""Driver tables in the roles of the reference's flow records.

The reference reads NSL-KDD / CIC-IDS2017 CSVs that are not shipped; the
driver tables stand in (see README):

* ``lineitem``   -> mixed categorical + numeric flow records, class label ``l_returnflag``
* ``events``     -> multi-class event log, ``error`` is the attack class
* ``embeddings`` -> dense 64-wide feature matrix, label 0 is normal

Each view carries a stable ``row_id`` so positional numpy code becomes keyed
DataFrame code, plus ``label`` (multi-class) and ``y`` (0 normal / 1 attack).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import binarize, lenient_double
from .tables import read_table

# Fixed role assignments for the stand-in tables.
EVENT_NORMAL_TYPES = ["click", "purchase", "signup", "view"]
EVENT_NUMERIC = ["value", "k"]
LINEITEM_NORMAL_FLAG = "N"
LINEITEM_CATEGORICAL = ["l_linestatus", "ship_year"]
LINEITEM_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EMBEDDING_ATTACK_LABEL = 0        # one label of ten is the attack, the majority is normal
EMBEDDING_WIDTH = 64


@dataclass
class FlowTable:
    """A flow-record table with its column roles."""

    df: DataFrame
    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    label: str = "label"
    key: str = "row_id"
    vector: str | None = None


def event_flows(spark: SparkSession, sf_dir: str) -> FlowTable:
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type", "value", "props"])
    df = ev.select(
        F.col("event_id").alias("row_id"),
        F.col("event_type").alias("label"),
        binarize("event_type", EVENT_NORMAL_TYPES).alias("y"),
        F.col("value").cast("double").alias("value"),
        lenient_double(F.get_json_object("props", "$.k")).alias("k"),
    )
    return FlowTable(df, numeric=list(EVENT_NUMERIC))


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a line of text fields with the faults of the CIC files: infinities, NaN, junk, blanks and
    missing values, and a header line after each ``error`` event (``row_id, label, value, k``)."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type", "value", "props"])
    i = F.col("event_id")
    value = (F.when(i % 11 == 0, "Infinity").when(i % 13 == 0, "NaN").when(i % 17 == 0, "n/a").when(i % 19 == 0, F.lit(None))
             .when(i % 23 == 0, "-Infinity").otherwise(F.col("value").cast("string")))
    k = F.when(i % 7 == 0, "").otherwise(F.get_json_object("props", "$.k"))
    rows = ev.select(i.alias("row_id"), F.col("event_type").alias("label"), value.alias("value"), k.alias("k"))
    return rows.unionAll(ev.where("event_type = 'error'").select(i, F.lit("label"), F.lit("value"), F.lit("k")))


def lineitem_flows(spark: SparkSession, sf_dir: str) -> FlowTable:
    li = read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])
    df = li.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        F.col("l_returnflag").alias("label"),
        binarize("l_returnflag", LINEITEM_NORMAL_FLAG).alias("y"),
        F.col("l_linestatus"),
        F.year("l_shipdate").cast("string").alias("ship_year"),
        *[F.col(c).cast("double").alias(c) for c in LINEITEM_NUMERIC],
    )
    return FlowTable(df, numeric=list(LINEITEM_NUMERIC), categorical=list(LINEITEM_CATEGORICAL))


def embedding_vectors(spark: SparkSession, sf_dir: str) -> FlowTable:
    em = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    df = em.select(
        F.col("vec_id").alias("row_id"),
        F.col("label").cast("string").alias("label"),
        F.when(F.col("label") == EMBEDDING_ATTACK_LABEL, 1).otherwise(0).cast("int").alias("y"),
        F.col("embedding").cast("array<double>").alias("x"),
    )
    return FlowTable(df, numeric=[], vector="x")
