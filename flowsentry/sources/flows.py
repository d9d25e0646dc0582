"""Flow-record CSV sources and table sinks (S-1..S-5, K-1).

Schemas are declared, never inferred: inference scans the data twice and,
on the CIC files, mixes types when a header line reappears as data.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clean_double

# NSL-KDD column names in file order (41 features, label, difficulty).
NSL_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes",
    "land", "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in",
    "num_compromised", "root_shell", "su_attempted", "num_root", "num_file_creations",
    "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login",
    "count", "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
    "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count",
    "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate",
    "dst_host_serror_rate", "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
    "label", "difficulty",
]
NSL_CATEGORICAL = ["protocol_type", "service", "flag"]
NSL_NORMAL = "normal"
CIC_NORMAL = "BENIGN"
CIC_HEADER_LABEL = "Label"
_BAD, _WHY = "_bad_record", "_set_aside"
REPLACEMENT_CHAR = "�"


def nsl_schema() -> T.StructType:
    fields = []
    for c in NSL_COLUMNS:
        if c in NSL_CATEGORICAL or c == "label":
            fields.append(T.StructField(c, T.StringType()))
        elif c == "difficulty":
            fields.append(T.StructField(c, T.IntegerType()))
        else:
            fields.append(T.StructField(c, T.DoubleType()))
    return T.StructType(fields)


def nsl_feature_columns() -> tuple[list[str], list[str]]:
    """P-2: (numeric, categorical) feature lists; label and difficulty are not features."""
    num = [c for c in NSL_COLUMNS if c not in NSL_CATEGORICAL + ["label", "difficulty"]]
    return num, list(NSL_CATEGORICAL)


def read_nsl(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """S-1 / S-2 / S-3: headerless CSV with fixed names, leading blanks trimmed.

    Malformed numbers become NULL (PERMISSIVE) and are later filled by P-4.
    """
    return (spark.read.schema(nsl_schema()).option("header", False).option("ignoreLeadingWhiteSpace", True)
            .option("mode", "PERMISSIVE").csv(paths if isinstance(paths, str) else list(paths)))


def normalise_name(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def unique_names(header: Sequence[str], label_col: str = "label") -> list[str]:
    """Normalised column names of one file; repeated ones get a number, an unnamed label is the last column."""
    names, seen = [], {}
    for raw in header:
        name = normalise_name(raw) or "column"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    if label_col not in names:
        names[-1] = label_col
    return names


def _files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The data files under ``paths``, as Spark lists them."""
    return sorted(spark.read.format("text").load(list(paths)).inputFiles())


@dataclass
class Merged:
    """S-5: cleaned rows of all files, what was set aside, and the shape of each file."""

    rows: DataFrame
    quarantine: DataFrame
    shapes: DataFrame


def read_merged(spark: SparkSession, paths: str | Sequence[str], label_col: str = "label") -> Merged:
    """S-4 / S-5: headed CSV files merged by column name.

    Every file is read under its own header, so files may order their columns differently or miss some;
    a missing column is missing data.  Names are normalised, numerics are cleaned (``Infinity``, ``NaN`` and junk
    become 0, P-4/P-6/P-7) and the broken dash in attack names is repaired.  Rows with too few or too
    many fields go to ``quarantine`` (``source_file, reason, record``) as ``malformed``, header
    lines that reappear as data (P-8) as ``header``: rows and quarantine together are all lines.
    """
    by_header: dict[tuple, list[str]] = {}
    for f in _files(spark, [paths] if isinstance(paths, str) else paths):
        first = spark.read.text(f).head()       # only the first line is read
        if first is not None:
            by_header.setdefault(tuple(next(csv.reader([first[0]]))), []).append(f)
    parts = []
    for header, files in by_header.items():
        names = unique_names(header, label_col)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names] + [T.StructField(_BAD, T.StringType())])
        raw = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", _BAD).option("ignoreLeadingWhiteSpace", True)
               .option("ignoreTrailingWhiteSpace", True).csv(files))
        repeats = F.lit(True)
        for name, title in zip(names, header):
            repeats = repeats & F.trim(F.coalesce(F.col(name), F.lit(""))).eqNullSafe(F.lit(title.strip()))
        cells = F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in names])
        why = F.when(F.col(_BAD).isNotNull(), "malformed").when(repeats, "header")
        parts.append(raw.select(*names, F.col("_metadata.file_name").alias("source_file"), why.alias(_WHY),
                                F.coalesce(F.col(_BAD), cells).alias(_BAD)))
    if not parts:
        none = spark.createDataFrame([], f"{label_col} string, source_file string")
        return Merged(none, spark.createDataFrame([], "source_file string, reason string, record string"),
                      spark.createDataFrame([], "source_file string, n_rows long, n_bad long, n_cols int"))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    feats = [c for c in every.columns if c not in (label_col, "source_file", _WHY, _BAD)]
    label = F.regexp_replace(F.trim(F.col(label_col)), REPLACEMENT_CHAR, "-")
    rows = (every.where(F.col(_WHY).isNull())
            .select(*[clean_double(c).alias(c) for c in feats], label.alias(label_col), "source_file"))
    bad = every.where(F.col(_WHY).isNotNull()).select("source_file", F.col(_WHY).alias("reason"), F.col(_BAD).alias("record"))
    shapes = every.groupBy("source_file").agg(F.count_if(F.col(_WHY).isNull()).alias("n_rows"),
                                              F.count_if(F.col(_WHY).isNotNull()).alias("n_bad"))
    return Merged(rows, bad, shapes.withColumn("n_cols", F.lit(len(feats) + 1)))


def read_cic(spark: SparkSession, paths: str | Sequence[str], label_col: str = "label") -> DataFrame:
    """S-4: the cleaned rows of headed CIC-IDS2017 CSV(s)."""
    return read_merged(spark, paths, label_col).rows


def merge_sources(spark: SparkSession, paths: Sequence[str], label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """S-5: ``(merged, shapes)`` of daily files; shapes = ``(source_file, n_rows, n_bad, n_cols)``."""
    got = read_merged(spark, list(paths), label_col)
    return got.rows, got.shapes


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """K-1: Parquet, optionally partitioned (day / label) so later scans prune."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
