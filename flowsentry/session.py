"""Spark session helpers.

Cluster jobs get their session (and its ``spark.checkpoint.dir``) from the
launcher; the helpers here only fill in what is unset, which in practice
means local test and bench sessions.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "flowsentry") -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        ship_package(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    builder = builder.config("spark.driver.memory", os.environ.get("FLOWSENTRY_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint directory of the session.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``.
    Only a local-mode session without one gets a private temp folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local_dir = tempfile.mkdtemp(prefix="flowsentry-ckpt-")
    sc.setCheckpointDir(local_dir)
    return local_dir


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the session checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def partition_rows(df) -> tuple[int, int]:
    """Rows of the largest partition, and of all."""
    from pyspark.sql import functions as F

    row = df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    return row[0] or 0, row[1] or 0


def deal_evenly(df, least: int = 4096):
    """``df`` with its rows dealt to all cores, if they lie in few of many partitions (``least`` rows or fewer may stay together)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    fullest, rows = partition_rows(df)
    return df.repartition(cores) if fullest > least and fullest * cores > 2 * rows else df


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``flowsentry`` importable on the Python workers (what ``--py-files`` does).

    Pandas UDFs and broadcast fitted state reference this package; when the
    job is not launched with it on the executors' path, a zip of the package
    is added to the context once (Spark serves it to every executor).
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="flowsentry-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(key)
