"""Joins and groupings that keep hot keys from landing in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_shares(counted: DataFrame, keys: list[str], weight: str, parts: int = 512, least: int = 256) -> tuple[int, DataFrame]:
    """``keys, shares`` of hot keys: more than 1/``parts`` of all rows that ``weight`` counts, and more than ``least``.

    There are fewer than ``parts`` of them whatever the tables' size, so they may be broadcast.
    Also returns the size of a share, in rows.
    """
    total = counted.agg(F.sum(weight)).first()[0] or 0
    share = max(least, total // parts)
    return share, counted.where(F.col(weight) > share).select(*keys, F.ceil(F.col(weight) / share).cast("int").alias("shares"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, spread: list[str]) -> DataFrame:
    """Inner join on ``keys``, unique in ``right``, whose ``weight`` counts the rows of ``left`` with that key.

    Rows of a hot key are dealt by a hash of ``spread``, and its row in ``right`` is repeated once per share.
    ``right`` should be a written table, as it is read three times; its ``weight`` is dropped.
    """
    share, hot = hot_shares(right, keys, weight)
    dealt = (left.join(F.broadcast(hot.withColumnRenamed("shares", "_shares")), keys, "left")
             .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_shares")).cast("int"), F.lit(0)))
             .drop("_shares"))
    shares = F.when(F.col(weight) > share, F.ceil(F.col(weight) / share)).otherwise(1).cast("int")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), shares - 1))).drop(weight)
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")
