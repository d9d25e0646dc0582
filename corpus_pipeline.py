"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

toxicity -> language ID -> near duplicates -> benchmark decontamination -> packing.  Every stage
works on all rows that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsentry.llm import decontam, langid, neardup, packing, toxicity
from flowsentry.llm.common import read_documents, scratch
from flowsentry.session import ensure_checkpoint_dir, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity scorer rejects go."""
    return toxicity.keep_clean(docs, read_documents(spark, sf_dir, "labels"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a recognisable language, or clearly in another than the declared one, go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark window go."""
    return decontam.decontaminate(docs, read_documents(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their places in the sequences."""
    return packing.pack(docs)


def _prepared(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return stage(spark, docs, sf_dir)
    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


STAGES = [
    ("toxicity", _prepared(drop_toxic)),
    ("language_id", _prepared(keep_languages)),
    ("near_duplicates", _prepared(drop_near_duplicates)),
    ("decontamination", _prepared(drop_contaminated)),
    ("packing", _prepared(pack_sequences)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result is written before the next stage reads it."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: the fitted and iterative stages have no SQL form; tests/llm holds run() against a brute-force version
ORACLE_SQL = None
