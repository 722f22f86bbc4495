"""The corpus pipeline: language, near duplicates, repeated passages, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from furlong.llm.common import read, staged
from furlong.llm.stages import STAGES  # noqa: F401

# SQL has no conditional random field and no transducer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
