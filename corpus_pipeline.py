"""The corpus pipeline: every stage reads what the one before it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talus.llm.stages import STAGES, run_stages

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: Naive Bayes, BPE and the packing order have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that come through all stages."""
    return run_stages(spark, sf_dir, STAGES)
