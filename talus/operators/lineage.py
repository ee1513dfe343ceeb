"""Materialising intermediate tables of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """Reliable checkpoint folder: the one the session names, a scratch one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = sc.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession) -> str:
    """A new place in the checkpoint folder, which all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/talus-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute once, store as a table in the checkpoint folder and go on from there.

    A stored table survives lost executors, ends the lineage, and gives the
    rest of the plan true sizes and column pruning.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by their keys over all cores, for work that is much for its bytes.

    Adaptive execution merges small shuffle partitions by their bytes alone, so
    rows that are about to be multiplied, or to keep Python busy, end up in one
    task. It leaves partitions alone whose number has been asked for.
    """
    spark = df.sparkSession
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(asked, 3 * spark.sparkContext.defaultParallelism), *keys)
