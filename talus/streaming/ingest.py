"""Incremental survey arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from talus.operators.inventory import new_surveys, surveys_for_locations, with_parsed_name
from talus.sources.surveys import _below_roots

FILES = "path string, modificationTime timestamp, length bigint, content binary"
TABLE = "location string, survey_date date, mop1 int, mop2 int, method string, folder string, batch bigint"


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """The survey table; empty before the first batch. Any other failure to read is raised."""
    try:
        return spark.read.schema(TABLE).parquet(table)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TABLE)


def merge_stream(files: DataFrame, table: str, checkpoint: str, late: str = "drop"):
    """Merge a stream of survey files (``folder``, ``filename``, ``method``) into the survey table, then stop.

    A batch is its own partition of the table and is compared with the other
    batches only, so a replayed batch replaces itself.
    """
    spark = files.sparkSession

    def merge(arrived: DataFrame, batch: int) -> None:
        found = with_parsed_name(arrived.select("folder", "filename", "method"))
        located = surveys_for_locations(found, floor_threshold=False)
        names = located.select("folder", "filename").distinct()
        existing = read_table(spark, table).where(F.col("batch") != batch)
        surveys = located.drop("filename").distinct()
        fresh = new_surveys(existing, surveys, names, late)
        rows = fresh.select("location", "survey_date", "mop1", "mop2", "method", "folder", F.lit(batch).alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    query = (
        files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def ingest_surveys(spark: SparkSession, roots: dict[str, str], table: str, checkpoint: str, late: str = "drop"):
    """Add the surveys whose files arrived since the last run; returns the finished query.

    The stream's checkpoint remembers which files were seen.
    """
    # the common parent is watched; folders outside the roots are left out by name
    parent = _common_parent(list(roots.values()))
    stream = (
        spark.readStream.format("binaryFile")
        .schema(FILES)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.las")
        .load(parent)
        .select(F.regexp_replace("path", r"^file:/+", "/").alias("path"))
    )
    return merge_stream(_below_roots(stream, roots), table, checkpoint, late)


def _common_parent(paths: list[str]) -> str:
    parts = [p.rstrip("/").split("/") for p in paths]
    shared = []
    for level in zip(*parts):
        if len(set(level)) > 1:
            break
        shared.append(level[0])
    return "/".join(shared) or "/"
