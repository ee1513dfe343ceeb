"""Survey folders, survey lists and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions.naming import base_name, leading_date
from talus.operators.inventory import with_parsed_name
from talus.schema import SURVEY_CSV


def list_survey_files(spark: SparkSession, roots: dict[str, str], pattern: str = "*.las") -> DataFrame:
    """Files below instrument roots (label -> folder) whose survey folder follows the naming rule.

    Only names and sizes are listed; file contents are not read.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(list(roots.values()))
        .select("path", "length", "modificationTime")
    )
    plain = F.regexp_replace("path", r"^file:/+", "/")
    return with_parsed_name(_below_roots(listed.withColumn("path", plain), roots))


def _below_roots(files: DataFrame, roots: dict[str, str]) -> DataFrame:
    label, folder = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, root in roots.items():
        prefix = root.rstrip("/") + "/"
        here = F.col("path").startswith(prefix)
        rest = F.col("path").substr(F.lit(len(prefix) + 1), F.length("path"))
        label = F.when(here, F.lit(name)).otherwise(label)
        folder = F.when(here, F.split(rest, "/")[0]).otherwise(folder)
    named = files.withColumns({"method": label, "folder": folder, "filename": base_name(F.col("path"))})
    return named.where(F.col("folder").isNotNull())


def read_surveys(spark: SparkSession, path: str) -> DataFrame:
    """Survey list CSV; the path column may hold a folder name or a full path."""
    raw = spark.read.schema(SURVEY_CSV).csv(path, header=True)
    return raw.select(
        F.col("beach").alias("location"),
        leading_date(F.col("date")).alias("survey_date"),
        F.col("MOP1").alias("mop1"),
        F.col("MOP2").alias("mop2"),
        "method",
        base_name(F.col("path")).alias("folder"),
    )


def write_surveys(surveys: DataFrame, path: str) -> None:
    """Survey list CSV in date order, one folder per site."""
    rows = surveys.select(
        F.col("folder").alias("path"),
        F.date_format("survey_date", "yyyyMMdd").alias("date"),
        F.col("mop1").alias("MOP1"),
        F.col("mop2").alias("MOP2"),
        F.col("location").alias("beach"),
        "method",
    )
    rows.orderBy("date", "path").write.mode("overwrite").csv(path, header=True)


def write_report(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").csv(path, header=True)


def write_metrics_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
