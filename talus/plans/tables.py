"""The driver's relational tables seen as survey data.

Plain projections, so a change cloud of any size follows from ``lineitem``,
a survey list from ``orders`` and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITE = "DelMar"  # every part, and so every strip and point, belongs to one site
SITES = ["DelMar", "Solana", "Encinitas", "SanElijo", "Torrey", "Blacks"]
METHODS = ["VMZ2000_Truck", "MiniRanger_Truck", "VMQLZ_Truck", "MiniRanger_ATV"]
ROOTS = ["/archive/level2", "/archive/level1"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names: list[str], index: str) -> str:
    return "element_at(array(" + ", ".join(f"'{n}'" for n in names) + f"), cast({index} as int) + 1)"


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey folders with date, transects and instrument."""
    return surveys_of(table(spark, sf_dir, "orders"))


def surveys_of(orders: DataFrame) -> DataFrame:
    base = orders.selectExpr(
        "o_orderkey AS survey_id",
        "cast(o_orderdate AS date) AS survey_date",
        "cast(500 + o_custkey % 250 AS int) AS mop1",
        "cast(510 + o_custkey % 250 + o_orderkey % 60 AS int) AS mop2",
        _pick(METHODS, "o_orderkey % 4") + " AS method",
    )
    return base.withColumn(
        "folder", F.concat_ws("_", F.date_format("survey_date", "yyyyMMdd"), "mop1", "mop2", "survey_id")
    )


def survey_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two files per survey folder, under one of two roots; a fifth of the folders lack the target file."""
    return survey_files_of(surveys(spark, sf_dir))


def survey_files_of(s: DataFrame) -> DataFrame:
    suffix = F.when(F.col("survey_id") % 5 == 0, "_other.las").otherwise("_beach_cliff_ground.las")
    copies = F.explode(
        F.when(F.col("survey_id") % 3 == 0, F.array(*map(F.lit, ROOTS))).otherwise(
            F.array(F.when(F.col("survey_id") % 2 == 0, F.lit(ROOTS[0])).otherwise(F.lit(ROOTS[1])))
        )
    )
    named = s.select("survey_id", "folder", "method", F.concat("folder", suffix).alias("filename"), copies.alias("root"))
    return named.withColumn("path", F.concat_ws("/", "root", "folder", "filename"))


RECORD = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "cast(round(l_extendedprice * 100) AS bigint), date_format(l_shipdate, 'yyyyMMdd'))"
)
RECORD_ID = f"cast(conv(substr(md5({RECORD}), 1, 15), 16, 10) AS bigint) AS point_id"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point cloud; the record id is derived from all columns that tell two records apart."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        RECORD_ID,
        f"'{SITE}' AS location",
        "cast(date_trunc('quarter', l_shipdate) AS date) AS survey_date",
        "l_partkey * 0.05D + 0.0125D AS x",
        "l_suppkey * 0.01D AS y",
        "l_quantity * 0.5D + l_linenumber * 0.07D AS z",
        "l_extendedprice AS intensity",
        "l_returnflag AS sensor",
        "cast(CASE WHEN (l_quantity * 0.5D + l_linenumber * 0.07D < 6) <> (l_orderkey % 50 = 0) THEN 1 ELSE 0 END AS int)"
        " AS label",
    )


def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered change cloud between consecutive quarters."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        RECORD_ID,
        f"'{SITE}' AS location",
        "cast(date_trunc('quarter', l_shipdate) AS date) AS d1",
        "cast(add_months(date_trunc('quarter', l_shipdate), 3) AS date) AS d2",
        "l_partkey * 0.05D + 0.0125D AS x",
        "l_suppkey * 0.01D AS y",
        "l_quantity * 0.5D + l_linenumber * 0.07D AS z",
        "(l_discount - 0.05D) * 10D AS m3c2",
        "l_tax AS uncertainty",
        "l_linestatus = 'F' AS significant",
        "cast(l_suppkey % 40 - 1 AS int) AS cluster_id",
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alongshore strips one metre wide."""
    ids = table(spark, sf_dir, "part").select(
        F.expr("p_partkey div 20").alias("polygon_id"), F.lit(SITE).alias("location")
    ).distinct()
    corner = lambda dx, y: f"named_struct('x', cast(polygon_id + {dx} AS double), 'y', cast({y} AS double))"
    ring = f"array({corner(0, -1)}, {corner(1, -1)}, {corner(1, 1000)}, {corner(0, 1000)})"
    return ids.selectExpr("location", "polygon_id", f"{ring} AS ring")


def cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cliff tops; every seventh polygon has none."""
    return (
        polygons(spark, sf_dir)
        .where("polygon_id % 7 <> 0")
        .selectExpr("location", "polygon_id", "cast(15 + polygon_id % 10 AS double) AS cliff_top_z")
    )


def cloud3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloud with unique ids and moderate neighbour counts."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS point_id",
        "user_id * 0.2D AS x",
        "(event_id % 97) * 0.05D AS y",
        "least(value, 50D) AS z",
    )


def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-file job metrics."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("points"),
            (F.sum("l_extendedprice") / 1048576).alias("size_mb"),
            (F.sum("l_quantity") / 10).alias("duration"),
            F.min("l_shipdate").cast("date").alias("survey_date"),
        )
        .selectExpr(
            "l_orderkey AS file_id",
            _pick(SITES, "l_orderkey % 6") + " AS location",
            "CASE l_orderkey % 10 WHEN 0 THEN 'Skipped' WHEN 1 THEN 'Error' ELSE 'Success' END AS status",
            "points",
            "size_mb",
            "duration",
            "survey_date",
        )
    )


def stage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point counts of three processing stages per survey, with a second, longer-named file for some."""
    rows = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").cast("long").alias("cropped"),
            F.sum(F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).otherwise(0)).cast("long").alias("nobeach"),
            F.sum(F.when(F.col("l_linenumber") > 2, F.col("l_quantity") + 3).otherwise(0)).cast("long").alias("noveg"),
            F.min("l_shipdate").cast("date").alias("survey_date"),
        )
    )
    long = rows.unpivot(["l_orderkey", "survey_date"], ["cropped", "nobeach", "noveg"], "stage", "points")
    tag = F.when(F.col("l_orderkey") % 4 == 0, F.array(F.lit(""), F.lit("_v2"))).otherwise(F.array(F.lit("")))
    return long.select(
        F.col("l_orderkey").alias("file_id"),
        F.expr(_pick(SITES, "l_orderkey % 6")).alias("location"),
        "survey_date",
        "stage",
        F.explode(tag).alias("tag"),
        "points",
    ).selectExpr(
        "location",
        "survey_date",
        "file_id",
        "stage",
        "concat(file_id, '_', stage, tag, '.las') AS filename",
        "points + length(tag) AS points",
    )
