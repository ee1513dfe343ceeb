"""Grids as wide CSV files and cliff-top tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from talus.functions.naming import base_name, parse_interval, resolution_metres
from talus.operators.grid import to_long, to_wide

PREFIX = {"dist": "M3C2", "cluster_id": "ClusterID", "unc": "Uncertainty"}
FOLDERS = ["location", "mode", "d1", "d2"]
KIND = {"dist": "grid", "cluster_id": "clusters", "unc": "uncertainty"}


def read_grid_csv(spark: SparkSession, paths: str | list[str], kind: str, res: float) -> DataFrame:
    """Cells of wide CSV files of one resolution.

    ``kind`` is ``dist``, ``cluster_id`` or ``unc``.  Interval, sign, stage and
    resolution come from the file name; of a folder that ``write_grid_csv`` has
    made, site, sign and interval come from the names of the folders in it.
    """
    wide = spark.read.option("header", True).option("nanValue", "NaN").csv(paths)
    first = wide.columns[0]
    if set(FOLDERS) <= set(wide.columns):
        long = to_long(wide, [*FOLDERS, first], res, kind)
        value = F.col(kind).try_cast("int" if kind == "cluster_id" else "double")
        return long.select(
            "location",
            "mode",
            F.col("d1").cast("date").alias("d1"),
            F.col("d2").cast("date").alias("d2"),
            F.lit(float(res)).alias("resolution"),
            F.col(f"`{first}`").cast("double").cast("long").alias("polygon_id"),
            "z_idx",
            "z_low",
            value.alias(kind),
        )
    name = base_name(F.col("_metadata.file_path"))
    keyed = wide.select("*", name.alias("_file"))
    ids = ["_file", first]
    long = to_long(keyed, ids, res, kind)
    value = F.nanvl(F.col(kind).try_cast("double"), F.lit(None).cast("double"))
    file = F.col("_file")
    stage = F.regexp_extract(file, r"_(cleaned|filled)\.csv$", 1)
    interval = parse_interval(file)
    return long.select(
        F.when(file.contains("dep_"), "deposition").otherwise("erosion").alias("mode"),
        interval["d1"].alias("d1"),
        interval["d2"].alias("d2"),
        resolution_metres(F.regexp_extract(file, r"_(\d+(?:cm|m))(?:_|\.)", 1)).alias("resolution"),
        F.when(stage != "", stage).otherwise("raw").alias("stage"),
        F.col(f"`{first}`").cast("double").cast("long").alias("polygon_id"),
        "z_idx",
        "z_low",
        (value.cast("int") if kind == "cluster_id" else value).alias(kind),
    )


def write_grid_csv(dense: DataFrame, path: str, kind: str, res: float, height: float, six_digits: bool = True) -> None:
    """Wide CSV of exact shape below ``location/mode/d1/d2``; values with six significant digits."""
    ids = FOLDERS
    out = dense
    if six_digits and kind != "cluster_id":
        out = dense.withColumn(kind, F.format_string("%.6g", F.col(kind)).try_cast("double"))
    wide = to_wide(out, kind, res, height, PREFIX[kind], ids).withColumnRenamed("polygon_id", "Polygon_ID")
    wide.repartition(*ids).sortWithinPartitions(*ids, "Polygon_ID").write.mode("overwrite").partitionBy(*ids).csv(
        path, header=True
    )


def read_cutoffs(spark: SparkSession, candidates: list[str], location: str) -> DataFrame | None:
    """Cliff tops from the first candidate that exists; ``None`` when none does."""
    for path in candidates:
        try:
            raw = spark.read.csv(path, header=True)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        return raw.select(
            F.lit(location).alias("location"),
            F.col("Polygon_ID").cast("double").cast("long").alias("polygon_id"),
            F.col("CliffTop_Z").try_cast("double").alias("cliff_top_z"),
        )
    return None
