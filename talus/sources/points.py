"""Point tables and LAS ingest."""

from __future__ import annotations

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions import las_records
from talus.functions.naming import file_meta
from talus.sources import las

for _module in (las_records, las):
    cloudpickle.register_pickle_by_value(_module)

COLUMNS = ["x", "y", "z", "intensity"]
CHUNK = 1_000_000


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_points(points: DataFrame, path: str, partitions: tuple[str, ...] = ("location", "survey_date")) -> None:
    """All columns, partitioned; only the partitions present are replaced."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def las_headers(files: DataFrame) -> DataFrame:
    """Point count, offsets and extra columns of each file (``path``); unreadable files carry an error."""

    def scan(batches):
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    with las.opened(path) as f:
                        h = las_records.read_header(f)
                    rows.append((path, h["count"], *h["offset"], [e[0] for e in h["extra"]], None))
                except (OSError, ValueError) as e:
                    rows.append((path, None, None, None, None, None, str(e)))
            frame = pd.DataFrame(rows, columns=["path", "points", "x_offset", "y_offset", "z_offset", "extra", "error"])
            yield frame.astype({"points": "Int64"})

    schema = "path string, points long, x_offset double, y_offset double, z_offset double, extra array<string>, error string"
    # every file is one small read: spread them over all tasks
    return files.select("path").repartition("path").mapInPandas(scan, schema)


def point_file_stats(files: DataFrame) -> DataFrame:
    """Header-only scan with file sizes (``path``, ``length``)."""
    return file_meta(las_headers(files).join(files.select("path", "length"), "path"))


def read_las(files: DataFrame, columns: list[str] = COLUMNS, chunk: int = CHUNK) -> DataFrame:
    """Points of all files, decoded in record ranges so that one large file feeds many tasks."""
    wanted = list(columns)

    def decode(batches):
        for batch in batches:
            for path, first, n in zip(batch["path"], batch["first"], batch["n"]):
                with las.opened(path) as f:
                    cols = las_records.read_range(f, las_records.read_header(f), first, n, wanted)
                yield pd.DataFrame({"path": path, **cols})

    heads = las_headers(files).where(F.col("points") > 0)
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("points") - 1, F.lit(chunk).cast("long")))
    ranges = heads.select("path", "points", first.alias("first"))
    ranges = ranges.select("path", "first", F.least(F.lit(chunk), F.col("points") - F.col("first")).alias("n"))
    schema = "path string, point_id long, " + ", ".join(f"`{c}` double" for c in wanted)
    return ranges.repartition("path", "first").mapInPandas(decode, schema)


def points_per_survey(points: DataFrame) -> DataFrame:
    return points.groupBy("location", "survey_date").agg(F.count(F.lit(1)).alias("points"))
