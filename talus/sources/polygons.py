"""Polygon layers, crop polygons and transect lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions.geometry import extend_line, to_utm


def read_polygons(spark: SparkSession, path: str, location: str, resolution: str) -> DataFrame:
    """GeoJSON feature collection; polygon ids number the features in file order, outer rings only."""
    schema = "features array<struct<geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
    layer = spark.read.schema(schema).json(path, multiLine=True)
    each = layer.select(F.posexplode("features").alias("pos", "f"))
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return each.select(
        F.lit(location).alias("location"),
        F.lit(resolution).alias("resolution"),
        F.col("pos").cast("long").alias("polygon_id"),
        ring.alias("ring"),
    )


def select_layer(polygons: DataFrame, location: str, resolution: str) -> DataFrame:
    """Layer of one site and resolution, names compared without case."""
    return polygons.where(
        (F.lower("location") == location.lower()) & F.lower("resolution").contains(resolution.lower())
    )


def read_ring_text(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """Crop polygon from lines ``x y 0.0``: a handful of vertices that parametrise a crop."""
    whole = spark.read.option("wholetext", True).text(path)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select("line", parts[0].cast("double").alias("x"), parts[1].cast("double").alias("y"))
    return [(r.x, r.y) for r in rows.orderBy("line").collect()]


def write_ring_text(spark: SparkSession, ring: list[tuple[float, float]], path: str) -> None:
    lines = spark.createDataFrame([(f"{x:.6f} {y:.6f} 0.0",) for x, y in ring], "value string")
    lines.coalesce(1).write.mode("overwrite").text(path)


def read_mop_lines(spark: SparkSession, path: str) -> DataFrame:
    """Transects from KML placemarks ``MOP_<n>`` with two ``lon,lat,alt`` vertices."""
    schema = "name string, LineString struct<coordinates: string>"
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    vertices = F.split(F.trim(F.col("LineString.coordinates")), r"\s+")

    def number(vertex: int, part: int) -> Column:
        return F.get(F.split(F.get(vertices, F.lit(vertex)), ","), F.lit(part)).try_cast("double")

    lines = marks.select(
        F.regexp_extract(F.trim("name"), r"^MOP_(\d+)", 1).try_cast("int").alias("mop"),
        number(0, 0).alias("lon1"),
        number(0, 1).alias("lat1"),
        number(1, 0).alias("lon2"),
        number(1, 1).alias("lat2"),
    )
    return lines.na.drop()


def transect_quad(lines: DataFrame, lo: int, hi: int, along: float, zone: int = 11) -> DataFrame:
    """One row with the crop polygon between two transects, lengthened at both ends."""
    used = lines.where(F.col("mop").isin(lo, hi)).select(
        "mop",
        to_utm(F.col("lon1"), F.col("lat1"), zone).alias("p"),
        to_utm(F.col("lon2"), F.col("lat2"), zone).alias("q"),
    )
    p, q = extend_line(F.col("p"), F.col("q"), along)
    ends = used.select("mop", F.struct(p.alias("p"), q.alias("q")).alias("s"))
    both = ends.agg(
        F.first(F.when(F.col("mop") == lo, F.col("s")), ignorenulls=True).alias("a"),
        F.first(F.when(F.col("mop") == hi, F.col("s")), ignorenulls=True).alias("b"),
    )
    missing = F.col("a").isNull() | F.col("b").isNull()
    error = F.raise_error(F.lit(f"transect {lo} or {hi} is not among the lines"))
    ring = F.array(F.col("a.p"), F.col("a.q"), F.col("b.q"), F.col("b.p"))
    return both.select(F.when(missing, error.cast(ring_type())).otherwise(ring).alias("ring"))


def ring_type() -> str:
    return "array<struct<x: double, y: double>>"
