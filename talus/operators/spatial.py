"""Crops, point-in-polygon join, density and extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.geometry import is_box, ring_edges, strictly_inside


def crop_box(points: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """Axis-parallel box, bounds included."""
    return points.where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))


def extract_box(points: DataFrame, stages: list[str], dates: list, box: tuple[float, float, float, float]) -> DataFrame:
    """Points of one box in several stages and survey dates."""
    picked = points.where(F.col("stage").isin(*stages) & F.col("survey_date").isin(*dates))
    return crop_box(picked, *box)


def crop_polygon(points: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Points strictly inside one polygon; its bounding box goes to the scan as plain comparisons."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    vertices = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])
    boxed = crop_box(points, float(min(xs)), float(max(xs)), float(min(ys)), float(max(ys)))
    return boxed.where(strictly_inside(F.col("x"), F.col("y"), ring_edges(vertices)))


def below(points: DataFrame, zmax: float = 25.0) -> DataFrame:
    return points.where(F.col("z") < zmax)


def polygon_tiles(polys: DataFrame, cell: tuple[float, float | None], by: list[str]) -> DataFrame:
    """Polygons repeated for every grid key their bounding box touches."""
    ring = F.col("ring")
    boxes = polys.select(
        *by,
        "polygon_id",
        ring_edges(ring).alias("edges"),
        is_box(ring).alias("boxy"),
        *[
            fn(ring[axis]).alias(f"{axis}{name}")
            for axis in ("x", "y")
            for name, fn in (("min", F.array_min), ("max", F.array_max))
        ],
    )
    for axis, size in zip(("x", "y"), cell):
        if size is not None:
            span = F.sequence(F.floor(F.col(f"{axis}min") / size), F.floor(F.col(f"{axis}max") / size))
            boxes = boxes.withColumn(f"g{axis}", F.explode(span))
    return boxes


def points_in_polygons(
    points: DataFrame, polys: DataFrame, cell: tuple[float, float | None] = (1.0, None), by: list[str] = ("location",)
) -> DataFrame:
    """Points with the polygons they lie strictly inside of.

    A point on an edge matches nothing; overlapping polygons repeat the point.
    ``cell`` is the grid size in x and y; ``None`` leaves an axis out, which
    suits strips that span the whole survey.  The join is an equi-join on the
    grid key, so Catalyst broadcasts a polygon layer that is small enough and
    adaptive execution splits crowded keys otherwise.
    """
    by = list(by)
    tiles = polygon_tiles(polys, cell, by)
    keyed, keys = points, list(by)
    for axis, size in zip(("x", "y"), cell):
        if size is not None:
            keyed = keyed.withColumn(f"g{axis}", F.floor(F.col(axis) / F.lit(size)))
            keys.append(f"g{axis}")
    x, y = F.col("x"), F.col("y")
    in_box = (x > F.col("xmin")) & (x < F.col("xmax")) & (y > F.col("ymin")) & (y < F.col("ymax"))
    inside: Column = F.when(F.col("boxy"), F.lit(True)).otherwise(strictly_inside(x, y, F.col("edges")))
    return keyed.join(tiles, keys).where(in_box).where(inside).select(*points.columns, "polygon_id")


def point_density(
    points: DataFrame, by: list[str], cell: float = 1.0, origin: tuple[Column, Column] | None = None
) -> DataFrame:
    """Points per square metre of occupied cells."""
    x0, y0 = origin or (F.lit(0.0), F.lit(0.0))
    gx = F.floor((F.col("x") - x0) / cell).alias("gx")
    gy = F.floor((F.col("y") - y0) / cell).alias("gy")
    occupied = points.groupBy(*by, gx, gy).agg(F.count(F.lit(1)).alias("n"))
    return occupied.groupBy(*by).agg(
        F.sum("n").alias("points"),
        F.count(F.lit(1)).alias("occupied_cells"),
        (F.sum("n") / (F.count(F.lit(1)) * cell * cell)).alias("density"),
    )


def cloud_extent(points: DataFrame, by: list[str]) -> DataFrame:
    """Centroid and bounds."""
    fns = (("mean", F.avg), ("min", F.min), ("max", F.max))
    return points.groupBy(*by).agg(*[fn(a).alias(f"{a}_{name}") for a in ("x", "y", "z") for name, fn in fns])
