"""Erosion events and interval volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions.naming import interval_days, interval_mid
from talus.functions.numeric import season
from talus.schema import INTERVAL

def cell_area():
    return F.col("resolution") * F.col("resolution")


def cluster_volumes(cells: DataFrame, by: list[str] = tuple(INTERVAL)) -> DataFrame:
    """Volume per cluster from its non-zero cells."""
    used = cells.where((F.col("cluster_id") > 0) & (F.col("dist") != 0))
    return used.groupBy(*by, "cluster_id").agg(F.sum(F.abs("dist") * cell_area()).alias("volume"))


def extract_events(cells: DataFrame) -> DataFrame:
    """One row per cluster and interval: volume, uncertainty, centroids and extent.

    Centroids are weighted by change; a cluster whose cells are all zero has
    none.  Polygon ids number the rows of the layer, so extents follow from
    their range.
    """
    w = F.abs(F.coalesce("dist", F.lit(0.0)))
    u = F.when(F.col("unc") > 0, F.col("unc")).otherwise(0.0)
    total = F.sum(w)

    def centre(col):
        return F.when(total > 0, F.sum(w * col) / total)

    def span(col):
        return (F.max(col) - F.min(col) + 1) * F.first("resolution")

    events = (
        cells.where(F.col("cluster_id") != 0)
        .groupBy(*INTERVAL, "cluster_id")
        .agg(
            F.sum(w * cell_area()).alias("volume"),
            F.sum(u * cell_area()).alias("vol_unc"),
            centre(F.col("z_low")).alias("elevation"),
            (centre(F.col("polygon_id")) * F.first("resolution")).alias("x_m"),
            span("polygon_id").alias("width"),
            span("z_idx").alias("height"),
        )
    )
    mid = interval_mid(F.col("d1"), F.col("d2"))
    return events.withColumn("mid", mid).withColumns(season(F.col("mid")))


def min_volume(events: DataFrame, v: float, strict: bool = False) -> DataFrame:
    return events.where(F.col("volume") > v if strict else F.col("volume") >= v)


def interval_volume(cells: DataFrame, by: list[str] = tuple(INTERVAL)) -> DataFrame:
    return cells.groupBy(*by).agg(F.sum(F.coalesce("dist", F.lit(0.0)) * cell_area()).alias("volume"))


def volume_bounds_cell(cells: DataFrame, by: list[str] = tuple(INTERVAL)) -> DataFrame:
    """Volume with each cell moved by its own uncertainty; the lower bound may be negative."""
    d, u = F.coalesce("dist", F.lit(0.0)), F.coalesce("unc", F.lit(0.0))
    return cells.groupBy(*by).agg(
        F.sum(d * cell_area()).alias("volume"),
        F.sum((d - u) * cell_area()).alias("vol_lower"),
        F.sum((d + u) * cell_area()).alias("vol_upper"),
    )


def volume_bounds_mean(cells: DataFrame, by: list[str] = tuple(INTERVAL)) -> DataFrame:
    """Volume with cells above 1 cm moved by the interval's mean positive uncertainty, not below zero."""
    by = list(by)
    mean_u = cells.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("unc") > 0, F.col("unc"))), F.lit(0.0)).alias("_u"))
    d = F.coalesce("dist", F.lit(0.0))
    moved = d > 0.01
    out = cells.join(mean_u, by).groupBy(*by).agg(
        F.sum(d * cell_area()).alias("volume"),
        F.sum(F.when(moved, F.greatest(d - F.col("_u"), F.lit(0.0))).otherwise(d) * cell_area()).alias("vol_lower"),
        F.sum(F.when(moved, d + F.col("_u")).otherwise(d) * cell_area()).alias("vol_upper"),
    )
    return out.withColumns({"days": interval_days(F.col("d1"), F.col("d2"))}) if {"d1", "d2"} <= set(by) else out


def cluster_uncertainty(raw: DataFrame, by: list[str] = tuple(INTERVAL)) -> DataFrame:
    """Systematic volume uncertainty: cell uncertainties of a cluster add up."""
    used = raw.where((F.col("cluster_id") > 0) & F.col("unc").isNotNull() & ~F.isnan("unc"))
    return used.groupBy(*by, "cluster_id").agg(F.sum(F.col("unc") * cell_area()).alias("vol_unc"))


def cell_uncertainty(raw: DataFrame) -> DataFrame:
    """Cells with a usable uncertainty."""
    u = F.col("unc")
    return raw.where(u.isNotNull() & ~F.isnan(u) & (u > 1e-6) & (u < float("inf")))


def event_count(cells: DataFrame, by: list[str] = tuple(INTERVAL)) -> DataFrame:
    """Distinct clusters per interval; 0 when there is none."""
    per = cells.groupBy(*by, "cluster_id").agg(F.lit(1).alias("_one"))
    return per.groupBy(*by).agg(F.count_if(F.col("cluster_id") != 0).alias("events"))


def blank_intervals(volumes: DataFrame) -> DataFrame:
    """Intervals without any volume."""
    return volumes.where(F.col("volume") == 0).withColumn("reason", F.lit("Zero Volume"))


def fill_stats(cleaned: DataFrame, filled: DataFrame, min_volume: float, by: list[str] = tuple(INTERVAL)) -> DataFrame:
    """Volumes before and after filling, cells filled and clusters treated, per interval.

    Both inputs must be dense: the empty cells of ``cleaned`` are the holes.
    """
    by = list(by)
    keys = by + ["polygon_id", "z_idx"]
    before = cleaned.select(*keys, F.coalesce("dist", F.lit(0.0)).alias("_b"))
    both = before.join(filled.select(*keys, F.coalesce("dist", F.lit(0.0)).alias("_a")), keys, "left")
    b, a = F.col("_b"), F.coalesce("_a", F.col("_b"))
    cells = both.groupBy(*by).agg(
        F.sum(F.abs(b) * cell_area()).alias("original_volume"),
        F.sum(F.abs(a) * cell_area()).alias("filled_volume"),
        F.count_if((b == 0) & (a != 0)).alias("holes_filled"),
        F.count_if(b == 0).alias("holes"),
    )
    clusters = cluster_volumes(cleaned, by).groupBy(*by).agg(
        F.count_if(F.col("volume") >= min_volume).alias("clusters_processed"),
        F.count_if(F.col("volume") < min_volume).alias("clusters_skipped"),
    )
    pct = F.when(F.col("holes") > 0, F.col("holes_filled") / F.col("holes") * 100).otherwise(0.0)
    return (
        cells.join(clusters, by, "left")
        .na.fill(0, ["clusters_processed", "clusters_skipped"])
        .withColumns({"volume_change": F.col("filled_volume") - F.col("original_volume"), "fill_pct": pct})
    )
