"""From change points to grid cells: filters, gridding, cleaning, stacking.

Cells are kept in long form, one row per interval, polygon and elevation bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.config import MIN_CHANGE, NO_CUTOFF, bin_count
from talus.functions.numeric import z_bin, z_low
from talus.operators.lineage import cut, spread
from talus.operators.ranks import quantiles
from talus.schema import CELL, INTERVAL

HOT_CELL = 1_000_000
SALTS = 64
STAGES = ("filled", "cleaned", "raw")


def significant_changes(points: DataFrame, min_change: float = MIN_CHANGE) -> DataFrame:
    """Significant points of at least the given change; without a significance column all pass it."""
    out = points.where(F.abs("m3c2") >= min_change) if min_change > 0 else points
    return out.where("significant") if "significant" in points.columns else out


def split_mode(points: DataFrame) -> DataFrame:
    """Loss is erosion, gain deposition; an exact zero is neither."""
    mode = F.when(F.col("m3c2") < 0, "erosion").when(F.col("m3c2") > 0, "deposition")
    return points.where(F.col("m3c2") != 0).withColumn("mode", mode)


def clustered_only(points: DataFrame) -> DataFrame:
    """Points that are not noise, with the size of their change."""
    return points.where(F.col("cluster_id") != -1).withColumn("m3c2", F.abs("m3c2"))


def grid_cells(
    joined: DataFrame, res: float, height: float, by: list[str] = ("location", "mode", "d1", "d2"), hot_cell: int = HOT_CELL
) -> DataFrame:
    """Median change, most frequent cluster (least on ties) and RMS uncertainty per cell.

    ``joined`` are clustered points with their ``polygon_id``.  Ordinary cells
    take one hash aggregation.  A cell too large for one aggregation buffer is
    found by a count and goes through distributed ranks instead.
    """
    by = list(by)
    keys = by + ["polygon_id", "z_idx"]
    binned = joined.select(
        *by,
        "polygon_id",
        z_bin(F.col("z"), res, height).alias("z_idx"),
        F.abs("m3c2").alias("m3c2"),
        "cluster_id",
        "uncertainty",
    ).where(F.col("z_idx").isNotNull())

    sizes = binned.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0]
    ordinary, crowded = binned, None
    if (largest or 0) > hot_cell:
        hot = cut(sizes.where(F.col("_n") > hot_cell).select(*keys))
        ordinary = binned.join(hot, keys, "left_anti")
        crowded = binned.join(hot, keys, "left_semi")
    cells = ordinary.groupBy(*keys).agg(
        F.median("m3c2").alias("dist"),
        F.mode("cluster_id", True).alias("cluster_id"),
        F.sqrt(F.avg(F.col("uncertainty") * F.col("uncertainty"))).alias("unc"),
        F.count(F.lit(1)).alias("n"),
    )
    if crowded is not None:
        cells = cells.unionByName(_hot_cells(crowded, keys))
    return cells.withColumns({"z_low": z_low(F.col("z_idx"), res), "resolution": F.lit(res)})


def _hot_cells(binned: DataFrame, keys: list[str]) -> DataFrame:
    medians = quantiles(binned, keys, "m3c2", {"dist": 0.5})
    per_cluster = binned.groupBy(*keys, "cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("uncertainty") * F.col("uncertainty")).alias("u2")
    )
    rest = per_cluster.groupBy(*keys).agg(
        F.min_by("cluster_id", F.struct(-F.col("n"), F.col("cluster_id"))).alias("cluster_id"),
        F.sqrt(F.sum("u2") / F.sum("n")).alias("unc"),
        F.sum("n").alias("n"),
    )
    return medians.join(rest, keys).select(*keys, "dist", "cluster_id", "unc", "n")


def grid_stats(points: DataFrame, joined: DataFrame, by: list[str]) -> DataFrame:
    """Counts and means of one gridding run: all points, and clustered points inside polygons."""
    noise = F.col("cluster_id") == -1
    per_cluster = points.groupBy(*by, "cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs("m3c2")).alias("d"), F.sum("uncertainty").alias("u")
    )
    clustered = F.sum(F.when(~noise, F.col("n")))
    base = per_cluster.groupBy(*by).agg(
        F.sum("n").alias("total_points"),
        F.coalesce(clustered, F.lit(0)).alias("clustered_points"),
        F.count_if(~noise).alias("n_clusters"),
        (F.sum(F.when(~noise, F.col("d"))) / clustered).alias("mean_abs_m3c2"),
        (F.sum(F.when(~noise, F.col("u"))) / clustered).alias("mean_uncertainty"),
    )
    placed = joined.groupBy(*by, "polygon_id").agg(F.count(F.lit(1)).alias("n"))
    placed = placed.groupBy(*by).agg(
        F.sum("n").alias("points_in_polygons"), F.count(F.lit(1)).alias("polygons_with_data")
    )
    return base.join(placed, by, "left").na.fill(0, ["points_in_polygons", "polygons_with_data"])


def grid_run_report(stats: DataFrame) -> DataFrame:
    """Per mode: runs, mean clusters, mean change and clustered share."""
    return stats.groupBy("mode").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("n_clusters").alias("mean_clusters"),
        F.avg("mean_abs_m3c2").alias("mean_abs_m3c2"),
        (F.sum("clustered_points") / F.sum("total_points") * 100).alias("clustered_pct"),
    )


def densify(cells: DataFrame, polys: DataFrame, res: float, height: float, by: list[str] = tuple(INTERVAL)) -> DataFrame:
    """Every polygon and bin of each interval; cells without data are null.

    Polygons meet the intervals of their site. A site is dealt over ``SALTS``
    keys, with its few intervals repeated for each, so no task gets a whole site.
    The cells of a polygon come as one list, so what is joined has a row for
    each interval and polygon, and bins are laid out afterwards. The list is
    made a map once, so a bin finds its cells without a walk through lambdas.
    """
    by = list(by)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    intervals = cells.select(*by).distinct().select("*", salts)
    frame = (
        polys.select("location", "polygon_id", F.pmod(F.hash("polygon_id"), F.lit(SALTS)).alias("_salt"))
        .join(intervals, ["location", "_salt"])
        .drop("_salt")
    )
    place = by + ["polygon_id"]
    values = [c for c in cells.columns if c not in (*place, "z_idx", "z_low")]
    listed = cells.groupBy(*place).agg(
        F.collect_list(F.struct(F.col("z_idx").alias("_z"), *values)).alias("_cells")
    )
    known = F.array_distinct(F.transform(F.filter("_cells", lambda c: c["_z"].isNotNull()), lambda c: c["_z"]))
    by_bin = F.map_from_arrays(known, F.transform(known, lambda k: F.filter("_cells", lambda c: c["_z"] == k)))
    mapped = spread(frame, *place).join(listed, place, "left").select(*place, by_bin.alias("_at"))
    bins = mapped.select(*place, "_at", F.explode(F.sequence(F.lit(0), F.lit(bin_count(height, res) - 1))).alias("z_idx"))
    # a bin without cells keeps its row
    here = F.inline_outer(F.try_element_at("_at", F.col("z_idx")))
    out = bins.select(*place, "z_idx", z_low(F.col("z_idx"), res).alias("z_low"), here)
    return out.drop("_z")


def to_wide(cells: DataFrame, value: str, res: float, height: float, prefix: str, ids: list[str]) -> DataFrame:
    """One row per polygon, one column per bin (``<prefix>_<z>m``)."""
    n = bin_count(height, res)
    labels = [f"{prefix}_{k * res:.2f}m" for k in range(n)]
    # most cells are empty, so a list of the others is all that a polygon needs; a row of n sums per cell is not
    filled = F.when(F.col(value).isNotNull(), F.struct(F.col("z_idx").alias("k"), F.col(value).alias("v")))
    listed = cells.groupBy(*ids, "polygon_id").agg(F.collect_list(filled).alias("_cells"))
    at = lambda k: F.get(F.filter("_cells", lambda c: c["k"] == k), F.lit(0))["v"]
    return listed.select(*ids, "polygon_id", *[at(k).alias(label) for k, label in enumerate(labels)])


def to_elevation_rows(cells: DataFrame, value: str, polygon_ids: list[int], ids: list[str]) -> DataFrame:
    """Transposed view: one row per bin, one column per polygon."""
    return cells.groupBy(*ids, "z_idx").pivot("polygon_id", polygon_ids).agg(F.first(value, ignorenulls=True))


def to_long(wide: DataFrame, ids: list[str], res: float, value: str) -> DataFrame:
    """Unpivot a wide grid; the bin comes from the header."""
    from talus.functions.naming import elev_from_label
    from talus.functions.numeric import snap_bin

    columns = [c for c in wide.columns if c not in ids]
    # headers are read once, when the query is planned, not for every cell
    heights = [(c, elev_from_label(F.lit(c))) for c in columns]
    bins = [F.struct(snap_bin(z, res).alias("z_idx"), z.alias("z_low"), F.col(f"`{c}`").alias(value)) for c, z in heights]
    return wide.select(*[F.col(f"`{c}`") for c in ids], F.inline(F.array(*bins)))


def apply_cutoff(cells: DataFrame, cutoffs: DataFrame | None) -> DataFrame:
    """Zero cells whose lower edge is above the cliff top; polygons without a cutoff keep all.

    Adds ``cut`` for cells that held change before.
    """
    if cutoffs is None:
        return cells.withColumn("cut", F.lit(False))
    keys = [k for k in ("location", "resolution", "polygon_id") if k in cutoffs.columns]
    top = F.coalesce("cliff_top_z", F.lit(NO_CUTOFF))
    above = F.col("z_low") > top
    return (
        cells.join(cutoffs.select(*keys, "cliff_top_z"), keys, "left")
        .withColumns(
            {
                "cut": above & F.coalesce(F.col("dist") != 0, F.lit(False)),
                "dist": F.when(above, 0.0).otherwise(F.col("dist")),
                "cluster_id": F.when(above, 0).otherwise(F.col("cluster_id")),
            }
        )
        .drop("cliff_top_z")
    )


def cluster_sizes(cells: DataFrame, by: list[str] = tuple(INTERVAL)) -> DataFrame:
    """Occupied cells per cluster; 0 is empty."""
    return cells.where(F.col("cluster_id") != 0).groupBy(*by, "cluster_id").agg(F.count(F.lit(1)).alias("cells"))


def cleaning_stats(cells: DataFrame, min_cells: int, by: list[str] = tuple(INTERVAL)) -> DataFrame:
    """Clusters found, kept and removed, and cells above the cutoff, per interval (after :func:`apply_cutoff`)."""
    per_cluster = cells.groupBy(*by, "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("cut").alias("c"))
    real = (F.col("cluster_id") != 0) & F.col("cluster_id").isNotNull()
    return per_cluster.groupBy(*by).agg(
        F.count_if(real).alias("total_clusters"),
        F.count_if(real & (F.col("n") >= min_cells)).alias("kept_clusters"),
        F.count_if(real & (F.col("n") < min_cells)).alias("removed_clusters"),
        F.sum("c").alias("cutoff_removed_cells"),
    )


def keep_clusters(cells: DataFrame, min_cells: int, by: list[str] = tuple(INTERVAL)) -> DataFrame:
    """Zero the cells of clusters with too few cells."""
    by = list(by)
    kept = cluster_sizes(cells, by).where(F.col("cells") >= min_cells)
    joined = _lookup(cells, kept, by)
    keep = F.col("cells").isNotNull()
    return joined.select(
        *[c for c in cells.columns if c not in ("dist", "cluster_id")],
        F.when(keep, F.col("dist")).otherwise(0.0).alias("dist"),
        F.when(keep, F.col("cluster_id")).otherwise(0).alias("cluster_id"),
    )


def _lookup(cells: DataFrame, clusters: DataFrame, by: list[str]) -> DataFrame:
    """Left join on the cluster.

    Most cells of a grid are empty and would share one key; they match nothing,
    so they are spread by polygon instead.
    """
    key = F.when(F.col("cluster_id") != 0, F.col("cluster_id").cast("long"))
    spread = cells.withColumn("_key", F.coalesce(key, -2 - F.col("polygon_id")))
    found = clusters.withColumn("_key", F.col("cluster_id").cast("long")).drop("cluster_id")
    return spread.join(found, by + ["_key"], "left").drop("_key")


def clean_cells(cells: DataFrame, cutoffs: DataFrame | None, min_cells: int) -> DataFrame:
    """Cutoff, then cluster-size threshold; everything else becomes zero."""
    return keep_clusters(apply_cutoff(cells, cutoffs).drop("cut"), min_cells)


def footprint_check(deposition: DataFrame, erosion: DataFrame, buffer_bins: int) -> DataFrame:
    """Zero deposition clusters without erosion nearby.

    A cluster stays when the same interval has an eroded cell within
    ``buffer_bins`` polygons of its rows and at or above its lowest bin.  Only
    the highest eroded bin per polygon matters, so the erosion side shrinks to
    one row per polygon before it meets the clusters.
    """
    same = ["location", "d1", "d2", "resolution"]
    real = F.col("cluster_id") != 0
    boxes = deposition.where(real).groupBy(*same, "cluster_id").agg(
        F.min("polygon_id").alias("p_lo"), F.max("polygon_id").alias("p_hi"), F.min("z_idx").alias("z_lo")
    )
    tops = erosion.where(F.col("dist") > 0).groupBy(*same, "polygon_id").agg(F.max("z_idx").alias("top"))
    backed = _ranges_above(boxes, tops, same, buffer_bins)
    marked = _lookup(deposition, backed.withColumn("_ok", F.lit(True)), same)
    ok = F.coalesce("_ok", F.lit(False))
    return marked.withColumns(
        {"dist": F.when(real & ok, F.col("dist")).otherwise(0.0), "cluster_id": F.when(ok, F.col("cluster_id")).otherwise(0)}
    ).drop("_ok")


BLOCK = 64  # polygons per block of the range lookup


def _ranges_above(boxes: DataFrame, tops: DataFrame, same: list[str], buffer: int) -> DataFrame:
    """Clusters whose buffered polygon range holds a top at or above their lowest bin.

    A range is looked up as whole blocks of polygons plus the single polygons
    at its two ends, both by equi-join.
    """
    singles = tops.select(*same, F.lit(0).alias("lv"), F.col("polygon_id").cast("bigint").alias("at"), "top")
    blocks = tops.groupBy(*same, F.floor(F.col("polygon_id") / BLOCK).alias("at")).agg(F.max("top").alias("top"))
    lookup = singles.unionByName(blocks.withColumn("lv", F.lit(1)))

    lo = F.greatest(F.col("p_lo") - buffer, F.lit(0)).cast("bigint")
    hi = (F.col("p_hi") + buffer).cast("bigint")
    first, last = F.floor(lo / BLOCK), F.floor(hi / BLOCK)
    ends = F.array_union(
        F.sequence(lo, F.least(hi, (first + 1) * BLOCK - 1)), F.sequence(F.greatest(lo, last * BLOCK), hi)
    )
    inner = F.when(last - first >= 2, F.sequence(first + 1, last - 1)).otherwise(F.array().cast("array<bigint>"))

    def asked(lv, at):
        return boxes.select(*same, "cluster_id", "z_lo", F.lit(lv).alias("lv"), F.explode(at).alias("at"))

    met = asked(0, ends).unionByName(asked(1, inner)).join(lookup, same + ["lv", "at"])
    return met.where(F.col("top") >= F.col("z_lo")).select(*same, "cluster_id").distinct()


def pick_stage(cells: DataFrame, order: tuple[str, ...] = STAGES, by: list[str] = tuple(INTERVAL)) -> DataFrame:
    """For each interval keep only the best stage that exists."""
    by = list(by)
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage"))
    ranked = cells.withColumn("_rank", rank).where(F.col("_rank") > 0)
    best = ranked.groupBy(*by).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, by + ["_rank"], "left_semi").drop("_rank")


def grid_shapes(cells: DataFrame, by: list[str] = tuple(INTERVAL)) -> DataFrame:
    """Rows and columns of each interval's grid."""
    by = list(by)

    def distinct(col: str, name: str) -> DataFrame:
        return cells.select(*by, col).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(name))

    return distinct("polygon_id", "n_rows").join(distinct("z_idx", "n_cols"), by)


def shape_flags(cells: DataFrame, series: list[str] = ("location", "mode", "resolution")) -> DataFrame:
    """Intervals with ``same_shape``: equal to the first interval of the series, by date."""
    series = list(series)
    shapes = grid_shapes(cells)
    size = F.struct("n_rows", "n_cols")
    first = shapes.groupBy(*series).agg(F.min_by(size, F.struct("d1", "d2")).alias("_first"))
    return shapes.join(first, series).withColumn("same_shape", size == F.col("_first")).drop("_first")


def cumulative_grid(
    cells: DataFrame, series: list[str] = ("location", "mode", "resolution"), check_shape: bool = False
) -> DataFrame:
    """Total change per cell over all intervals, missing cells counting as zero.

    With ``check_shape`` intervals whose grid differs in shape from the first are left out.
    """
    series = list(series)
    used = cells
    if check_shape:
        good = shape_flags(cells, series).where("same_shape").select(*INTERVAL)
        used = cells.join(good, INTERVAL, "left_semi")
    return used.groupBy(*series, "polygon_id", "z_idx").agg(
        F.sum(F.coalesce("dist", F.lit(0.0))).alias("cum_dist"), F.count(F.lit(1)).alias("intervals")
    )


def cumulative_frames(dense: DataFrame, series: list[str] = ("location", "mode", "resolution")) -> DataFrame:
    """Running total of every cell, one frame per interval; needs densified cells.

    The window holds one cell's history, so it is as long as there are intervals.
    """
    w = Window.partitionBy(*series, "polygon_id", "z_idx").orderBy("d1", "d2").rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumn("cum_dist", F.sum(F.coalesce("dist", F.lit(0.0))).over(w)).select(*CELL, "cum_dist")


def align_cells(grid: DataFrame, clusters: DataFrame, uncertainty: DataFrame | None = None) -> DataFrame:
    """Distance and cluster on their common cells, uncertainty where present."""
    out = grid.select(*CELL, "dist").join(clusters.select(*CELL, "cluster_id"), CELL)
    if uncertainty is None:
        return out.withColumn("unc", F.lit(None).cast("double"))
    return out.join(uncertainty.select(*CELL, "unc"), CELL, "left")
