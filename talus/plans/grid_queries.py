"""Grid, event, series and distribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions.numeric import alongshore_m, error_bars, zoom
from talus.operators import cluster, events, fill, grid, series, spatial, stats
from talus.operators.inventory import latest_run as keep_latest
from talus.operators.lineage import cut
from talus.operators.ranks import ecdf as ecdf_of
from talus.plans import stages, tables
from talus.plans.registry import query, r, sql

KEYS = "location, mode, d1, d2, resolution"
AREA = "resolution * resolution"


def changes(spark, d):
    return grid.split_mode(grid.significant_changes(tables.change_points(spark, d)))


def placed(spark, d):
    return spatial.points_in_polygons(grid.clustered_only(changes(spark, d)), tables.polygons(spark, d))


def cells(spark, d):
    return grid.grid_cells(placed(spark, d), 1.0, 30.0)


def fine_cells(spark, d):
    return grid.grid_cells(placed(spark, d), 0.25, 20.0)


def two_resolutions(spark, d):
    points = cut(placed(spark, d))
    return grid.grid_cells(points, 1.0, 30.0).unionByName(grid.grid_cells(points, 0.25, 30.0))


def dense(spark, d):
    return grid.densify(cut(cells(spark, d)), tables.polygons(spark, d), 1.0, 30.0)


def laid_out(spark, d, clean):
    """Cleaned cells in their dense frame. Cleaning makes empty cells zero, so they need not be there before it."""
    frame = grid.densify(clean, tables.polygons(spark, d), 1.0, 30.0)
    return frame.withColumns({"dist": F.coalesce("dist", F.lit(0.0)), "cluster_id": F.coalesce("cluster_id", F.lit(0))})


def cleaned(spark, d):
    return laid_out(spark, d, grid.clean_cells(cut(cells(spark, d)), tables.cutoffs(spark, d), 2))


def all_events(spark, d):
    return events.extract_events(cells(spark, d))


def erosion_events(spark, d):
    return events.min_volume(all_events(spark, d).where("mode = 'erosion'"), 0.005)


CELL = "location, mode, d1, d2, polygon_id, z_idx, cluster_id, n, resolution"


@query("significant_split", sql("change", f"""
    SELECT mode, d1, d2, count(*) AS points, {r('sum(abs(m3c2))', 'change')} FROM modes GROUP BY ALL"""))
def significant_split(spark, d):
    return changes(spark, d).groupBy("mode", "d1", "d2").agg(
        F.count(F.lit(1)).alias("points"), F.sum(F.abs("m3c2")).alias("change")
    )


@query("grid_cells", sql("cells", f" SELECT {CELL}, {r('dist', 'dist')}, {r('unc', 'unc')}, {r('z_low', 'z_low')} FROM cells"))
def grid_cells(spark, d):
    return cells(spark, d)


@query("grid_cells_fine", sql("fine", f" SELECT {CELL}, {r('dist', 'dist')}, {r('unc', 'unc')}, {r('z_low', 'z_low')} FROM fine"))
def grid_cells_fine(spark, d):
    return fine_cells(spark, d)


@query("grid_cells_merged", sql("merged", f"""
    SELECT location, mode, polygon_id, z_idx, cluster_id, n, resolution, {r('dist', 'dist')}, {r('unc', 'unc')}, {r('z_low', 'z_low')} FROM merged"""))
def grid_cells_merged(spark, d):
    return grid.grid_cells(placed(spark, d), 1.0, 30.0, by=["location", "mode"])


_STATS = """
    , placed AS (SELECT m.*, p.polygon_id FROM modes m JOIN polys p ON x > p.polygon_id AND x < p.polygon_id + 1 WHERE cluster_id <> -1),
    a AS (SELECT location, mode, d1, d2, count(*) AS total_points, count(*) FILTER (cluster_id <> -1) AS clustered_points,
                 count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS n_clusters, avg(abs(m3c2)) FILTER (cluster_id <> -1) AS mean_abs_m3c2,
                 avg(uncertainty) FILTER (cluster_id <> -1) AS mean_uncertainty FROM modes GROUP BY ALL),
    b AS (SELECT location, mode, d1, d2, count(*) AS points_in_polygons, count(DISTINCT polygon_id) AS polygons_with_data FROM placed GROUP BY ALL),
    run AS (SELECT a.*, coalesce(points_in_polygons, 0) AS points_in_polygons, coalesce(polygons_with_data, 0) AS polygons_with_data
            FROM a LEFT JOIN b USING (location, mode, d1, d2))
"""


@query("grid_stats", sql("polys change", _STATS + f"""
    SELECT location, mode, d1, d2, total_points, clustered_points, n_clusters, {r('mean_abs_m3c2', 'mean_abs_m3c2')},
           {r('mean_uncertainty', 'mean_uncertainty')}, points_in_polygons, polygons_with_data FROM run"""))
def grid_stats(spark, d):
    return grid.grid_stats(changes(spark, d), placed(spark, d), ["location", "mode", "d1", "d2"])


@query("grid_run_report", sql("polys change", _STATS + f"""
    SELECT mode, count(*) AS runs, {r('avg(n_clusters)', 'mean_clusters')}, {r('avg(mean_abs_m3c2)', 'mean_abs_m3c2')},
           {r('sum(clustered_points) / sum(total_points) * 100', 'clustered_pct')} FROM run GROUP BY mode"""))
def grid_run_report(spark, d):
    return grid.grid_run_report(grid_stats(spark, d))


@query("grid_dense", sql("cells dense", f"""
    SELECT {KEYS}, polygon_id, z_idx, z_low, {r('dist', 'dist')}, cluster_id, {r('unc', 'unc')}, n FROM dense"""))
def grid_dense(spark, d):
    return dense(spark, d)


_WIDE = ", ".join(f'max(CASE WHEN z_idx = {k} THEN round(dist, 6) END) AS "M3C2_{k}.00m"' for k in range(30))


@query("grid_wide", sql("cells dense", f" SELECT {KEYS}, polygon_id, {_WIDE} FROM dense GROUP BY {KEYS}, polygon_id"))
def grid_wide(spark, d):
    return grid.to_wide(dense(spark, d), "dist", 1.0, 30.0, "M3C2", KEYS.split(", "))


@query("grid_long", sql("cells dense", f" SELECT {KEYS}, polygon_id, z_idx, z_low, {r('dist', 'dist')} FROM dense"))
def grid_long(spark, d):
    wide = grid.to_wide(dense(spark, d), "dist", 1.0, 30.0, "M3C2", KEYS.split(", "))
    return grid.to_long(wide, KEYS.split(", ") + ["polygon_id"], 1.0, "dist")


@query("elevation_rows", sql("cells", " SELECT mode, (polygon_id // 10)::BIGINT AS block, z_idx, " + ", ".join(
    f'round(sum(CASE WHEN polygon_id % 10 = {p} THEN dist END), 6) AS "{p}"' for p in range(10)) + " FROM cells GROUP BY ALL"))
def elevation_rows(spark, d):
    # ten polygons a row, so that the columns stay the same however long the layer is
    total = grid.cumulative_grid(cells(spark, d)).withColumn("block", F.expr("polygon_id div 10"))
    return grid.to_elevation_rows(
        total.withColumn("polygon_id", F.col("polygon_id") % 10), "cum_dist", list(range(10)), ["mode", "block"]
    )


@query("vertical_cutoff", sql("cells dense clean", f"""
    SELECT {KEYS}, polygon_id, z_idx, {r('dist', 'dist')}, cluster_id, cut FROM topped"""))
def vertical_cutoff(spark, d):
    out = grid.apply_cutoff(dense(spark, d), tables.cutoffs(spark, d))
    return out.select(*KEYS.split(", "), "polygon_id", "z_idx", "dist", "cluster_id", "cut")


@query("cleaning_stats", sql("cells dense clean", f"""
    , per AS (SELECT {KEYS}, cluster_id, count(*) AS n, count(*) FILTER (cut) AS c FROM topped GROUP BY ALL)
    SELECT {KEYS}, count(*) FILTER (cluster_id <> 0) AS total_clusters, count(*) FILTER (cluster_id <> 0 AND n >= 2) AS kept_clusters,
           count(*) FILTER (cluster_id <> 0 AND n < 2) AS removed_clusters, sum(c)::BIGINT AS cutoff_removed_cells FROM per GROUP BY ALL"""))
def cleaning_stats(spark, d):
    return grid.cleaning_stats(grid.apply_cutoff(dense(spark, d), tables.cutoffs(spark, d)), 2)


@query("cluster_filter", sql("cells dense clean", f" SELECT {KEYS}, polygon_id, z_idx, {r('dist', 'dist')}, cluster_id FROM cleaned"))
def cluster_filter(spark, d):
    return cleaned(spark, d).select(*KEYS.split(", "), "polygon_id", "z_idx", "dist", "cluster_id")


@query("footprint", sql("cells dense clean", f"""
    , dep AS (SELECT * FROM cleaned WHERE mode = 'deposition'), ero AS (SELECT * FROM topped WHERE mode = 'erosion' AND dist > 0),
    boxes AS (SELECT location, d1, d2, cluster_id, min(polygon_id) AS lo, max(polygon_id) AS hi, min(z_idx) AS zlo FROM dep WHERE cluster_id <> 0 GROUP BY ALL),
    backed AS (SELECT DISTINCT b.location, b.d1, b.d2, b.cluster_id FROM boxes b JOIN ero e
               ON e.location = b.location AND e.d1 = b.d1 AND e.d2 = b.d2 AND e.polygon_id BETWEEN b.lo - 2 AND b.hi + 2 AND e.z_idx >= b.zlo)
    SELECT {KEYS}, polygon_id, z_idx, round(CASE WHEN k.cluster_id IS NOT NULL THEN d.dist ELSE 0 END, 6) + 0.0 AS dist,
           CASE WHEN k.cluster_id IS NOT NULL THEN d.cluster_id ELSE 0 END AS cluster_id
    FROM dep d LEFT JOIN backed k USING (location, d1, d2, cluster_id)"""))
def footprint(spark, d):
    raw, tops = cut(cells(spark, d)), tables.cutoffs(spark, d)
    clean = grid.clean_cells(raw, tops, 2).where("mode = 'deposition'")
    eroded = grid.apply_cutoff(raw, tops).where("mode = 'erosion'")
    checked = laid_out(spark, d, grid.footprint_check(clean, eroded, 2))
    return checked.select(*KEYS.split(", "), "polygon_id", "z_idx", "dist", "cluster_id")


@query("cluster_volumes", sql("cells", f"""
    SELECT {KEYS}, cluster_id, {r(f'sum(abs(dist) * {AREA})', 'volume')} FROM cells WHERE cluster_id > 0 AND dist <> 0 GROUP BY ALL"""))
def cluster_volumes(spark, d):
    return events.cluster_volumes(cells(spark, d))


@query("pick_stage", sql("cells", f"""
    , staged AS (SELECT *, 'raw' AS stage FROM cells UNION ALL SELECT *, 'cleaned' FROM cells WHERE month(d1) <> 1
                 UNION ALL SELECT *, 'filled' FROM cells WHERE month(d1) = 7),
    ranked AS (SELECT *, CASE stage WHEN 'filled' THEN 1 WHEN 'cleaned' THEN 2 ELSE 3 END AS k FROM staged)
    SELECT {KEYS}, polygon_id, z_idx, stage FROM ranked QUALIFY k = min(k) OVER (PARTITION BY {KEYS})"""))
def pick_stage(spark, d):
    c = cells(spark, d)
    staged = (
        c.withColumn("stage", F.lit("raw"))
        .unionByName(c.where(F.month("d1") != 1).withColumn("stage", F.lit("cleaned")))
        .unionByName(c.where(F.month("d1") == 7).withColumn("stage", F.lit("filled")))
    )
    return grid.pick_stage(staged).select(*KEYS.split(", "), "polygon_id", "z_idx", "stage")


@query("latest_run", sql("change", """
    SELECT d1, d2, count(*) AS points FROM change WHERE year(d1) = (SELECT max(year(d1)) FROM change) GROUP BY ALL"""))
def latest_run(spark, d):
    runs = tables.change_points(spark, d).withColumn("run_id", F.year("d1"))
    return keep_latest(runs).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("points"))


EVENT = (
    f"{KEYS}, cluster_id, {r('volume', 'volume')}, {r('vol_unc', 'vol_unc')}, {r('elevation', 'elevation')}, {r('x_m', 'x_m')}, "
    f"{r('width', 'width')}, {r('height', 'height')}, mid, month, winter"
)


@query("extract_events", sql("cells events", f" SELECT {EVENT} FROM events_m"))
def extract_events(spark, d):
    return all_events(spark, d)


@query("large_events", sql("cells events", f" SELECT {EVENT} FROM events_m WHERE volume > 5"))
def large_events(spark, d):
    return events.min_volume(all_events(spark, d), 5.0, strict=True)


@query("interval_volume", sql("cells", f" SELECT {KEYS}, {r(f'sum(dist * {AREA})', 'volume')} FROM cells GROUP BY ALL"))
def interval_volume(spark, d):
    return events.interval_volume(cells(spark, d))


BOUNDS = (
    f"{r(f'sum(dist * {AREA})', 'volume')}, {r(f'sum((dist - unc) * {AREA})', 'vol_lower')}, {r(f'sum((dist + unc) * {AREA})', 'vol_upper')}"
)


@query("bounds_cell", sql("cells", f" SELECT {KEYS}, {BOUNDS} FROM cells GROUP BY ALL"))
def bounds_cell(spark, d):
    return events.volume_bounds_cell(cells(spark, d))


_MEAN = f"""
    , mu AS (SELECT {KEYS}, coalesce(avg(unc) FILTER (unc > 0), 0) AS u FROM cells GROUP BY ALL),
    bm AS (SELECT {KEYS}, sum(dist * {AREA}) AS volume,
           sum(CASE WHEN dist > 0.01 THEN greatest(dist - u, 0) ELSE dist END * {AREA}) AS vol_lower,
           sum(CASE WHEN dist > 0.01 THEN dist + u ELSE dist END * {AREA}) AS vol_upper, greatest(d2 - d1, 1)::INTEGER AS days
           FROM cells JOIN mu USING ({KEYS}) GROUP BY {KEYS})
"""


@query("bounds_mean", sql("cells", _MEAN + f"""
    SELECT {KEYS}, {r('volume', 'volume', 8)}, {r('vol_lower', 'vol_lower', 8)}, {r('vol_upper', 'vol_upper', 8)}, days FROM bm"""), digits=8)
def bounds_mean(spark, d):
    return events.volume_bounds_mean(cut(cells(spark, d)))


@query("error_bars", sql("cells", _MEAN + f"""
    SELECT {KEYS}, {r('greatest(0, volume - vol_lower)', 'err_low', 8)}, {r('greatest(0, vol_upper - volume)', 'err_high', 8)} FROM bm"""), digits=8)
def error_bar_widths(spark, d):
    return error_bars(bounds_mean(spark, d)).select(*KEYS.split(", "), "err_low", "err_high")


@query("cluster_uncertainty", sql("cells", f"""
    SELECT {KEYS}, cluster_id, {r(f'sum(unc * {AREA})', 'vol_unc')} FROM cells WHERE cluster_id > 0 GROUP BY ALL"""))
def cluster_uncertainty(spark, d):
    return events.cluster_uncertainty(cells(spark, d))


@query("cell_uncertainty", sql("cells", f" SELECT {KEYS}, polygon_id, z_idx, {r('unc', 'unc')} FROM cells WHERE unc > 1e-6"))
def cell_uncertainty(spark, d):
    return events.cell_uncertainty(cells(spark, d)).select(*KEYS.split(", "), "polygon_id", "z_idx", "unc")


@query("uncertainty_p95", sql("cells", f"""
    SELECT mode, {r('quantile_cont(unc, 0.95)', 'p95')}, {r('median(unc)', 'median')} FROM cells WHERE unc > 1e-6 GROUP BY mode"""))
def uncertainty_p95(spark, d):
    from talus.operators.ranks import quantiles

    return quantiles(events.cell_uncertainty(cells(spark, d)), ["mode"], "unc", {"p95": 0.95, "median": 0.5})


@query("event_count", sql("cells", f" SELECT {KEYS}, count(DISTINCT cluster_id) FILTER (cluster_id <> 0) AS events FROM cells GROUP BY ALL"))
def event_count(spark, d):
    return events.event_count(cells(spark, d))


@query("event_series", sql("cells", """
    , per AS (SELECT location, mode, resolution, d1, d2, count(DISTINCT cluster_id) FILTER (cluster_id <> 0) AS events FROM cells GROUP BY ALL)
    SELECT *, (sum(events) OVER (PARTITION BY location, mode, resolution ORDER BY d2, d1))::BIGINT AS cum_events FROM per"""))
def event_series(spark, d):
    return series.event_series(cells(spark, d))


@query("blank_intervals", sql("cells dense clean", f"""
    , least AS (SELECT floor(quantile_cont(m, 0.5))::BIGINT + 1 AS least FROM (SELECT max(cells) AS m FROM sizes GROUP BY {KEYS}))
    SELECT {KEYS}, 0.0::DOUBLE AS volume, 'Zero Volume' AS reason FROM (
      SELECT {KEYS}, sum(CASE WHEN s.cells >= least THEN dist ELSE 0 END) AS v
      FROM topped LEFT JOIN sizes s USING ({KEYS}, cluster_id), least GROUP BY ALL) WHERE v = 0"""))
def blank_intervals(spark, d):
    """Cleaned so hard, with the median of the largest clusters for a limit, that some intervals lose all they had."""
    keys = KEYS.split(", ")
    # empty cells of a frame hold no volume and no cluster
    raw, tops = cut(cells(spark, d)), tables.cutoffs(spark, d)
    sizes = grid.apply_cutoff(raw, tops).where("cluster_id <> 0").groupBy(*keys, "cluster_id").count()
    largest = sizes.groupBy(*keys).agg(F.max("count").alias("m")).agg(F.percentile("m", 0.5).alias("m")).first().m
    return events.blank_intervals(events.interval_volume(grid.clean_cells(raw, tops, int(largest) + 1)))


@query("cumulative_grid", sql("cells", f"""
    SELECT location, mode, resolution, polygon_id, z_idx, {r('sum(dist)', 'cum_dist')}, count(*) AS intervals FROM cells GROUP BY ALL"""))
def cumulative_grid(spark, d):
    return grid.cumulative_grid(cells(spark, d))


@query("shape_flags", sql("cells", f"""
    , shp AS (SELECT {KEYS}, count(DISTINCT polygon_id) AS n_rows, count(DISTINCT z_idx) AS n_cols FROM cells GROUP BY ALL)
    SELECT *, n_rows = first(n_rows) OVER w AND n_cols = first(n_cols) OVER w AS same_shape FROM shp
    WINDOW w AS (PARTITION BY location, mode, resolution ORDER BY d1, d2)"""))
def shape_flags(spark, d):
    return grid.shape_flags(cut(cells(spark, d)))


@query("cumulative_frames", sql("cells dense", f"""
    SELECT {KEYS}, polygon_id, z_idx, {r('sum(coalesce(dist, 0)) OVER (PARTITION BY location, mode, resolution, polygon_id, z_idx ORDER BY d1, d2)', 'cum_dist')} FROM dense"""))
def cumulative_frames(spark, d):
    return grid.cumulative_frames(dense(spark, d))


_VOL = f"""
    , vol AS (SELECT {KEYS}, sum(dist * {AREA}) AS volume FROM cells GROUP BY ALL)
"""


@query("cumulative_volume", sql("cells", _VOL + f"""
    SELECT {KEYS}, {r('volume', 'volume')}, {r('sum(volume) OVER (PARTITION BY location, mode, resolution ORDER BY d2, d1)', 'cum_volume')} FROM vol"""))
def cumulative_volume(spark, d):
    return series.cumulative(interval_volume(spark, d), ["volume"])


@query("rolling_rate", sql("cells", _VOL + f"""
    , rates AS (SELECT *, volume / greatest(d2 - d1, 1) AS rate FROM vol)
    SELECT {KEYS}, {r('volume', 'volume')}, {r('rate', 'rate')}, {r('avg(rate) OVER (PARTITION BY location, mode, resolution ORDER BY d2, d1 ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)', 'smooth_rate')} FROM rates"""))
def rolling_rate(spark, d):
    return series.rolling_rate(interval_volume(spark, d))


_BOTH = f"""
    , both_ AS (SELECT * FROM cells UNION ALL SELECT * FROM fine_whole)
"""


@query("resolution_compare", sql("cells fine_whole", _BOTH + f"""
    SELECT location, mode, d1, d2, {r(f'sum(dist * {AREA}) FILTER (resolution = 0.25)', 'vol_25cm')}, {r(f'sum(dist * {AREA}) FILTER (resolution = 1.0)', 'vol_100cm')}
    FROM both_ GROUP BY ALL"""))
def resolution_compare(spark, d):
    return series.resolution_compare(two_resolutions(spark, d), [0.25, 1.0])


@query("top_intervals", sql("cells fine_whole", _BOTH + f"""
    , vol AS (SELECT {KEYS}, round(sum(dist * {AREA}), 9) AS volume FROM both_ GROUP BY ALL)
    SELECT {KEYS}, {r('volume', 'volume')}, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY resolution, mode ORDER BY volume DESC, d1, d2) AS rank FROM vol) WHERE rank <= 15"""))
def top_intervals(spark, d):
    volumes = events.interval_volume(two_resolutions(spark, d)).withColumn("volume", F.round("volume", 9))
    return series.top_intervals(volumes, 15, ["resolution", "mode"])


_KEPT = " UNION ALL ".join(
    f"SELECT *, {least} AS least FROM {name}" for name, least in (("tenth", 25), ("fine_whole", 4), ("cells", 1))
)


@query("volume_series", sql("cells fine_whole tenth", f"""
    , every AS ({_KEPT}),
    topped AS (SELECT e.* EXCLUDE (dist, cluster_id), CASE WHEN z_low > coalesce(cliff_top_z, 9999) THEN 0 ELSE dist END AS dist,
                      CASE WHEN z_low > coalesce(cliff_top_z, 9999) THEN 0 ELSE cluster_id END AS cluster_id
               FROM every e LEFT JOIN cutoffs USING (location, polygon_id)),
    sizes AS (SELECT {KEYS}, cluster_id, count(*) AS cells FROM topped WHERE cluster_id <> 0 GROUP BY ALL),
    staged AS (SELECT {KEYS}, 'raw' AS stage, dist, unc FROM every
               UNION ALL SELECT {KEYS}, 'cleaned', CASE WHEN s.cells >= least THEN dist ELSE 0 END, unc FROM topped LEFT JOIN sizes s USING ({KEYS}, cluster_id)),
    vol AS (SELECT location, mode, resolution, stage, d1, d2, sum(coalesce(dist, 0) * {AREA}) AS volume,
            sum((coalesce(dist, 0) - coalesce(unc, 0)) * {AREA}) AS vol_lower, sum((coalesce(dist, 0) + coalesce(unc, 0)) * {AREA}) AS vol_upper FROM staged GROUP BY ALL)
    SELECT location, mode, resolution, stage, d1, d2, {r('volume', 'volume')}, {r('vol_lower', 'vol_lower')}, {r('vol_upper', 'vol_upper')},
           {r('sum(volume) OVER w', 'cum_volume')}, {r('sum(vol_lower) OVER w', 'cum_vol_lower')}, {r('sum(vol_upper) OVER w', 'cum_vol_upper')}
    FROM vol WINDOW w AS (PARTITION BY location, mode, resolution, stage ORDER BY d2, d1)"""))
def volume_series(spark, d):
    """All three resolutions, raw and cleaned."""
    return series.volume_series(_staged(spark, d, ("raw", "cleaned")))


@query("filled_volume_series")
def filled_volume_series(spark, d):
    """All three resolutions after filling (erosion)."""
    return series.volume_series(_staged(spark, d, ("filled",)))


def _staged(spark, d, wanted):
    return stages.staged_cells(placed(spark, d), tables.polygons(spark, d), tables.cutoffs(spark, d), 30.0, wanted)


_MEASURES = "unnest(['volume', 'elevation', 'width', 'height']) AS measure, unnest([volume, elevation, width, height]) AS value"


@query("describe_events", sql("cells events", f"""
    , long AS (SELECT {_MEASURES} FROM erosion)
    SELECT measure, count(*) AS n, {r('avg(value)', 'mean')}, {r('sum(value)', 'total')}, {r('quantile_cont(value, 0.25)', 'q1')},
           {r('median(value)', 'median')}, {r('quantile_cont(value, 0.75)', 'q3')} FROM long GROUP BY measure"""))
def describe_events(spark, d):
    return stats.describe_events(erosion_events(spark, d))


@query("describe_events_by_month", sql("cells events", f"""
    , long AS (SELECT month, {_MEASURES} FROM erosion)
    SELECT month, measure, count(*) AS n, {r('avg(value)', 'mean')}, {r('sum(value)', 'total')}, {r('quantile_cont(value, 0.25)', 'q1')},
           {r('median(value)', 'median')}, {r('quantile_cont(value, 0.75)', 'q3')} FROM long GROUP BY month, measure"""))
def describe_events_by_month(spark, d):
    return stats.describe_events(erosion_events(spark, d), ["month"])


_SORTED = """
    , vols AS (SELECT round(volume, 9) AS volume FROM erosion),
    asc_ AS (SELECT volume, row_number() OVER (ORDER BY volume) AS i, row_number() OVER (ORDER BY volume DESC) AS rank,
                    count(*) OVER () AS n, sum(volume) OVER () AS total FROM vols),
    desc_ AS (SELECT rank, volume, rank / n * 100 AS events_pct, sum(volume) OVER (ORDER BY rank) / total * 100 AS volume_pct, n FROM asc_)
"""


def _volumes(spark, d):
    return erosion_events(spark, d).select(F.round("volume", 9).alias("volume"))


@query("gini", sql("cells events", _SORTED + f"SELECT {r('sum((2 * i - n - 1) * volume) / (any_value(n) * any_value(total))', 'gini')} FROM asc_"))
def gini(spark, d):
    return stats.gini(_volumes(spark, d), [])


@query("lorenz", sql("cells events", _SORTED + f"SELECT rank, {r('volume', 'volume')}, {r('events_pct', 'events_pct')}, {r('volume_pct', 'volume_pct')} FROM desc_"))
def lorenz(spark, d):
    return stats.lorenz(_volumes(spark, d), [])


@query("top_share", sql("cells events", _SORTED + f"""
    SELECT {r('max(volume_pct) FILTER (rank = floor(n * 0.05) + 1)', 'ordinate_pct')}, {r('max(volume_pct) FILTER (rank = ceil(n * 0.05))', 'ceil_pct')} FROM desc_"""))
def top_share(spark, d):
    return stats.top_share(_volumes(spark, d), [])


_BINS = """
    , vols AS (SELECT volume, vol_unc FROM erosion),
    ends AS (SELECT min(volume) AS lo, max(volume) AS hi FROM vols),
    edge AS (SELECT i, CASE i WHEN 0 THEN lo WHEN 29 THEN hi ELSE pow(10.0, log10(lo) + i * ((log10(hi) - log10(lo)) / 29)) END AS e FROM ends, range(0, 30) t(i)),
    binned AS (SELECT v.*, (SELECT count(*) FROM edge WHERE e <= v.volume) - 1 AS b FROM vols v)
"""


@query("power_law_hist", sql("cells events", _BINS + f"""
    , hist AS (SELECT a.i AS bin, (a.e + z.e) / 2 AS centre, (SELECT count(*) FROM binned WHERE least(b, 28) = a.i) AS events FROM edge a JOIN edge z ON z.i = a.i + 1),
    fit AS (SELECT count(*) AS k, regr_slope(log10(events), log10(centre)) AS s, regr_intercept(log10(events), log10(centre)) AS c FROM hist WHERE centre >= 0.25 AND events > 0)
    SELECT bin::INTEGER AS bin, {r('centre', 'centre')}, events, {r('CASE WHEN k >= 3 THEN -s ELSE 0 END', 'beta')}, {r('CASE WHEN k >= 3 THEN c END', 'intercept')} FROM hist, fit"""))
def power_law_hist(spark, d):
    return stats.power_law_hist(erosion_events(spark, d))


@query("bin_uncertainty", sql("cells events", _BINS + f"SELECT b::INTEGER AS bin, {r('avg(vol_unc)', 'mean_unc')}, count(*) AS events FROM binned WHERE b < 29 GROUP BY b"))
def bin_uncertainty(spark, d):
    return stats.bin_uncertainty(erosion_events(spark, d))


@query("power_law_mle", sql("cells events", f"""
    SELECT count(*) FILTER (volume >= 0.25) AS n, {r('CASE WHEN count(*) FILTER (volume >= 0.25) < 10 THEN 0 ELSE 1 + count(*) FILTER (volume >= 0.25) / sum(ln(volume / 0.25)) FILTER (volume >= 0.25) END', 'beta')} FROM erosion"""))
def power_law_mle(spark, d):
    return stats.power_law_mle(erosion_events(spark, d))


_SEASON = """
    , cal AS (SELECT unnest(range(1, 13))::INTEGER AS month),
    mon AS (SELECT cal.month, coalesce(sum(volume), 0) AS volume FROM cal LEFT JOIN erosion USING (month) GROUP BY cal.month),
    tot AS (SELECT sum(volume) AS t FROM mon)
"""


@query("seasonality", sql("cells events", _SEASON + f"SELECT month, {r('volume', 'volume')}, {r('volume / t * 100', 'pct')} FROM mon, tot"))
def seasonality(spark, d):
    return stats.seasonality(erosion_events(spark, d))


@query("season_summary", sql("cells events", _SEASON + f"""
    , sh AS (SELECT sum(volume) AS volume, sum(volume) FILTER (month IN (1, 2, 3, 10, 11, 12)) / sum(volume) * 100 AS w,
             sum(volume) FILTER (month = 12) / sum(volume) * 100 AS dec_, arg_max(month, volume) AS peak_month, max(volume) / sum(volume) * 100 AS pk FROM mon)
    SELECT {r('volume', 'volume')}, {r('w', 'winter_pct')}, {r('100 - w', 'summer_pct')}, {r('dec_', 'december_pct')}, peak_month, {r('pk', 'peak_pct')} FROM sh"""))
def season_summary(spark, d):
    return stats.season_summary(erosion_events(spark, d))


@query("ecdf", sql("cells", _VOL + f"""
    , v AS (SELECT mode, round(volume, 9) AS volume FROM vol WHERE volume > 0)
    SELECT DISTINCT mode, {r('volume', 'volume')}, {r('cume_dist() OVER (PARTITION BY mode ORDER BY volume)', 'ecdf')} FROM v"""))
def ecdf(spark, d):
    v = interval_volume(spark, d).where("volume > 0").select("mode", F.round("volume", 9).alias("volume"))
    return ecdf_of(v, ["mode"], "volume")


@query("histogram", sql("change", f"""
    , e AS (SELECT mode, uncertainty AS u FROM modes), lim AS (SELECT mode, min(u) AS lo, max(u) AS hi FROM e GROUP BY mode),
    b AS (SELECT mode, lo, hi, least(floor((u - lo) / ((hi - lo) / 20)) + 1, 20)::INTEGER AS bin FROM e JOIN lim USING (mode))
    SELECT mode, bin, {r('lo + (bin - 1) * ((hi - lo) / 20)', '"left"')}, {r('lo + bin * ((hi - lo) / 20)', '"right"')}, count(*) AS rows FROM b GROUP BY ALL"""))
def histogram(spark, d):
    return stats.histogram(changes(spark, d), ["mode"], "uncertainty", 20)


@query("percentile_limits", sql("cells dense", f"""
    , g AS (SELECT mode, polygon_id, z_idx, sum(coalesce(dist, 0)) AS v FROM dense GROUP BY ALL)
    SELECT mode, {r('quantile_cont(v, 0.02) FILTER (v <> 0)', 'p2')}, {r('quantile_cont(v, 0.98) FILTER (v <> 0)', 'p98')}, {r('quantile_cont(v, 0.995)', 'p99_5')} FROM g GROUP BY mode"""))
def percentile_limits(spark, d):
    return stats.color_limits(grid.cumulative_grid(dense(spark, d)), ["mode"], "cum_dist")


_RUNS = """
    , runs AS (SELECT location, d1, d2, count(*) FILTER (mode = 'erosion') AS ero_points,
        count(DISTINCT cluster_id) FILTER (mode = 'erosion' AND cluster_id <> -1) AS ero_clusters, count(*) FILTER (mode = 'erosion' AND cluster_id = -1) AS ero_noise,
        count(*) FILTER (mode = 'deposition') AS dep_points, count(DISTINCT cluster_id) FILTER (mode = 'deposition' AND cluster_id <> -1) AS dep_clusters,
        count(*) FILTER (mode = 'deposition' AND cluster_id = -1) AS dep_noise FROM modes GROUP BY ALL),
    rr AS (SELECT *, CASE WHEN dep_clusters <> 0 THEN ero_clusters / (dep_clusters + 0.001) ELSE 0 END AS ed_ratio,
        CASE WHEN ero_points <> 0 THEN ero_noise / ero_points ELSE 0 END * 100 AS ero_noise_pct, CASE WHEN dep_points <> 0 THEN dep_noise / dep_points ELSE 0 END * 100 AS dep_noise_pct,
        CASE WHEN ero_clusters <> 0 THEN ero_points / ero_clusters ELSE 0 END AS ero_ppc, CASE WHEN dep_clusters <> 0 THEN dep_points / dep_clusters ELSE 0 END AS dep_ppc FROM runs)
"""


@query("cluster_run_stats", sql("change", _RUNS + f"""
    SELECT location, d1, d2, ero_points, ero_clusters, ero_noise, dep_points, dep_clusters, dep_noise, {r('ed_ratio', 'ed_ratio')},
           {r('ero_noise_pct', 'ero_noise_pct')}, {r('dep_noise_pct', 'dep_noise_pct')}, {r('ero_ppc', 'ero_points_per_cluster')}, {r('dep_ppc', 'dep_points_per_cluster')} FROM rr"""))
def cluster_run_stats(spark, d):
    return stats.cluster_run_stats(changes(spark, d))


@query("cluster_totals", sql("change", _RUNS + f"""
    SELECT location, sum(ero_clusters)::BIGINT AS ero_clusters, sum(dep_clusters)::BIGINT AS dep_clusters,
      {r('sum(ero_clusters) / (sum(dep_clusters) + 0.001)', 'ed_ratio')}, {r('avg(ero_noise_pct)', 'mean_ero_noise_pct')}, {r('avg(dep_noise_pct)', 'mean_dep_noise_pct')},
      {r('sum(ero_points) / (sum(ero_clusters) + 0.001)', 'points_per_ero_cluster')}, {r('sum(dep_points) / (sum(dep_clusters) + 0.001)', 'points_per_dep_cluster')},
      {r('avg(ero_points)', 'mean_ero_points')}, {r('stddev_pop(ero_points)', 'std_ero_points')} FROM rr GROUP BY location"""))
def cluster_totals(spark, d):
    return stats.cluster_totals(cluster_run_stats(spark, d), ["location"])


@query("nearest_cluster", sql("cells dense", f"""
    , occ AS (SELECT {KEYS}, polygon_id AS p, z_idx AS zz, cluster_id FROM dense WHERE coalesce(dist, 0) <> 0 AND coalesce(cluster_id, 0) <> 0),
    hol AS (SELECT {KEYS}, polygon_id, z_idx FROM dense WHERE coalesce(dist, 0) = 0)
    SELECT {KEYS}, polygon_id, z_idx, n.d2 AS sq_dist, n.p AS near_polygon, n.zz AS near_z, n.c AS cluster_id FROM (
      SELECT {KEYS}, polygon_id, z_idx, min({{'d2': (p - polygon_id) * (p - polygon_id) + (zz - z_idx) * (zz - z_idx), 'p': p, 'zz': zz, 'c': cluster_id}}) AS n
      FROM hol JOIN occ USING ({KEYS}) GROUP BY {KEYS}, polygon_id, z_idx)"""))
def nearest_cluster(spark, d):
    return fill.nearest_cluster(dense(spark, d))


def filled(spark, d):
    return fill_from(cleaned(spark, d))


def fill_from(clean):
    return fill.fill_holes(clean.where("mode = 'erosion'").withColumn("stage", F.lit("cleaned")), 0.01, 2.0)


@query("fill_holes")
def fill_holes(spark, d):
    return filled(spark, d).select(*KEYS.split(", "), "polygon_id", "z_idx", "dist", "cluster_id", "stage")


@query("fill_stats")
def fill_stats(spark, d):
    clean = cut(cleaned(spark, d).where("mode = 'erosion'"))
    return events.fill_stats(clean, fill_from(clean), 2.0)


@query("align_cells", sql("cells dense clean", f"""
    SELECT c.location, c.mode, c.d1, c.d2, c.resolution, c.polygon_id, c.z_idx, {r('c.dist', 'dist')}, k.cluster_id, {r('c.unc', 'unc')}
    FROM cells c JOIN cleaned k USING ({KEYS}, polygon_id, z_idx) WHERE k.cluster_id <> 0"""))
def align_cells(spark, d):
    raw = cut(cells(spark, d))
    # clusters lie on cells with data, so the empty ones need not be laid out
    clean = grid.clean_cells(raw, tables.cutoffs(spark, d), 2)
    return grid.align_cells(raw, clean.where("cluster_id <> 0"), raw)


@query("alongshore_zoom", sql("cells", f"""
    SELECT polygon_id, z_idx, {r('polygon_id * resolution', 'x_m')}, {r('sum(dist)', 'cum_dist')} FROM cells
    WHERE mode = 'erosion' AND polygon_id * resolution BETWEEN 3 AND 60 GROUP BY ALL"""))
def alongshore_zoom(spark, d):
    total = grid.cumulative_grid(cells(spark, d).where("mode = 'erosion'"))
    placed = total.withColumn("x_m", alongshore_m(F.col("polygon_id"), F.col("resolution")))
    return zoom(placed, 3.0, 60.0).select("polygon_id", "z_idx", "x_m", "cum_dist")


_GROUP = "location, mode, d1, d2"


@query("change_clusters", sql("change", f"""
    , p AS (SELECT {_GROUP}, x, y, z, point_id AS id FROM modes),
    near AS (SELECT a.location, a.mode, a.d1, a.d2, a.id AS a, b.id AS b FROM p a JOIN p b USING ({_GROUP})
             WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 2.25),
    core AS (SELECT {_GROUP}, a AS id FROM near GROUP BY ALL HAVING count(*) >= 4),
    links AS (SELECT {_GROUP}, a, b FROM near SEMI JOIN core ON core.location = near.location AND core.mode = near.mode AND core.d1 = near.d1 AND core.d2 = near.d2 AND core.id = near.a),
    ll AS (SELECT {_GROUP}, a, b FROM links SEMI JOIN core ON core.location = links.location AND core.mode = links.mode AND core.d1 = links.d1 AND core.d2 = links.d2 AND core.id = links.b),
    reach AS (SELECT * FROM (WITH RECURSIVE walk(location, mode, d1, d2, id, root) AS (
        SELECT {_GROUP}, id, id FROM core UNION SELECT w.location, w.mode, w.d1, w.d2, l.b, w.root FROM walk w JOIN ll l
        ON l.location = w.location AND l.mode = w.mode AND l.d1 = w.d1 AND l.d2 = w.d2 AND l.a = w.id)
        SELECT {_GROUP}, id, min(root) AS root FROM walk GROUP BY ALL)),
    numbered AS (SELECT *, dense_rank() OVER (PARTITION BY {_GROUP} ORDER BY root) AS label FROM reach),
    border AS (SELECT {_GROUP}, a AS id, min(label) AS label FROM near JOIN numbered n USING ({_GROUP}) WHERE n.id = near.b GROUP BY ALL)
    SELECT p.location, p.mode, p.d1, p.d2, p.id AS point_id, coalesce(n.label, b.label, -1)::INTEGER AS cluster_id
    FROM p LEFT JOIN numbered n USING ({_GROUP}, id) LEFT JOIN border b USING ({_GROUP}, id)"""))
def change_clusters(spark, d):
    keys = ["location", "mode", "d1", "d2"]
    pts = changes(spark, d).select(*keys, "point_id", "x", "y", "z")
    return cluster.dbscan(pts, 1.5, 4, by=keys).select(*keys, "point_id", "cluster_id")
