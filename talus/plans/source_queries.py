"""Queries over sources and sinks: what is derived from the given tables is written and read back."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from talus.functions.naming import parse_any_date, resolution_metres, resolution_tag, resolve_column
from talus.functions.numeric import zero_fill
from talus.operators import model
from talus.operators.lineage import scratch_path
from talus.operators.spatial import crop_polygon
from talus.plans import tables
from talus.plans.grid_queries import dense
from talus.plans.inventory_queries import located
from talus.plans.registry import query, r, sql
from talus.sources import grids, las, points, polygons, surveys


def _las_columns(spark, d):
    return tables.points(spark, d).selectExpr(
        "point_id", "x", "y", "z", "cast(floor(intensity) % 65536 AS bigint) AS intensity", "label AS classification"
    )


def _las_folder(spark, d):
    path = scratch_path(spark)
    las.register(spark)
    _las_columns(spark, d).write.format("las").mode("append").option("scale", "0.0001").save(path)
    return path


_LAS = f"SELECT point_id, {r('x', 'x', 4)}, {r('y', 'y', 4)}, {r('z', 'z', 4)}, (floor(intensity)::BIGINT % 65536) AS intensity, label::BIGINT AS classification"


@query("las_points", sql("points", _LAS + " FROM points"), 4)
def las_points(spark, d):
    """All columns that the headers name; the ones asked for are decoded."""
    read = spark.read.format("las").load(_las_folder(spark, d))
    return read.select("point_id", "x", "y", "z", "intensity", "classification")


@query("las_slab", sql("points", _LAS.replace(", label::BIGINT AS classification", "") + " FROM points WHERE z > 10 AND z <= 15"), 4)
def las_slab(spark, d):
    """Some columns only, decoded by record ranges."""
    columns = "point_id bigint, x double, y double, z double, intensity bigint"
    read = spark.read.format("las").schema(columns).option("splitBytes", 1 << 20).load(_las_folder(spark, d))
    return read.where("z > 10 AND z <= 15")


@query("las_whole_files", sql("points", "SELECT point_id, label::BIGINT AS classification FROM points"))
def las_whole_files(spark, d):
    return las.read_whole(spark, _las_folder(spark, d), "point_id bigint, classification bigint")


@query("las_headers", "SELECT count(*)::BIGINT AS points, 'point_id' AS extra FROM lineitem")
def las_headers(spark, d):
    files = spark.read.format("binaryFile").load(_las_folder(spark, d)).select("path", "length")
    heads = points.point_file_stats(files)
    return heads.agg(F.sum("points").alias("points"), F.max(F.array_join("extra", ",")).alias("extra"))


@query("written_points", sql("points", f"SELECT point_id, location, survey_date, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} FROM points WHERE z < 15"))
def written_points(spark, d):
    path = scratch_path(spark)
    kept = tables.points(spark, d).where("z < 15").select("point_id", "location", "survey_date", "x", "y", "z")
    points.write_points(kept, path)
    return points.read_points(spark, path)


@query("survey_list", sql("surveys", "SELECT location, survey_date, mop1, mop2, method, folder FROM located"))
def survey_list(spark, d):
    path = scratch_path(spark)
    surveys.write_surveys(located(spark, d), path)
    return surveys.read_surveys(spark, path)


@query("cutoff_table", sql("polys", f"SELECT location, polygon_id, {r('cliff_top_z', 'cliff_top_z')} FROM cutoffs"))
def cutoff_table(spark, d):
    """The first candidate that exists."""
    path = scratch_path(spark)
    own = tables.cutoffs(spark, d).selectExpr("polygon_id AS Polygon_ID", "cliff_top_z AS CliffTop_Z")
    own.write.csv(path, header=True)
    return grids.read_cutoffs(spark, [path + "-missing", path], tables.SITE)


@query("grid_csv", sql("cells dense", f"""
    SELECT location, mode, d1, d2, resolution, polygon_id, z_idx, {r("printf('%.6g', dist)::DOUBLE", 'dist')} FROM dense"""))
def grid_csv(spark, d):
    path = scratch_path(spark)
    grids.write_grid_csv(dense(spark, d), path, "dist", 1.0, 30.0)
    return grids.read_grid_csv(spark, path, "dist", 1.0).drop("z_low")


@query("cluster_csv", sql("cells dense", "SELECT location, mode, d1, d2, resolution, polygon_id, z_idx, cluster_id FROM dense"))
def cluster_csv(spark, d):
    path = scratch_path(spark)
    grids.write_grid_csv(dense(spark, d), path, "cluster_id", 1.0, 30.0)
    return grids.read_grid_csv(spark, path, "cluster_id", 1.0).drop("z_low")


_RULE = """
    , ruled AS (SELECT survey_date, point_id, label, CASE WHEN z < 6 THEN 1 ELSE 0 END AS prediction,
                       CASE WHEN z < 6 THEN 1 - z / 60 ELSE 0.5 + least(z, 30) / 60 END AS sure FROM points)
"""


def _ruled(spark, d):
    """Predictions by a fixed rule, with the probability of each class."""
    sure = F.when(F.col("z") < 6, 1 - F.col("z") / 60).otherwise(0.5 + F.least("z", F.lit(30.0)) / 60)
    ruled = tables.points(spark, d).withColumns({"prediction": F.when(F.col("z") < 6, 1).otherwise(0), "sure": sure})
    own = F.when(F.col("prediction") == 0, F.array("sure", 1 - F.col("sure"))).otherwise(F.array(1 - F.col("sure"), "sure"))
    return ruled.withColumn("probability", array_to_vector(own))


@query("keep_class", sql("points", _RULE + "SELECT survey_date, point_id FROM ruled WHERE prediction = 0 AND sure >= 0.8"))
def keep_class(spark, d):
    return model.keep_class(_ruled(spark, d), 0, 0.8).select("survey_date", "point_id")


@query("removal_stats", sql("points", _RULE + f"""
    SELECT survey_date, count(*) AS total_points, count(*) FILTER (prediction = 1) AS removed, count(*) FILTER (prediction = 0) AS kept,
           {r('round(count(*) FILTER (prediction = 1) / count(*) * 100, 2)', 'percent_removed')},
           CASE WHEN count(*) FILTER (prediction = 0) = 0 THEN 'No Cliff Points' ELSE 'Success' END AS status FROM ruled GROUP BY survey_date"""))
def removal_stats(spark, d):
    return model.removal_stats(_ruled(spark, d), ["survey_date"])


@query("training_json", sql("points", _RULE + f"""
    SELECT {r('avg((label = prediction)::INTEGER)', 'accuracy')}, count(*) FILTER (label = 1 AND prediction = 1)::BIGINT AS hits,
           count(*) FILTER (label = 0 AND prediction = 1)::BIGINT AS false_alarms FROM ruled"""))
def training_json(spark, d):
    """The report as JSON lines, read back."""
    path = scratch_path(spark)
    surveys.write_metrics_json(model.training_report(_ruled(spark, d).select("label", F.col("prediction").cast("double"))), path)
    count = lambda a, b: F.filter("confusion", lambda c: (c["label"] == a) & (c["prediction"] == b))[0]["rows"]
    return spark.read.json(path).select(
        F.col("test_accuracy").alias("accuracy"), count(1, 1).alias("hits"), count(0, 1).alias("false_alarms")
    )


@query("two_date_forms", sql("surveys", """
    SELECT survey_id, survey_date AS found FROM surveys"""))
def two_date_forms(spark, d):
    """Names with the date together or apart."""
    own = tables.surveys(spark, d)
    apart = F.concat(F.lit("run_"), F.date_format("survey_date", "yyyy_MM_dd"), F.lit("_scan.las"))
    name = F.when(F.col("survey_id") % 2 == 0, F.col("folder")).otherwise(apart)
    return own.select("survey_id", parse_any_date(name).alias("found"))


@query("resolution_names", f"""
    SELECT p_partkey, ['10cm', '25cm', '1m'][1 + p_partkey % 3] AS name, ['10cm', '25cm', '100cm'][1 + p_partkey % 3] AS tag,
           {r("[0.1, 0.25, 1.0][1 + p_partkey % 3]::DOUBLE", 'metres')}, {r("[0.1, 0.25, 1.0][1 + p_partkey % 3]::DOUBLE", 'tag_metres')} FROM part""")
def resolution_names(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("10cm", "25cm", "1m"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    own = tables.table(spark, d, "part").select("p_partkey", name.alias("name")).withColumn("tag", resolution_tag(F.col("name")))
    return own.withColumns({"metres": resolution_metres(F.col("name")), "tag_metres": resolution_metres(F.col("tag"))})


@query("found_columns", sql("change", f"SELECT point_id, {r('m3c2', 'distance')}, {r('uncertainty', 'error')} FROM change"))
def found_columns(spark, d):
    """Columns found by parts of their names, whatever software has written them."""
    own = tables.change_points(spark, d).select(
        "point_id", F.col("m3c2").alias("M3C2 distance"), F.col("uncertainty").alias("Distance uncertainty")
    )
    distance, error = resolve_column(own, ("m3c2", "dist")), resolve_column(own, ("sigma",), ("uncert",))
    return own.select("point_id", F.col(f"`{distance}`").alias("distance"), F.col(f"`{error}`").alias("error"))


@query("zero_filled", sql("cells dense", f"""
    SELECT location, mode, d1, d2, polygon_id, z_idx, {r('coalesce(dist, 0)', 'dist')}, {r('coalesce(unc, 0)', 'unc')} FROM dense"""))
def zero_filled(spark, d):
    own = dense(spark, d)
    gap = F.when(F.col("polygon_id") % 2 == 0, F.lit(float("nan")))
    own = own.withColumns({c: F.coalesce(F.col(c), gap) for c in ("dist", "unc")})
    return zero_fill(own, ["dist", "unc"]).select("location", "mode", "d1", "d2", "polygon_id", "z_idx", "dist", "unc")


@query("crop_ring", sql("points", "SELECT point_id FROM points WHERE x > 2 AND x < 8 AND y > 0 AND y < 5 AND x + y < 10"))
def crop_ring(spark, d):
    """A crop polygon saved as text, loaded and used."""
    path = scratch_path(spark)
    polygons.write_ring_text(spark, [(2.0, 0.0), (8.0, 0.0), (8.0, 2.0), (5.0, 5.0), (2.0, 5.0)], path)
    return crop_polygon(tables.points(spark, d), polygons.read_ring_text(spark, path)).select("point_id")
