"""Survey inventory and job-report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import naming
from talus.functions.geometry import UTM_EASTING, UTM_K0, WGS84_A, WGS84_F, extend_line, to_utm
from talus.functions.numeric import qc_flag, safe_pct
from talus.operators import inventory, stats
from talus.operators.lineage import scratch_path
from talus.operators.series import cumulative
from talus.plans import tables
from talus.plans.registry import query, r, sql
from talus.streaming.ingest import merge_stream, read_table


def located(spark, d, floor_threshold=True):
    return inventory.surveys_for_locations(tables.surveys(spark, d), floor_threshold)


@query(
    "survey_parse",
    sql("surveys", """
    SELECT folder, strptime(split_part(folder, '_', 1), '%Y%m%d')::DATE AS survey_date,
           split_part(folder, '_', 2)::INTEGER AS mop1, split_part(folder, '_', 3)::INTEGER AS mop2,
           CASE WHEN method LIKE '%ATV%' OR method LIKE '%MiniRanger%' THEN 'MiniRanger'
                WHEN method LIKE '%VMZ2000%' THEN 'VZ2000' WHEN method LIKE '%VMQLZ%' THEN 'VMQLZ' ELSE 'Unknown' END AS sensor
    FROM surveys"""),
)
def survey_parse(spark, d):
    named = tables.surveys(spark, d).select("folder", "method")
    parsed = inventory.with_parsed_name(named)
    return parsed.select("folder", "survey_date", "mop1", "mop2", naming.sensor_label(F.col("method")).alias("sensor"))


@query("survey_overlap", sql("surveys", " SELECT location, folder, survey_date, mop1, mop2 FROM located"))
def survey_overlap(spark, d):
    return located(spark, d).select("location", "folder", "survey_date", "mop1", "mop2")


@query(
    "survey_overlap_strict",
    sql("surveys", """
    SELECT location, folder FROM surveys JOIN sites ON least(mop2, hi) - greatest(mop1, lo) >= (hi - lo) * 2 / 3.0"""),
)
def survey_overlap_strict(spark, d):
    return located(spark, d, False).select("location", "folder")


@query(
    "interval_parse",
    sql("surveys", """
    , named AS (SELECT DISTINCT survey_date AS d1, survey_date + (survey_id % 30)::INTEGER AS d2 FROM surveys)
    SELECT strftime(d1, '%Y%m%d') || '_to_' || strftime(d2, '%Y%m%d') AS interval_name, d1, d2,
           greatest(d2 - d1, 1)::INTEGER AS days, d1::TIMESTAMP + to_hours(12 * (d2 - d1)) AS mid FROM named"""),
)
def interval_parse(spark, d):
    s = tables.surveys(spark, d)
    d2 = F.date_add("survey_date", (F.col("survey_id") % 30).cast("int"))
    named = s.select(naming.interval_name(F.col("survey_date"), d2).alias("interval_name")).distinct()
    return named.withColumn("_p", naming.parse_interval(F.col("interval_name"))).select("interval_name", "_p.*")


@query(
    "sequential_pairs",
    sql("surveys", """
    SELECT location, survey_date AS d1, d2, folder AS ref, cmp FROM (
      SELECT *, lead(survey_date) OVER w AS d2, lead(folder) OVER w AS cmp FROM located
      WINDOW w AS (PARTITION BY location ORDER BY survey_date, folder)) WHERE cmp IS NOT NULL"""),
)
def sequential_pairs(spark, d):
    return inventory.sequential_pairs(located(spark, d))


_EPOCH = """
    , dates AS (SELECT DISTINCT location, survey_date FROM located),
    epochs AS (SELECT *, survey_date - lag(survey_date) OVER (PARTITION BY location ORDER BY survey_date) AS epoch_days FROM dates)
"""


@query(
    "epoch_days",
    sql("surveys", _EPOCH + "SELECT location, survey_date, epoch_days::INTEGER AS epoch_days FROM epochs WHERE epoch_days IS NOT NULL"),
)
def epoch_days(spark, d):
    return inventory.epoch_days(located(spark, d))


@query(
    "mean_epoch",
    sql("surveys", _EPOCH + f"SELECT location, count(*) AS epochs, {r('avg(epoch_days)', 'mean_days')} FROM epochs WHERE epoch_days IS NOT NULL GROUP BY location"),
)
def mean_epoch(spark, d):
    return inventory.mean_epoch(located(spark, d))


PRIORITY = {"MiniRanger_Truck": 0, "MiniRanger_ATV": 1, "VMQLZ_Truck": 2}


@query(
    "sensor_by_date",
    sql("surveys", """
    , ranked AS (SELECT survey_date, method, CASE method WHEN 'MiniRanger_Truck' THEN 0 WHEN 'MiniRanger_ATV' THEN 1
                        WHEN 'VMQLZ_Truck' THEN 2 END AS rank FROM surveys),
    best AS (SELECT survey_date, arg_min(method, rank) AS sensor FROM ranked WHERE rank IS NOT NULL GROUP BY survey_date)
    SELECT s.survey_date, coalesce(sensor, 'Unknown') AS sensor FROM (SELECT DISTINCT survey_date FROM surveys) s LEFT JOIN best USING (survey_date)"""),
)
def sensor_by_date(spark, d):
    s = tables.surveys(spark, d)
    return inventory.sensor_by_date(s.select("survey_date").distinct(), s.select("survey_date", "method"), PRIORITY)


@query(
    "survey_sensor",
    sql("surveys files", """
    , last AS (SELECT location, survey_date, arg_max(method, survey_id) AS method FROM located GROUP BY ALL)
    SELECT f.location, f.survey_date, file_id,
           CASE WHEN method LIKE '%ATV%' OR method LIKE '%MiniRanger%' THEN 'MiniRanger'
                WHEN method LIKE '%VMZ2000%' THEN 'VZ2000' WHEN method LIKE '%VMQLZ%' THEN 'VMQLZ' ELSE 'Unknown' END AS sensor
    FROM fstats f LEFT JOIN last USING (location, survey_date)"""),
)
def survey_sensor(spark, d):
    files = tables.file_stats(spark, d).select("location", "survey_date", "file_id")
    return inventory.with_sensor(files, located(spark, d), "survey_id")


@query(
    "latest_survey",
    sql("surveys", """
    SELECT location, survey_date, folder FROM (
      SELECT *, row_number() OVER (PARTITION BY location ORDER BY survey_date DESC, folder DESC) AS rn
      FROM located WHERE lower(method) LIKE '%vmqlz%') WHERE rn = 1"""),
)
def latest_survey(spark, d):
    return inventory.latest_survey(located(spark, d), "VMQLZ").select("location", "survey_date", "folder")


_KNOWN = """
    , known AS (SELECT * FROM located WHERE survey_id % 3 <> 0 AND survey_date < DATE '1999-01-01'),
    complete AS (SELECT DISTINCT folder FROM files WHERE filename LIKE '%_beach_cliff_ground.las')
"""


def _arrivals(spark, d):
    found = located(spark, d).select("location", "survey_date", "folder", "survey_id")
    existing = found.where("survey_id % 3 <> 0 AND survey_date < DATE '1999-01-01'")
    return existing, found, tables.survey_files(spark, d).select("folder", "filename")


@query(
    "new_surveys",
    sql("surveys", _KNOWN + """
    SELECT l.location, l.survey_date, l.folder, l.survey_id FROM located l SEMI JOIN complete USING (folder)
    LEFT JOIN (SELECT location, max(survey_date) AS newest FROM known GROUP BY location) m USING (location)
    WHERE newest IS NULL OR l.survey_date > newest"""),
)
def new_surveys(spark, d):
    return inventory.new_surveys(*_arrivals(spark, d))


@query(
    "late_surveys",
    sql("surveys", _KNOWN + """
    SELECT l.location, l.survey_date, l.folder, l.survey_id FROM located l SEMI JOIN complete USING (folder)
    ANTI JOIN known USING (location, folder)"""),
)
def late_surveys(spark, d):
    return inventory.new_surveys(*_arrivals(spark, d), late="accept")


@query(
    "updated_list",
    sql("surveys", _KNOWN + """
    SELECT location, survey_date, folder, survey_id FROM known UNION ALL
    SELECT l.location, l.survey_date, l.folder, l.survey_id FROM located l SEMI JOIN complete USING (folder)
    LEFT JOIN (SELECT location, max(survey_date) AS newest FROM known GROUP BY location) m USING (location)
    WHERE newest IS NULL OR l.survey_date > newest"""),
)
def updated_list(spark, d):
    return inventory.update_surveys(*_arrivals(spark, d))


@query(
    "skip_done",
    sql("surveys", """
    SELECT folder, survey_date FROM surveys WHERE folder NOT IN (SELECT folder FROM files WHERE root = '/archive/level1')"""),
)
def skip_done(spark, d):
    done = tables.survey_files(spark, d).where("root = '/archive/level1'")
    return inventory.only_missing(tables.surveys(spark, d).select("folder", "survey_date"), done, ["folder"])


@query(
    "resolve_files",
    sql("surveys", """
    SELECT folder, survey_date, arg_min(path, CASE root WHEN '/archive/level2' THEN 0 ELSE 1 END) AS file
    FROM surveys JOIN files USING (folder) GROUP BY folder, survey_date"""),
)
def resolve_files(spark, d):
    s = tables.surveys(spark, d)
    stale = s.select(F.concat(F.lit("/old/mount/"), "folder", F.lit("/")).alias("folder"), "survey_date")
    return inventory.resolve_files(stale, tables.survey_files(spark, d).select("folder", "path"), tables.ROOTS)


@query(
    "representative_files",
    sql("surveys", """
    SELECT survey_date, arg_min(filename, (length(filename), filename)) AS filename FROM surveys JOIN files USING (folder)
    GROUP BY survey_date"""),
)
def representative_files(spark, d):
    f = tables.survey_files(spark, d).join(tables.surveys(spark, d).select("folder", "survey_date"), "folder")
    return inventory.shortest_name(f.select("survey_date", "filename"), ["survey_date"])


@query(
    "first_surveys",
    sql("surveys", " SELECT location, survey_date, folder FROM located ORDER BY survey_date, location, folder LIMIT 25"),
)
def first_surveys(spark, d):
    df = located(spark, d).select("location", "survey_date", "folder")
    return inventory.first_n(df, 25, "survey_date", "location", "folder")


@query(
    "find_text",
    sql("surveys", " SELECT * FROM surveys WHERE folder LIKE '%199805%' OR method ILIKE '%199805%' OR survey_id::VARCHAR LIKE '%199805%'"),
)
def find_text(spark, d):
    return naming.any_column_contains(tables.surveys(spark, d).where("true"), "199805")


@query(
    "path_parts",
    sql("surveys", """
    SELECT '/new/root/results/' || method || '/x/' || filename AS path, method AS location, filename,
           survey_id * 7 / (1024.0 * 1024.0)::DOUBLE AS size_mb_raw FROM files JOIN surveys USING (survey_id, folder)
    """).replace("survey_id * 7 / (1024.0 * 1024.0)::DOUBLE AS size_mb_raw", "round(survey_id * 700000 / 1048576.0::DOUBLE, 6) AS size_mb, round(survey_id * 700000 / 1e9, 6) AS size_gb, strptime(left(filename, 8), '%Y%m%d')::DATE AS survey_date"),
)
def path_parts(spark, d):
    f = tables.survey_files(spark, d)
    raw = f.select(
        F.concat(F.lit("/old/root/results/"), "method", F.lit("/x/"), "filename").alias("path"),
        (F.col("survey_id") * 700000).alias("length"),
    )
    moved = raw.withColumn("path", naming.normalize_path(F.col("path"), "/old/root", "/new/root"))
    return naming.file_meta(moved).withColumn("survey_date", naming.leading_date(F.col("filename"))).drop("length")


@query("qc_flags", sql("files", """
    SELECT file_id, location, points, CASE WHEN points > 4 THEN 'OK' ELSE 'SUSPECT' END AS status, points < 4 AS suspect FROM fstats"""))
def qc_flags(spark, d):
    return qc_flag(tables.file_stats(spark, d).select("file_id", "location", "points"), 4)


@query("qc_summary", sql("files", f"""
    SELECT location, count(*) AS files, {r('avg(size_mb)', 'mean_mb')}, {r('avg(points)', 'mean_points')},
           count(*) FILTER (points < 4) AS suspects FROM fstats GROUP BY location"""))
def qc_summary(spark, d):
    return stats.qc_summary(tables.file_stats(spark, d), 4)


@query("status_summary", sql("files", f"""
    SELECT location, count(*) AS files, count(*) FILTER (status = 'Success') AS succeeded,
           count(*) FILTER (status = 'Skipped') AS skipped, count(*) FILTER (status = 'Error') AS failed,
           {r("avg(duration) FILTER (status = 'Success')", 'mean_duration')},
           (sum(points) FILTER (status = 'Success'))::BIGINT AS points FROM fstats GROUP BY location"""))
def status_summary(spark, d):
    return stats.status_summary(tables.file_stats(spark, d), ["location"])


@query("report_with_totals", sql("files", f"""
    , per AS (SELECT location, count(*) AS files, sum(points)::BIGINT AS points, sum(size_mb) AS size_mb FROM fstats GROUP BY location)
    SELECT location, files, points, {r('size_mb', 'size_mb')} FROM per UNION ALL
    SELECT 'TOTAL', sum(files)::BIGINT, sum(points)::BIGINT, {r('sum(size_mb)', 'size_mb')} FROM per"""))
def report_with_totals(spark, d):
    per = tables.file_stats(spark, d).groupBy("location").agg(
        F.count(F.lit(1)).alias("files"), F.sum("points").alias("points"), F.sum("size_mb").alias("size_mb")
    )
    return stats.with_totals(per, "location", ["files", "points", "size_mb"])


@query("stage_composition", sql("files", """
    SELECT location, survey_date, cropped, nobeach, noveg FROM triplets WHERE cropped > 0 AND nobeach <= cropped AND noveg <= nobeach"""))
def stage_composition(spark, d):
    return inventory.stage_composition(tables.stage_files(spark, d))


def composition(spark, d):
    return stats.class_composition(stage_composition(spark, d), ["location", "survey_date"])


@query("class_composition", sql("files", f" SELECT location, survey_date, class, {r('percentage', 'percentage')} FROM composition"))
def class_composition(spark, d):
    return composition(spark, d)


_TUKEY = """
    , q AS (SELECT class, quantile_cont(percentage, 0.25) AS q1, quantile_cont(percentage, 0.75) AS q3 FROM composition GROUP BY class),
    kept AS (SELECT c.* FROM composition c JOIN q USING (class)
             WHERE percentage >= q1 - 1.5 * (q3 - q1) AND percentage <= q3 + 1.5 * (q3 - q1))
"""


@query("outlier_removal", sql("files", _TUKEY + f"SELECT location, survey_date, class, {r('percentage', 'percentage')} FROM kept"))
def outlier_removal(spark, d):
    return stats.remove_outliers(composition(spark, d), ["class"], "percentage")


@query("class_summary", sql("files", _TUKEY + f"""
    SELECT class, count(*) AS n, {r('avg(percentage)', 'mean')}, {r('median(percentage)', 'median')} FROM kept GROUP BY class"""))
def class_summary(spark, d):
    return stats.class_summary(composition(spark, d), ["class"], "percentage")


@query("linear_trend", sql("files", f"""
    SELECT location, count(*) AS n, {r('regr_slope(duration, points)', 'slope')}, {r('regr_intercept(duration, points)', 'intercept')}
    FROM fstats GROUP BY location"""))
def linear_trend(spark, d):
    return stats.linear_trend(tables.file_stats(spark, d), ["location"], "points", "duration", 5)


@query("instrument_counts", sql("surveys", " SELECT method, count(*) AS rows FROM surveys GROUP BY method"))
def instrument_counts(spark, d):
    return stats.value_counts(tables.surveys(spark, d), "method")


@query("below_p99", sql("files", f"""
    SELECT file_id, {r('size_mb', 'size_mb')} FROM fstats WHERE size_mb < (SELECT quantile_cont(size_mb, 0.99) FROM fstats)"""))
def below_p99(spark, d):
    return stats.below_quantile(tables.file_stats(spark, d).select("file_id", "size_mb"), "size_mb")


@query("cumulative_files", sql("files", f"""
    , per AS (SELECT location, survey_date, sum(points)::BIGINT AS points, count(*) AS files FROM fstats GROUP BY ALL)
    SELECT *, (sum(points) OVER w)::BIGINT AS cum_points, (sum(files) OVER w)::BIGINT AS cum_files FROM per
    WINDOW w AS (PARTITION BY location ORDER BY survey_date)"""))
def cumulative_files(spark, d):
    per = tables.file_stats(spark, d).groupBy("location", "survey_date").agg(
        F.sum("points").alias("points"), F.count(F.lit(1)).alias("files")
    )
    return cumulative(per, ["points", "files"], ["location"], ("survey_date",))


@query("removal_pct", sql("files", """
    SELECT location, survey_date, CASE WHEN cropped <> 0 THEN round((cropped - nobeach) / cropped * 100, 2) ELSE 0 END AS beach_pct FROM triplets"""))
def removal_pct(spark, d):
    files = tables.stage_files(spark, d).where("stage <> 'noveg'")
    best = inventory.shortest_name(files, ["location", "survey_date", "stage"])
    wide = best.groupBy("location", "survey_date").pivot("stage", ["cropped", "nobeach"]).agg(F.first("points"))
    return wide.select("location", "survey_date", safe_pct(F.col("cropped") - F.col("nobeach"), F.col("cropped")).alias("beach_pct"))


@query("describe_surveys", sql("files", f"""
    , long AS (SELECT unnest(['size_gb', 'density']) AS measure, unnest([size_mb / 1000, points / duration]) AS value FROM fstats)
    SELECT measure, count(value) AS n, {r('avg(value)', 'mean')}, {r('sum(value)', 'total')}, {r('quantile_cont(value, 0.25)', 'q1')},
           {r('median(value)', 'median')}, {r('quantile_cont(value, 0.75)', 'q3')} FROM long GROUP BY measure"""))
def describe_surveys(spark, d):
    f = tables.file_stats(spark, d)
    return stats.describe_surveys(f.select((F.col("size_mb") / 1000).alias("size_gb"), (F.col("points") / F.col("duration")).alias("density")))


@query("survey_stream", sql("surveys", """
    SELECT location, survey_date, s.mop1, s.mop2, folder FROM surveys s JOIN sites ON least(mop2, hi) - greatest(mop1, lo) >= (hi - lo) * 2 / 3.0
    WHERE survey_id % 5 <> 0"""))
def survey_stream(spark, d):
    """Files arrive in two runs and several batches; a survey counts whenever its file comes."""
    orders = tables.table(spark, d, "orders")
    folder = scratch_path(spark)
    for run in (0, 1):
        orders.where(F.col("o_orderkey") % 2 == run).repartition(2, "o_orderkey").write.mode("append").parquet(f"{folder}/arrived")
        stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arrived")
        files = tables.survey_files_of(tables.surveys_of(stream))
        merge_stream(files, f"{folder}/table", f"{folder}/state", late="accept")
    return read_table(spark, f"{folder}/table").select("location", "survey_date", "mop1", "mop2", "folder")


@query("distinct_methods", sql("surveys", " SELECT DISTINCT method FROM surveys"))
def distinct_methods(spark, d):
    return stats.distinct_values(tables.surveys(spark, d), "method")


@query("sorted_surveys", sql("surveys", " SELECT folder, survey_date FROM surveys"))
def sorted_surveys(spark, d):
    return inventory.sort_by(tables.surveys(spark, d).select("folder", "survey_date"), "survey_date", "folder")


_N = WGS84_F / (2 - WGS84_F)
_E = 2 * _N**0.5 / (1 + _N)
_A = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)


def _utm_sql(lon: str, lat: str) -> str:
    series = lambda own, other: " + ".join(f"{a!r} * {own}(2 * {j} * xi) * {other}(2 * {j} * eta)" for j, a in enumerate(_ALPHA, 1))
    return f"""
    a AS (SELECT *, radians({lat}) AS phi, radians({lon} + 117) AS lam FROM verts),
    b AS (SELECT *, sinh(atanh(sin(phi)) - {_E!r} * atanh({_E!r} * sin(phi))) AS t FROM a),
    c AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM b),
    utm AS (SELECT *, {UTM_EASTING} + {UTM_K0 * _A!r} * (eta + {series("cos", "sinh")}) AS x,
                   {UTM_K0 * _A!r} * (xi + {series("sin", "cosh")}) AS y FROM c)"""


def _vertices(spark, d):
    s = tables.surveys(spark, d)
    return s.select(
        "survey_id",
        (F.lit(-117.3) + F.col("mop1") * 0.0003).alias("lon"),
        (F.lit(32.5) + F.col("mop2") * 0.0008).alias("lat"),
    )


_VERTS = ", verts AS (SELECT survey_id, -117.3::DOUBLE + mop1 * 0.0003::DOUBLE AS lon, 32.5::DOUBLE + mop2 * 0.0008::DOUBLE AS lat FROM surveys),"


@query("utm_vertices", sql("surveys", _VERTS + _utm_sql("lon", "lat") + f" SELECT survey_id, {r('x', 'x', 4)}, {r('y', 'y', 4)} FROM utm"), digits=4)
def utm_vertices(spark, d):
    return _vertices(spark, d).select("survey_id", to_utm(F.col("lon"), F.col("lat")).alias("p")).select("survey_id", "p.x", "p.y")


@query("extended_lines", sql("surveys", f"""
    , l AS (SELECT survey_id, mop1::DOUBLE AS x1, mop2::DOUBLE AS y1, (mop1 + survey_id % 7)::DOUBLE AS x2, (mop2 - survey_id % 5)::DOUBLE AS y2 FROM surveys),
    u AS (SELECT *, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE 500 / sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) END AS s FROM l)
    SELECT survey_id, {r('x1 - s * (x2 - x1)', 'x1')}, {r('y1 - s * (y2 - y1)', 'y1')}, {r('x2 + s * (x2 - x1)', 'x2')}, {r('y2 + s * (y2 - y1)', 'y2')} FROM u"""))
def extended_lines(spark, d):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    k = F.col("survey_id")
    lines = tables.surveys(spark, d).select(
        "survey_id",
        point(F.col("mop1"), F.col("mop2")).alias("p"),
        point(F.col("mop1") + k % 7, F.col("mop2") - k % 5).alias("q"),
    )
    p, q = extend_line(F.col("p"), F.col("q"), 500.0)
    ends = lines.select("survey_id", p.alias("a"), q.alias("b"))
    return ends.select("survey_id", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))
