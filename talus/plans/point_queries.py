"""Point cloud queries: crops, joins, density, radiometry, samples, neighbourhoods, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import change, cluster, model, neighbours, radiometry, ranks, sampling, spatial, stats, thin
from talus.operators.lineage import cut
from talus.plans import tables
from talus.plans.registry import query, r, sql


@query("box_crop", sql("points", f"""
    SELECT point_id, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} FROM points WHERE x BETWEEN 2 AND 35 AND y BETWEEN 0.03 AND 0.75"""))
def box_crop(spark, d):
    return spatial.crop_box(tables.points(spark, d), 2.0, 35.0, 0.03, 0.75).select("point_id", "x", "y", "z")


@query("event_box", sql("points", f"""
    , staged AS (SELECT *, CASE WHEN label = 1 THEN 'cropped' ELSE 'nobeach' END AS stage FROM points)
    SELECT point_id, stage, survey_date, {r('z', 'z')} FROM staged
    WHERE stage IN ('nobeach', 'noveg') AND survey_date IN (DATE '1998-01-01', DATE '1999-04-01') AND x BETWEEN 2 AND 60 AND y BETWEEN 0 AND 5"""))
def event_box(spark, d):
    import datetime

    staged = tables.points(spark, d).withColumn("stage", F.when(F.col("label") == 1, "cropped").otherwise("nobeach"))
    dates = [datetime.date(1998, 1, 1), datetime.date(1999, 4, 1)]
    out = spatial.extract_box(staged, ["nobeach", "noveg"], dates, (2.0, 60.0, 0.0, 5.0))
    return out.select("point_id", "stage", "survey_date", "z")


# a pentagon with a notch
RING = [(5.0, 0.05), (40.0, 0.05), (60.0, 0.5), (40.0, 0.9), (22.0, 0.45), (5.0, 0.9)]


def _ring_sql() -> str:
    edges = list(zip(RING, RING[1:] + RING[:1]))
    odd = " + ".join(
        f"(CASE WHEN ({y1} > y) <> ({y2} > y) AND x < ({x2} - {x1})::DOUBLE * (y - {y1}) / ({y2} - {y1})::DOUBLE + {x1} THEN 1 ELSE 0 END)"
        for (x1, y1), (x2, y2) in edges
        if y1 != y2
    )
    on = " OR ".join(
        f"(({x2} - {x1})::DOUBLE * (y - {y1}) = ({y2} - {y1})::DOUBLE * (x - {x1}) AND x BETWEEN {min(x1, x2)} AND {max(x1, x2)}"
        f" AND y BETWEEN {min(y1, y2)} AND {max(y1, y2)})"
        for (x1, y1), (x2, y2) in edges
    )
    return f"({odd}) % 2 = 1 AND NOT ({on})"


@query("polygon_crop", sql("points", f" SELECT point_id, {r('x', 'x')}, {r('y', 'y')} FROM points WHERE {_ring_sql()}"))
def polygon_crop(spark, d):
    return spatial.crop_polygon(tables.points(spark, d), RING).select("point_id", "x", "y")


@query("below_ceiling", sql("points", f" SELECT survey_date, count(*) AS points, {r('max(z)', 'z_max')} FROM points WHERE z < 20 GROUP BY survey_date"))
def below_ceiling(spark, d):
    low = spatial.below(tables.points(spark, d), 20.0)
    return low.groupBy("survey_date").agg(F.count(F.lit(1)).alias("points"), F.max("z").alias("z_max"))


@query("points_in_polygons", sql("points polys", f"""
    SELECT point_id, polygon_id, {r('z', 'z')} FROM points p JOIN polys g
    ON x > g.polygon_id AND x < g.polygon_id + 1 AND y > -1 AND y < 1000"""))
def points_in_polygons(spark, d):
    joined = spatial.points_in_polygons(tables.points(spark, d), tables.polygons(spark, d))
    return joined.select("point_id", "polygon_id", "z")


@query("point_density", sql("points", f"""
    , occ AS (SELECT survey_date, floor(x / 1.0) AS gx, floor(y / 1.0) AS gy, count(*) AS n FROM points GROUP BY ALL)
    SELECT survey_date, sum(n)::BIGINT AS points, count(*) AS occupied_cells, {r('sum(n) / count(*)', 'density')} FROM occ GROUP BY survey_date"""))
def point_density(spark, d):
    return spatial.point_density(tables.points(spark, d), ["survey_date"])


@query("cloud_extent", sql("points", " SELECT survey_date, " + ", ".join(
    r(f"{fn}({a})", f"{a}_{name}") for a in "xyz" for fn, name in (("avg", "mean"), ("min", "min"), ("max", "max"))) + " FROM points GROUP BY survey_date"))
def cloud_extent(spark, d):
    return spatial.cloud_extent(tables.points(spark, d), ["survey_date"])


_MATCH = """
    , src AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY intensity, point_id) - 1 AS rank,
                     count(*) OVER (PARTITION BY {by}) AS n FROM points WHERE {src}),
    ref AS (SELECT intensity AS v, lead(intensity) OVER (ORDER BY intensity) AS nxt, row_number() OVER (ORDER BY intensity) - 1 AS pos_at
            FROM points WHERE {ref}),
    placed AS (SELECT *, CASE WHEN n > 1 THEN (rank * ((SELECT count(*) FROM ref) - 1))::DOUBLE / (n - 1) ELSE 0 END AS pos FROM src),
    matched AS (SELECT point_id, {by}, v + (coalesce(nxt, v) - v) * (pos - floor(pos)) AS matched FROM placed JOIN ref ON pos_at = floor(pos)::BIGINT)
"""


@query("histogram_match", sql("points", _MATCH.format(by="survey_date", src="TRUE", ref="survey_date = DATE '1998-01-01'")
    + f"SELECT point_id, survey_date, {r('matched', 'matched')} FROM matched"))
def histogram_match(spark, d):
    p = tables.points(spark, d).select("point_id", "survey_date", "intensity")
    out = radiometry.match_histogram(p, p.where("survey_date = DATE '1998-01-01'"))
    return out.select("point_id", "survey_date", "matched")


@query("sensor_normalization", sql("points", _MATCH.format(by="sensor", src="sensor <> 'R'", ref="sensor = 'R'") + f"""
    SELECT point_id, sensor, {r('matched', 'matched')} FROM matched
    UNION ALL SELECT point_id, sensor, {r('intensity', 'matched')} FROM points WHERE sensor = 'R'"""))
def sensor_normalization(spark, d):
    p = tables.points(spark, d).select("point_id", "sensor", "intensity")
    return radiometry.normalize_sensors(p, "R").select("point_id", "sensor", "matched")


@query("standardize", sql("points", f"""
    SELECT point_id, {r('(intensity - (SELECT avg(intensity) FROM points)) / (SELECT stddev_pop(intensity) FROM points)', 'intensity_norm')} FROM points"""))
def standardize(spark, d):
    p = tables.points(spark, d).select("point_id", "intensity")
    return radiometry.standardize(p, radiometry.fit_scaler(p)).select("point_id", "intensity_norm")


@query("robust_scale", sql("points", """
    , q AS (SELECT quantile_cont(intensity, 0.02) AS a, quantile_cont(intensity, 0.98) AS b FROM points)
    SELECT point_id, trunc(greatest(0, least(255, (intensity - a) / (b - a) * 255)))::INTEGER AS intensity_8bit FROM points, q"""))
def robust_scale(spark, d):
    p = tables.points(spark, d).select("point_id", "intensity")
    return radiometry.robust_scale(p, ["intensity"]).select("point_id", "intensity_8bit")


@query("systematic_sample", sql("points", """
    SELECT point_id, survey_date FROM (SELECT *, row_number() OVER (PARTITION BY survey_date ORDER BY point_id) - 1 AS rn FROM points) WHERE rn % 10 = 0"""))
def systematic_sample(spark, d):
    return ranks.every_kth(tables.points(spark, d).select("point_id", "survey_date"), 10, ["survey_date"], "point_id")


@query("limit_points", sql("points", """
    SELECT point_id, survey_date FROM (SELECT *, row_number() OVER (PARTITION BY survey_date ORDER BY point_id) - 1 AS rn FROM points) WHERE rn < 100"""))
def limit_points(spark, d):
    return ranks.limit_points(tables.points(spark, d).select("point_id", "survey_date"), 100, ["survey_date"], "point_id")


_DRAW = "(('0x' || substr(md5('7:' || point_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496)"


@query("sample_n", sql("points", f" SELECT point_id FROM points ORDER BY {_DRAW}, point_id LIMIT 500"))
def sample_n(spark, d):
    return sampling.sample_n(tables.points(spark, d).select("point_id"), 500, "point_id", 7)


@query("sample_frac", sql("points", f" SELECT point_id FROM points WHERE {_DRAW} < 0.6"))
def sample_frac(spark, d):
    return sampling.sample_frac(tables.points(spark, d).select("point_id"), 0.6, "point_id", 7)


@query("stratified_split", sql("points", f"""
    SELECT label, point_id, rn < round(n * 0.2) AS is_test FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_DRAW}, point_id) - 1 AS rn, count(*) OVER (PARTITION BY label) AS n FROM points)"""))
def stratified_split(spark, d):
    return model.stratified_split(tables.points(spark, d).select("label", "point_id"), seed=7)


@query("balanced_weights", sql("points", f"""
    SELECT label, count(*) AS points, {r('(SELECT count(*) FROM points) / (2.0 * count(*))', 'weight')} FROM points GROUP BY label"""))
def balanced_weights(spark, d):
    w = model.balanced_weights(tables.points(spark, d).select("label"))
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("points"), F.max("weight").alias("weight"))


_PRED = """
    , pred AS (SELECT label, CASE WHEN z < 5 THEN 1 ELSE 0 END AS prediction FROM points)
"""


def _predicted(spark, d):
    p = tables.points(spark, d)
    return p.select("label", F.when(F.col("z") < 5, 1).otherwise(0).alias("prediction"))


@query("confusion", sql("points", _PRED + "SELECT label, prediction, count(*) AS rows FROM pred GROUP BY ALL"))
def confusion(spark, d):
    return stats.confusion(_predicted(spark, d))


@query("class_scores", sql("points", _PRED + f"""
    , per AS (SELECT class, (SELECT count(*) FROM pred WHERE label = class) AS support,
                     (SELECT count(*) FROM pred WHERE prediction = class) AS predicted,
                     (SELECT count(*) FROM pred WHERE label = class AND prediction = class) AS hits FROM (VALUES (0), (1)) c(class))
    SELECT class, support, {r('hits / predicted', 'precision')}, {r('hits / support', 'recall')}, {r('2 * hits / (predicted + support)', 'f1')},
           {r('(SELECT avg((label = prediction)::INTEGER) FROM pred)', 'accuracy')} FROM per"""))
def class_scores(spark, d):
    return stats.evaluate(_predicted(spark, d))


_NEAR = """
    , keyed AS (SELECT *, floor(x / {r}) AS kx, floor(y / {r}) AS ky, floor(z / {r}) AS kz FROM cloud),
    offs AS (SELECT a.d AS dx, b.d AS dy, c.d AS dz FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d), (VALUES (-1), (0), (1)) c(d)),
    near AS (SELECT q.point_id AS a, p.point_id AS b, p.x - q.x AS x, p.y - q.y AS y, p.z - q.z AS z
             FROM (SELECT * FROM keyed, offs) q JOIN keyed p ON p.kx = q.kx + dx AND p.ky = q.ky + dy AND p.kz = q.kz + dz
             WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) <= {r} * {r})
"""


@query("radius_pairs", sql("cloud", _NEAR.format(r="0.35::DOUBLE") + f"""
    SELECT a, b, {r('sqrt(x * x + y * y + z * z)', 'distance')} FROM near WHERE a < b"""))
def radius_pairs(spark, d):
    return neighbours.radius_pairs(tables.cloud3d(spark, d), 0.35)


@query("radius_counts", sql("cloud", _NEAR.format(r="0.35::DOUBLE") + "SELECT a AS point_id, count(*) AS n FROM near GROUP BY a"))
def radius_counts(spark, d):
    return neighbours.radius_counts(tables.cloud3d(spark, d), 0.35)


@query("dbscan", sql("cloud", _NEAR.format(r="0.35::DOUBLE") + """
    , core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5),
    links AS (SELECT a, b FROM near SEMI JOIN core ON a = core.id WHERE b IN (SELECT id FROM core)),
    reach AS (SELECT * FROM (WITH RECURSIVE walk(id, root) AS (
        SELECT id, id FROM core UNION SELECT l.b, w.root FROM walk w JOIN links l ON l.a = w.id) SELECT id, min(root) AS root FROM walk GROUP BY id)),
    numbered AS (SELECT root, row_number() OVER (ORDER BY root)::INTEGER AS label FROM (SELECT DISTINCT root FROM reach)),
    labelled AS (SELECT id, label FROM reach JOIN numbered USING (root)),
    border AS (SELECT a AS id, min(label) AS label FROM near JOIN labelled ON labelled.id = near.b WHERE a NOT IN (SELECT id FROM core) GROUP BY a)
    SELECT point_id, coalesce(l.label, b.label, -1)::INTEGER AS cluster_id FROM cloud
    LEFT JOIN labelled l ON l.id = point_id LEFT JOIN border b ON b.id = point_id"""))
def dbscan(spark, d):
    return cluster.dbscan(tables.cloud3d(spark, d), 0.35, 5).select("point_id", "cluster_id")


@query("thin")
def thinned(spark, d):
    return thin.thin(tables.cloud3d(spark, d), 0.2).select("point_id", "x", "y", "z")


@query("shape_features", sql("cloud", _NEAR.format(r="0.5::DOUBLE") + f"""
    , mom AS (SELECT a, count(*) AS n, avg(x * x) - avg(x) * avg(x) AS xx, avg(x * y) - avg(x) * avg(y) AS xy, avg(x * z) - avg(x) * avg(z) AS xz,
                     avg(y * y) - avg(y) * avg(y) AS yy, avg(y * z) - avg(y) * avg(z) AS yz, avg(z * z) - avg(z) * avg(z) AS zz FROM near GROUP BY a),
    s AS (SELECT *, (xx + yy + zz) / 3 AS q,
          sqrt(((xx - (xx + yy + zz) / 3) ** 2 + (yy - (xx + yy + zz) / 3) ** 2 + (zz - (xx + yy + zz) / 3) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM mom),
    t AS (SELECT *, acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz)
                 + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p)))) / 3 AS phi FROM s WHERE n >= 3 AND xx + yy + zz > 0),
    e AS (SELECT a, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3, 3 * q AS tr FROM t)
    SELECT m.a AS point_id, m.n AS n_100cm, {r('coalesce(l1 / tr, 1 / 3.0::DOUBLE)', 'p1_100cm', 4)},
           {r('coalesce((tr - l1 - l3) / tr, 1 / 3.0::DOUBLE)', 'p2_100cm', 4)} FROM mom m LEFT JOIN e USING (a)"""), digits=4)
def shape_features(spark, d):
    return change.shape_features(tables.cloud3d(spark, d), [1.0]).select("point_id", "n_100cm", "p1_100cm", "p2_100cm")


def _two_clouds(spark, d):
    ref = tables.cloud3d(spark, d)
    return ref, ref.withColumns({"x": F.col("x") + 0.05, "z": F.col("z") + 0.3})


@query("m3c2_vertical", sql("cloud", f"""
    , a AS (SELECT *, floor(x / 0.5::DOUBLE) AS kx, floor(y / 0.5::DOUBLE) AS ky FROM cloud),
    b AS (SELECT *, floor(x / 0.5::DOUBLE) AS kx, floor(y / 0.5::DOUBLE) AS ky FROM (SELECT point_id, x + 0.05::DOUBLE AS x, y, z + 0.3::DOUBLE AS z FROM cloud)),
    offs AS (SELECT i.d AS dx, j.d AS dy FROM (VALUES (-1), (0), (1)) i(d), (VALUES (-1), (0), (1)) j(d)),
    q AS (SELECT * FROM a, offs),
    m1 AS (SELECT q.point_id, count(*) AS n, avg(p.z - q.z) AS m, var_samp(p.z - q.z) AS v FROM q JOIN a p ON p.kx = q.kx + dx AND p.ky = q.ky + dy
           WHERE abs(p.z - q.z) <= 2 AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 0.25 GROUP BY q.point_id),
    m2 AS (SELECT q.point_id, count(*) AS n, avg(p.z - q.z) AS m, var_samp(p.z - q.z) AS v FROM q JOIN b p ON p.kx = q.kx + dx AND p.ky = q.ky + dy
           WHERE abs(p.z - q.z) <= 2 AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 0.25 GROUP BY q.point_id),
    o AS (SELECT point_id, m1.n AS n_ref, m2.n AS n_cmp, m2.m - m1.m AS m3c2,
                 CASE WHEN m1.n > 1 AND m2.n > 1 THEN 1.96 * sqrt(m1.v / m1.n + m2.v / m2.n) + 0.02 END AS lod FROM m1 JOIN m2 USING (point_id))
    SELECT point_id, n_ref, n_cmp, {r('m3c2', 'm3c2')}, {r('lod', 'uncertainty')}, coalesce(abs(m3c2) > lod, FALSE) AS significant FROM o"""))
def m3c2_vertical(spark, d):
    ref, cmp = _two_clouds(spark, d)
    out = change.m3c2(ref, ref, cmp, 1.0, 1.0, 2.0, 0.02, normal="vertical")
    return out.select("point_id", "n_ref", "n_cmp", "m3c2", "uncertainty", "significant")


@query("m3c2")
def m3c2(spark, d):
    ref, cmp = _two_clouds(spark, d)
    return change.m3c2(ref, ref, cmp, 1.0, 1.0, 2.0, 0.02).select("point_id", "n_ref", "n_cmp", "m3c2", "uncertainty", "significant")


TRAINING = ["point_id", "x", "y", "z", "intensity", "label"]


@query("beach_model")
def beach_model(spark, d):
    points = tables.points(spark, d).select(*TRAINING)
    fitted, scaler, scored = model.train_beach_model(points, seed=1)
    return stats.evaluate(scored)


@query("oob_score")
def oob_score(spark, d):
    """Fifty trees in ten bags; the rows that each bag has not drawn judge it."""
    data, _ = model.prepare(tables.points(spark, d), 1)
    train = cut(model.balanced_weights(model.stratified_split(data, seed=2).where("NOT is_test")))
    return model.out_of_bag(train, model.bagged_forest(train, bags=10, seed=1), seed=1)


_BAG = """
    , drawn AS (SELECT point_id, b AS bag, ('0x' || substr(md5((700021 + b) || ':' || point_id), 1, 13))::BIGINT / pow(16::DOUBLE, 13) AS u
                FROM points, range(3) t(b)),
    times AS (SELECT bag, CASE WHEN u < exp(-1) THEN 0 WHEN u < 2 * exp(-1) THEN 1 WHEN u < 2.5 * exp(-1) THEN 2 ELSE 3 END AS times FROM drawn)
"""


@query("bag_draws", sql("points", _BAG + "SELECT bag, times, count(*) AS rows FROM times GROUP BY ALL"))
def bag_draws(spark, d):
    """How often rows are drawn into three bags; three times or more together."""
    p = tables.points(spark, d)
    draws = F.array(*[F.struct(F.lit(b).cast("bigint").alias("bag"), F.least(model.times_drawn(b, seed=7), F.lit(3)).alias("times")) for b in range(3)])
    return p.select(F.inline(draws)).groupBy("bag", "times").agg(F.count(F.lit(1)).alias("rows"))


@query("beach_removal")
def beach_removal(spark, d):
    points = tables.points(spark, d)
    fitted, scaler, _ = model.train_beach_model(points.select(*TRAINING), seed=1)
    ref = sampling.sample_n(points.select("point_id", "intensity"), 100_000, "point_id", 3)
    scored = model.score(points.select("point_id", "survey_date", "x", "y", "z", "intensity"), fitted, scaler, ref)
    return model.removal_stats(scored, ["survey_date"])


@query("cross_validate")
def cross_validate(spark, d):
    data, _ = model.prepare(tables.points(spark, d).select(*TRAINING), 1)
    return model.cross_validate(data)


@query("intensity_rank", sql("points", """
    SELECT point_id, survey_date, row_number() OVER (PARTITION BY survey_date ORDER BY intensity, point_id) - 1 AS rank,
           count(*) OVER (PARTITION BY survey_date) AS total FROM points"""))
def intensity_rank(spark, d):
    p = tables.points(spark, d).select("point_id", "survey_date", "intensity")
    return ranks.row_ranks(p, ["survey_date"], "intensity", "point_id").drop("intensity")


@query("first_member_numbers", sql("points", """
    , members AS (SELECT survey_date, min(point_id) AS member, count(*) AS points FROM points GROUP BY survey_date, sensor)
    SELECT survey_date, member, points, (dense_rank() OVER (PARTITION BY survey_date ORDER BY member))::INTEGER AS cluster_id FROM members"""))
def first_member_numbers(spark, d):
    members = tables.points(spark, d).groupBy("survey_date", "sensor").agg(
        F.min("point_id").alias("member"), F.count(F.lit(1)).alias("points")
    )
    return cluster.number_clusters(members.drop("sensor"), "member", ["survey_date"])


@query("vegetation_removal")
def vegetation_removal(spark, d):
    # uneven surroundings stand for vegetation; a tenth of the labels is turned over
    shaped = cut(change.shape_features(tables.cloud3d(spark, d), [1.0, 2.0]))
    uneven = F.col("p1_200cm") < 0.6
    marked = shaped.withColumn("label", (uneven != (F.col("point_id") % 10 == 0)).cast("int"))
    names = ["p1_100cm", "p2_100cm", "p1_200cm", "p2_200cm"]
    scored = model.cross_fitted(marked, model.vegetation_classifier(names))
    return model.keep_class(scored, 0, 0.8).select("point_id", "p1_100cm", "p1_200cm")
