"""Named queries over the driver tables with their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that both engines print the same value."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) + F.lit(0.0) for c in doubles}) if doubles else df


def query(name: str, sql: str | None = None, digits: int = DIGITS):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir), digits)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(expr: str, alias: str, digits: int = DIGITS) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {alias}"


def _cases(index: str, names: list[str]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


METHODS = ["VMZ2000_Truck", "MiniRanger_Truck", "VMQLZ_Truck", "MiniRanger_ATV"]
SITES = ["DelMar", "Solana", "Encinitas", "SanElijo", "Torrey", "Blacks"]
RANGES = [(595, 620), (637, 666), (708, 764), (683, 708), (567, 581), (520, 567)]

_SURVEYS = f"""
surveys AS (
  SELECT o_orderkey AS survey_id, o_orderdate::DATE AS survey_date,
         (500 + o_custkey % 250)::INTEGER AS mop1,
         (510 + o_custkey % 250 + o_orderkey % 60)::INTEGER AS mop2,
         {_cases("o_orderkey % 4", METHODS)} AS method,
         concat_ws('_', strftime(o_orderdate, '%Y%m%d'), 500 + o_custkey % 250,
                   510 + o_custkey % 250 + o_orderkey % 60, o_orderkey) AS folder
  FROM orders),
sites AS (SELECT * FROM (VALUES {", ".join(f"('{s}', {a}, {b})" for s, (a, b) in zip(SITES, RANGES))}) t(location, lo, hi)),
located AS (
  SELECT s.*, location FROM surveys s JOIN sites
  ON least(mop2, hi) - greatest(mop1, lo) >= floor((hi - lo) * 2 / 3.0)),
files AS (
  SELECT survey_id, folder, filename, root, root || '/' || folder || '/' || filename AS path FROM (
    SELECT survey_id, folder,
           folder || CASE WHEN survey_id % 5 = 0 THEN '_other.las' ELSE '_beach_cliff_ground.las' END AS filename,
           unnest(CASE WHEN survey_id % 3 = 0 THEN ['/archive/level2', '/archive/level1']
                       WHEN survey_id % 2 = 0 THEN ['/archive/level2'] ELSE ['/archive/level1'] END) AS root
    FROM surveys))
"""

_POINTS = """
points AS (
  SELECT ('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
            CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d'))), 1, 15))::BIGINT AS point_id,
         'DelMar' AS location, date_trunc('quarter', l_shipdate)::DATE AS survey_date,
         l_partkey * 0.05::DOUBLE + 0.0125::DOUBLE AS x, l_suppkey * 0.01::DOUBLE AS y,
         l_quantity * 0.5::DOUBLE + l_linenumber * 0.07::DOUBLE AS z,
         l_extendedprice AS intensity, l_returnflag AS sensor,
         CASE WHEN (l_quantity * 0.5::DOUBLE + l_linenumber * 0.07::DOUBLE < 6) <> (l_orderkey % 50 = 0)
              THEN 1 ELSE 0 END AS label
  FROM lineitem)
"""

_POLYS = """
polys AS (SELECT DISTINCT 'DelMar' AS location, p_partkey // 20 AS polygon_id FROM part),
cutoffs AS (SELECT location, polygon_id, (15 + polygon_id % 10)::DOUBLE AS cliff_top_z FROM polys WHERE polygon_id % 7 <> 0)
"""

_CHANGE = """
change AS (
  SELECT ('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
            CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d'))), 1, 15))::BIGINT AS point_id,
         'DelMar' AS location, date_trunc('quarter', l_shipdate)::DATE AS d1,
         (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH)::DATE AS d2,
         l_partkey * 0.05::DOUBLE + 0.0125::DOUBLE AS x, l_suppkey * 0.01::DOUBLE AS y,
         l_quantity * 0.5::DOUBLE + l_linenumber * 0.07::DOUBLE AS z,
         (l_discount - 0.05::DOUBLE) * 10::DOUBLE AS m3c2, l_tax AS uncertainty,
         l_linestatus = 'F' AS significant, (l_suppkey % 40 - 1)::INTEGER AS cluster_id
  FROM lineitem),
modes AS (
  SELECT *, CASE WHEN m3c2 < 0 THEN 'erosion' ELSE 'deposition' END AS mode FROM change
  WHERE significant AND abs(m3c2) >= 0.25 AND m3c2 <> 0)
"""


def _cells(name: str, res: float, height: float, keys: str = "location, mode, d1, d2") -> str:
    n = round(height / res)
    join = " AND ".join(f"b.{k.strip()} = m.{k.strip()}" for k in keys.split(",") + ["polygon_id", "z_idx"])
    cols = keys + ", polygon_id, z_idx"
    return f"""
{name}_binned AS (
  SELECT m.* EXCLUDE (z), p.polygon_id, abs(m3c2) AS d, k + (z >= (k + 1) * {res}::DOUBLE)::INTEGER - (z < k * {res}::DOUBLE)::INTEGER AS z_idx
  FROM (SELECT *, floor(z / {res}::DOUBLE)::INTEGER AS k FROM modes WHERE cluster_id <> -1 AND z >= 0 AND z < {n} * {res}::DOUBLE) m
  JOIN polys p ON x > p.polygon_id AND x < p.polygon_id + 1 AND y > -1 AND y < 1000),
{name}_mode AS (
  SELECT {cols}, cluster_id FROM (
    SELECT {cols}, cluster_id, row_number() OVER (PARTITION BY {cols} ORDER BY count(*) DESC, cluster_id) AS rn
    FROM {name}_binned GROUP BY {cols}, cluster_id) WHERE rn = 1),
{name} AS (
  SELECT b.*, m.cluster_id, round(b.z_idx * {res}::DOUBLE, 2) AS z_low, {res}::DOUBLE AS resolution FROM (
    SELECT {cols}, median(d) AS dist, sqrt(avg(uncertainty * uncertainty)) AS unc, count(*) AS n
    FROM {name}_binned GROUP BY {cols}) b JOIN {name}_mode m ON {join})
"""


# dense frame of 1 m cells, then cutoff, cluster-size threshold of 2 cells
_DENSE = """
intervals AS (SELECT DISTINCT location, mode, d1, d2, resolution FROM cells),
bins AS (SELECT unnest(range(0, 30))::INTEGER AS z_idx),
dense AS (
  SELECT f.*, c.dist, c.cluster_id, c.unc, c.n FROM (
    SELECT i.*, polygon_id, z_idx, z_idx::DOUBLE AS z_low FROM intervals i JOIN polys USING (location) CROSS JOIN bins) f
  LEFT JOIN cells c USING (location, mode, d1, d2, resolution, polygon_id, z_idx))
"""
_CLEAN = """
topped AS (
  SELECT c.* EXCLUDE (dist, cluster_id),
         c.z_low > coalesce(cliff_top_z, 9999) AND coalesce(c.dist <> 0, FALSE) AS cut,
         CASE WHEN c.z_low > coalesce(cliff_top_z, 9999) THEN 0 ELSE c.dist END AS dist,
         CASE WHEN c.z_low > coalesce(cliff_top_z, 9999) THEN 0 ELSE c.cluster_id END AS cluster_id
  FROM dense c LEFT JOIN cutoffs USING (location, polygon_id)),
sizes AS (
  SELECT location, mode, d1, d2, resolution, cluster_id, count(*) AS cells FROM topped
  WHERE cluster_id <> 0 GROUP BY ALL),
cleaned AS (
  SELECT t.* EXCLUDE (dist, cluster_id), CASE WHEN s.cells >= 2 THEN t.dist ELSE 0 END AS dist,
         CASE WHEN s.cells >= 2 THEN t.cluster_id ELSE 0 END AS cluster_id
  FROM topped t LEFT JOIN sizes s USING (location, mode, d1, d2, resolution, cluster_id))
"""

_EVENTS = """
events_ AS (
  SELECT location, mode, d1, d2, resolution, cluster_id, sum(dist * resolution * resolution) AS volume,
         sum(CASE WHEN unc > 0 THEN unc ELSE 0 END * resolution * resolution) AS vol_unc,
         sum(dist * z_low) / sum(dist) AS elevation, sum(dist * polygon_id) / sum(dist) * any_value(resolution) AS x_m,
         (max(polygon_id) - min(polygon_id) + 1) * any_value(resolution) AS width,
         (max(z_idx) - min(z_idx) + 1) * any_value(resolution) AS height,
         d1::TIMESTAMP + to_hours(12 * (d2 - d1)) AS mid
  FROM cells WHERE cluster_id <> 0 GROUP BY location, mode, d1, d2, resolution, cluster_id),
events_m AS (
  SELECT *, month(mid)::INTEGER AS month, month(mid) IN (1, 2, 3, 10, 11, 12) AS winter FROM events_),
erosion AS (SELECT * FROM events_m WHERE mode = 'erosion' AND volume >= 0.005)
"""

_CLOUD = """
cloud AS (SELECT event_id AS point_id, user_id * 0.2::DOUBLE AS x, (event_id % 97) * 0.05::DOUBLE AS y, least(value, 50) AS z FROM events)
"""

_FILES = f"""
fstats AS (
  SELECT l_orderkey AS file_id, {_cases("l_orderkey % 6", SITES)} AS location,
         CASE l_orderkey % 10 WHEN 0 THEN 'Skipped' WHEN 1 THEN 'Error' ELSE 'Success' END AS status,
         count(*) AS points, sum(l_extendedprice) / 1048576 AS size_mb, sum(l_quantity) / 10 AS duration,
         min(l_shipdate)::DATE AS survey_date
  FROM lineitem GROUP BY l_orderkey),
stage_counts AS (
  SELECT l_orderkey, min(l_shipdate)::DATE AS survey_date, sum(l_quantity)::BIGINT AS cropped,
         sum(CASE WHEN l_linenumber > 1 THEN l_quantity ELSE 0 END)::BIGINT AS nobeach,
         sum(CASE WHEN l_linenumber > 2 THEN l_quantity + 3 ELSE 0 END)::BIGINT AS noveg
  FROM lineitem GROUP BY l_orderkey),
stage_files AS (
  SELECT {_cases("l_orderkey % 6", SITES)} AS location, survey_date, stage,
         l_orderkey || '_' || stage || tag || '.las' AS filename, points + length(tag) AS points
  FROM (SELECT *, unnest(CASE WHEN l_orderkey % 4 = 0 THEN ['', '_v2'] ELSE [''] END) AS tag FROM (
    SELECT l_orderkey, survey_date, 'cropped' AS stage, cropped AS points FROM stage_counts
    UNION ALL SELECT l_orderkey, survey_date, 'nobeach', nobeach FROM stage_counts
    UNION ALL SELECT l_orderkey, survey_date, 'noveg', noveg FROM stage_counts))),
stage_best AS (
  SELECT location, survey_date, stage, arg_min(points, (length(filename), filename)) AS points FROM stage_files GROUP BY ALL),
triplets AS (
  SELECT location, survey_date, max(points) FILTER (stage = 'cropped') AS cropped,
         max(points) FILTER (stage = 'nobeach') AS nobeach, max(points) FILTER (stage = 'noveg') AS noveg
  FROM stage_best GROUP BY ALL),
composition AS (
  SELECT location, survey_date, unnest(['Beach', 'Vegetation', 'Cliff']) AS class,
         unnest([greatest(cropped - nobeach, 0) / cropped * 100, greatest(nobeach - noveg, 0) / cropped * 100,
                 noveg / cropped * 100]) AS percentage
  FROM triplets WHERE cropped > 0 AND nobeach <= cropped AND noveg <= nobeach)
"""

_PARTS = {
    "surveys": _SURVEYS,
    "points": _POINTS,
    "polys": _POLYS,
    "change": _CHANGE,
    "cells": _cells("cells", 1.0, 30.0),
    "fine": _cells("fine", 0.25, 20.0),
    "fine_whole": _cells("fine_whole", 0.25, 30.0),
    "tenth": _cells("tenth", 0.1, 30.0),
    "merged": _cells("merged", 1.0, 30.0, "location, mode"),
    "dense": _DENSE,
    "clean": _CLEAN,
    "events": _EVENTS,
    "cloud": _CLOUD,
    "files": _FILES,
}


def sql(parts: str, body: str) -> str:
    """Common table expressions by name, then the statement (which may go on with further ones)."""
    needs = {"cells": "polys change", "fine": "polys change", "fine_whole": "polys change", "tenth": "polys change", "merged": "polys change"}
    names: list[str] = []
    for part in parts.split():
        for name in needs.get(part, "").split() + [part]:
            if name not in names:
                names.append(name)
    return "WITH " + ",".join(_PARTS[n].strip() for n in names) + body
