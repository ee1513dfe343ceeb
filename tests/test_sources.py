import datetime
import json
import os
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThan, LessThanOrEqual
from pyspark.sql.types import StructType

from talus.config import bin_count
from talus.functions import las_records
from talus.functions.geometry import to_utm
from talus.operators import grid
from talus.sources import grids, las, points, polygons, surveys
from talus.streaming.ingest import ingest_surveys, read_table


def write_las(path, xyz, fmt=2, extra=None, minor=2):
    """Minimal LAS writer for tests."""
    extra = extra or {}
    scale, offset = 0.001, np.floor(xyz.min(axis=0)) if len(xyz) else np.zeros(3)
    dtype = np.dtype(las_records.FORMATS[fmt] + [(k, "<f4") for k in extra])
    rec = np.zeros(len(xyz), dtype)
    for i, a in enumerate("XYZ"):
        rec[a] = np.round((xyz[:, i] - offset[i]) / scale)
    rec["intensity"] = np.arange(len(xyz)) % 65536
    for k, v in extra.items():
        rec[k] = v
    vlr = b""
    if extra:
        body = b""
        for k in extra:
            d = bytearray(192)
            d[2] = 9
            d[4 : 4 + len(k)] = k.encode()
            body += bytes(d)
        vlr = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(body), b"") + body
    size = 375 if minor >= 4 else 227
    head = bytearray(size)
    head[:4], head[24], head[25] = b"LASF", 1, minor
    legacy = 0 if minor >= 4 else len(xyz)
    struct.pack_into("<HIIBHI", head, 94, size, size + len(vlr), int(bool(extra)), fmt, dtype.itemsize, legacy)
    struct.pack_into("<3d", head, 131, scale, scale, scale)
    struct.pack_into("<3d", head, 155, *offset)
    if minor >= 4:
        struct.pack_into("<Q", head, 247, len(xyz))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(bytes(head) + vlr + rec.tobytes())


def test_las_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    xyz = rng.uniform([470000, 3650000, 0], [470100, 3650100, 30], (2500, 3))
    write_las(tmp_path / "a.las", xyz, 2, {"M3C2 distance": xyz[:, 2] / 10})
    write_las(tmp_path / "b.las", xyz[:10], 7, minor=4)
    files = spark.createDataFrame([(str(tmp_path / n), 1024) for n in ("a.las", "b.las")], "path string, length long")
    got = points.read_las(files, ["x", "y", "z", "intensity", "red", "M3C2 distance"], chunk=700).toPandas()
    a = got[got.path.str.endswith("a.las")].sort_values("point_id")
    assert np.allclose(a[["x", "y", "z"]], xyz, atol=6e-4)
    assert (a.intensity == np.arange(2500)).all()
    assert np.allclose(a["M3C2 distance"], xyz[:, 2] / 10, atol=1e-5)
    assert got[got.path.str.endswith("b.las")]["M3C2 distance"].isna().all()
    stats = points.point_file_stats(files).toPandas().set_index("filename")
    assert stats.points["a.las"] == 2500 and stats.points["b.las"] == 10
    assert stats.size_mb["a.las"] == pytest.approx(1024 / 1024**2)


def test_las_writer_holds_no_second_copy(tmp_path):
    """What is written goes out piece by piece, and comes back whole."""
    n = 400_000
    made = {"point_id": np.arange(n), "x": np.arange(n) * 0.01, "y": -np.arange(n) / 7, "z": np.full(n, 3.5), "classification": np.arange(n) % 5}
    whole = pa.table(made).to_batches(max_chunksize=100_000)
    writer = las.LasWriter({"path": str(tmp_path / "out")})
    tracemalloc.start()
    done = writer.write(iter(whole))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(done.paths) == 1 and peak < os.path.getsize(done.paths[0]) * 0.8
    with open(done.paths[0], "rb") as f:
        head = las_records.read_header(f)
        assert head["count"] == n and head["bounds"] == pytest.approx((n * 0.01 - 0.01, 0, 0, -(n - 1) / 7, 3.5, 3.5))
        got = las_records.read_range(f, head, 0, n, list(made), exact=True)
    for name, v in made.items():
        assert np.abs(got[name] - v).max() <= 0.00051 * (name in "xyz")


def test_unreadable_las_reports_an_error(spark, tmp_path):
    (tmp_path / "bad.las").write_bytes(b"x" * 400)
    files = spark.createDataFrame([(str(tmp_path / "bad.las"),)], "path string")
    row = points.las_headers(files).first()
    assert row.points is None and "LAS" in row.error


def test_las_data_source(spark, tmp_path):
    las.register(spark)
    df = spark.range(5000).selectExpr(
        "id AS point_id", "480000 + id / 8 AS x", "3600000 + id % 40 / 4 AS y", "id % 30 / 2 AS z", "id % 65536 AS intensity",
        "id % 3 = 0 AS flag", "CASE WHEN id % 5 > 0 THEN id / 7 END AS share",
    )
    path = str(tmp_path / "cloud")
    df.repartitionByRange(2, "x").write.format("las").mode("append").option("recordsPerFile", 700).save(path)
    read = spark.read.format("las").option("splitBytes", 9000).load(f"file:{path}")
    assert len(list((tmp_path / "cloud").glob("*.las"))) == 8 and read.rdd.getNumPartitions() > 8
    assert dict(read.dtypes)["point_id"] == "bigint" and dict(read.dtypes)["share"] == "double"
    got = read.withColumns({c: F.round(c, 3) for c in "xyz"}).withColumn("flag", F.col("flag") == 1)
    assert got.select(*df.columns).exceptAll(df.withColumns({c: F.round(c, 3) for c in "xyz"})).isEmpty()
    assert got.select("path", "point_number").distinct().count() == 5000
    with pytest.raises(Exception, match="nulls"):
        df.withColumn("intensity", F.lit(None).cast("bigint")).write.format("las").mode("append").save(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="appended"):
        df.write.format("las").mode("overwrite").save(path)
    whole = las.read_whole(spark, path, "point_id bigint, share double, nothing double")
    assert whole.select("point_id", "share").exceptAll(df.select("point_id", "share")).isEmpty() and whole.count() == 5000
    assert whole.where("nothing IS NOT NULL").isEmpty()


def test_las_columns_and_bounds(spark, tmp_path):
    las.register(spark)
    rng = np.random.default_rng(1)
    for k in range(4):
        xyz = rng.uniform([100 * k, 0, 0], [100 * k + 99, 50, 30], (300, 3))
        write_las(tmp_path / "in" / f"{k}.las", xyz, 2, {"extra": xyz[:, 2]} if k == 2 else None)
    # the headers of these files hold no bounds, so nothing is skipped
    read = spark.read.format("las").option("mergeSchema", True).load(str(tmp_path / "in"))
    assert "extra" in read.columns and read.where("extra IS NOT NULL").count() == 300
    assert "extra" not in spark.read.format("las").load(str(tmp_path / "in")).columns
    made = tmp_path / "made"
    read.select("x", "y", "z").repartition(4, F.floor(F.col("x") / 100)).write.format("las").mode("append").save(str(made))
    files = [f for f, _ in las._listed(str(made), "*.las")]
    source = las.LasSource({"path": str(made), "skipByBounds": "true"})
    reader = source.reader(StructType.fromDDL("x double"))
    assert len(list(reader.pushFilters([GreaterThan(("x",), 250.0), LessThanOrEqual(("x",), 320.0)]))) == 2
    kept = [x for p in reader.partitions() for b in reader.read(p) for x in b["x"].to_pylist()]
    assert {x // 100 for x in kept} >= {2, 3} and len(kept) < 1200 and len(files) >= 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = spark.read.format("las").option("skipByBounds", True).schema("x double").load(str(made)).where("x > 250 AND x <= 320")
        assert some.count() == read.where("x > 250 AND x <= 320").count()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_survey_list_round_trip(spark, tmp_path):
    rows = [("DelMar", datetime.date(2020, 1, 2), 600, 630, "VMQLZ_Truck", "20200102_600_630_x"),
            ("DelMar", datetime.date(2019, 1, 2), 590, 625, "MiniRanger_ATV", "20190102_590_625")]
    df = spark.createDataFrame(rows, "location string, survey_date date, mop1 int, mop2 int, method string, folder string")
    surveys.write_surveys(df, str(tmp_path / "list"))
    assert sorted(map(tuple, surveys.read_surveys(spark, str(tmp_path / "list")).collect())) == sorted(rows)


def test_list_survey_files(spark, tmp_path):
    for name in ("20200101_500_600_a", "20200101_500", "notadate_1_2"):
        write_las(tmp_path / "mr" / name / "Sub" / f"{name}_beach_cliff_ground.las", np.zeros((1, 3)))
    got = surveys.list_survey_files(spark, {"MiniRanger_Truck": str(tmp_path / "mr")}).collect()
    assert [(r.folder, r.method, r.mop1, r.mop2) for r in got] == [("20200101_500_600_a", "MiniRanger_Truck", 500, 600)]
    assert got[0].survey_date == datetime.date(2020, 1, 1)


def test_streaming_ingest(spark, tmp_path):
    roots = {"VMQLZ_Truck": str(tmp_path / "in" / "vmqlz"), "MiniRanger_ATV": str(tmp_path / "in" / "atv")}
    table, check = str(tmp_path / "table"), str(tmp_path / "check")

    def drop(root, folder, suffix="_beach_cliff_ground.las"):
        write_las(tmp_path / "in" / root / folder / f"{folder}{suffix}", np.zeros((1, 3)))

    drop("vmqlz", "20200101_590_625_a")
    drop("vmqlz", "20200102_590_625_b", "_other.las")
    drop("atv", "20200103_700_705_c")
    ingest_surveys(spark, roots, table, check)
    listed = lambda: {(r.location, r.folder) for r in read_table(spark, table).collect()}
    assert listed() == {("DelMar", "20200101_590_625_a")}
    drop("atv", "20200105_590_625_d")
    drop("atv", "20191231_590_625_late")
    ingest_surveys(spark, roots, table, check)
    assert listed() == {("DelMar", "20200101_590_625_a"), ("DelMar", "20200105_590_625_d")}
    ingest_surveys(spark, roots, table, check)
    assert len(listed()) == 2


def test_kml_quad_and_ring_text(spark, tmp_path):
    def mark(n, c):
        return f"<Placemark><name>{n}</name><LineString><coordinates>{c}</coordinates></LineString></Placemark>"

    kml = "<kml><Document>" + mark("MOP_595", "-117.270,32.95,0 -117.26,32.951,0") + mark("OTHER", "1,2,3 4,5,6")
    kml += mark("MOP_620", " -117.275,32.975,0 -117.265,32.976,0 ") + "</Document></kml>"
    (tmp_path / "mop.kml").write_text(kml)
    lines = polygons.read_mop_lines(spark, str(tmp_path / "mop.kml"))
    assert {r.mop for r in lines.collect()} == {595, 620}
    quad = polygons.transect_quad(lines, 595, 620, 500.0).first().ring
    a, b = np.array([quad[0].x, quad[0].y]), np.array([quad[1].x, quad[1].y])
    flat = lines.where("mop = 595").select(to_utm(F.col("lon1"), F.col("lat1")).alias("p"), to_utm(F.col("lon2"), F.col("lat2")).alias("q")).first()
    length = np.hypot(flat.q.x - flat.p.x, flat.q.y - flat.p.y)
    assert np.linalg.norm(b - a) == pytest.approx(length + 1000, abs=1e-6)
    with pytest.raises(Exception, match="transect"):
        polygons.transect_quad(lines, 595, 700, 500.0).collect()
    polygons.write_ring_text(spark, [(1.5, 2.25), (3.0, 4.0)], str(tmp_path / "ring"))
    assert polygons.read_ring_text(spark, str(tmp_path / "ring")) == [(1.5, 2.25), (3.0, 4.0)]


def test_utm_reference_points(spark):
    # central meridian at the equator, and points on a meridian arc computed by series in the third flattening
    df = spark.createDataFrame([(-117.0, 0.0), (-117.0, 45.0), (-117.27, 32.95)], "lon double, lat double")
    rows = [r.p for r in df.select(to_utm(F.col("lon"), F.col("lat")).alias("p")).collect()]
    assert rows[0].x == pytest.approx(500000, abs=1e-6) and rows[0].y == pytest.approx(0, abs=1e-6)
    # meridian arc of 45 degrees on WGS84 is 4984944.378 m
    assert rows[1].x == pytest.approx(500000, abs=1e-6) and rows[1].y == pytest.approx(4984944.378 * 0.9996, abs=2e-3)
    assert 474000 < rows[2].x < 475500 and 3.64e6 < rows[2].y < 3.65e6


def test_geojson_layer(spark, tmp_path):
    feature = lambda i: {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[i, 0], [i + 1, 0], [i + 1, 5], [i, 5], [i, 0]]]}}
    (tmp_path / "p.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(i) for i in (3, 1, 2)]}))
    got = polygons.read_polygons(spark, str(tmp_path / "p.json"), "DelMar", "1m").orderBy("polygon_id").collect()
    assert [(r.polygon_id, r.ring[0].x) for r in got] == [(0, 3.0), (1, 1.0), (2, 2.0)]
    layer = polygons.read_polygons(spark, str(tmp_path / "p.json"), "DelMar", "polygons_1m")
    assert polygons.select_layer(layer, "delmar", "1M").count() == 3 and polygons.select_layer(layer, "Torrey", "1m").count() == 0


def test_grid_csv_round_trip(spark, tmp_path):
    schema = "location string, mode string, d1 date, d2 date, resolution double, polygon_id long, z_idx int, z_low double, dist double, cluster_id int"
    d1, d2 = datetime.date(2020, 1, 1), datetime.date(2020, 3, 1)
    rows = [("DelMar", "erosion", d1, d2, 0.1, 4, 3, 0.3, 0.1234567, 2), ("DelMar", "erosion", d1, d2, 0.1, 0, 299, 29.9, 1.5, 1)]
    cells = spark.createDataFrame(rows, schema)
    polys = spark.createDataFrame([("DelMar", i) for i in range(5)], "location string, polygon_id long")
    dense = grid.densify(cells, polys, 0.1, 30.0)
    assert dense.count() == 5 * bin_count(30.0, 0.1)
    grids.write_grid_csv(dense, str(tmp_path / "g"), "dist", 0.1, 30.0)
    part = next((tmp_path / "g").rglob("*.csv"))
    name = tmp_path / "20200101_to_20200301_ero_grid_10cm_cleaned.csv"
    name.write_text(part.read_text())
    header = name.read_text().splitlines()[0].split(",")
    assert header[:3] == ["Polygon_ID", "M3C2_0.00m", "M3C2_0.10m"] and len(header) == 301
    back = grids.read_grid_csv(spark, str(name), "dist", 0.1)
    assert back.count() == 1500
    got = {(r.polygon_id, r.z_idx): r for r in back.where("dist is not null").collect()}
    assert set(got) == {(4, 3), (0, 299)} and got[4, 3].dist == 0.123457
    r = got[4, 3]
    assert (r.mode, r.d1, r.d2, r.resolution, r.stage, r.z_low) == ("erosion", d1, d2, 0.1, "cleaned", 0.3)


def test_cutoff_candidates(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Polygon_ID,CliffTop_Z\n3,12.5\n")
    got = grids.read_cutoffs(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "DelMar")
    assert [tuple(r) for r in got.collect()] == [("DelMar", 3, 12.5)]
    assert grids.read_cutoffs(spark, [str(tmp_path / "a.csv")], "DelMar") is None
