import datetime
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talus.config import RESOLUTIONS
from talus.functions import triangles
from talus.functions.naming import change_columns
from talus.functions.numeric import z_bin
from talus.operators import events, grid, spatial
from talus.operators.fill import fill_holes, nearest_cluster
from talus.plans import stages
from talus.sources import grids

D1, D2 = datetime.date(2020, 1, 1), datetime.date(2020, 3, 1)
CELLS = (
    "location string, mode string, d1 date, d2 date, resolution double, polygon_id long, z_idx int, z_low double, "
    "dist double, cluster_id int, unc double"
)


def cells(spark, rows, mode="erosion", res=1.0):
    """Rows of (polygon, bin, dist, cluster[, unc])."""
    full = [
        ("S", mode, D1, D2, res, p, z, round(z * res, 2), None if d is None else float(d), c, float(u[0]) if u else None)
        for p, z, d, c, *u in rows
    ]
    return spark.createDataFrame(full, CELLS)


def test_bin_edges(spark):
    zs = [-0.1, 0.0, 0.1, 4.3, 8.1, 8.6, 29.95, 30.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r.k for r in df.select(z_bin(F.col("z"), 0.1, 30.0).alias("k")).collect()]
    assert got == [None, 0, 1, 43, 81, 86, 299, None]


@pytest.mark.parametrize("res", [0.1, 0.25, 1.0])
def test_bins_agree_with_edges(spark, res):
    edges = np.arange(0, 30 + res, res)[: round(30 / res) + 1]
    zs = np.concatenate([edges, np.nextafter(edges, -1), np.round(edges, 2), np.random.default_rng(0).uniform(0, 30, 500)])
    want = pd.cut(pd.Series(zs), edges, right=False, labels=False)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(zs)), "z": zs}))
    got = df.select("i", z_bin(F.col("z"), res, 30.0).alias("k")).toPandas().sort_values("i").k
    assert (got.fillna(-1).to_numpy() == want.fillna(-1).to_numpy()).all()


def test_polygon_edges_match_nothing(spark):
    pts = spark.createDataFrame([("S", x, y) for x, y in ((0.0, 0.5), (1.0, 0.5), (0.5, 0.0), (0.5, 1.0), (0.5, 0.5))], "location string, x double, y double")
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    poly = spark.createDataFrame([("S", 7, square)], "location string, polygon_id long, ring array<struct<x:double,y:double>>")
    got = spatial.points_in_polygons(pts, poly, (1.0, 1.0)).collect()
    assert [(r.x, r.y, r.polygon_id) for r in got] == [(0.5, 0.5, 7)]
    slanted = spark.createDataFrame([("S", 8, square[:2] + [(1.0, 1.0), (0.5, 1.0), (0.0, 1.0)])], poly.schema)
    assert spatial.points_in_polygons(pts, slanted).count() == 1
    assert spatial.crop_polygon(pts, square).count() == 1


def test_overlapping_and_concave_polygons(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.uniform(0, 10, (400, 2)), columns=["x", "y"]).assign(location="S", id=np.arange(400))
    rings = {1: [(1, 1), (9, 1), (9, 9), (5, 3), (1, 9)], 2: [(2, 0), (8, 5), (2, 6)]}

    def inside(x, y, ring):
        hit = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    rows = [("S", k, [(float(a), float(b)) for a, b in r]) for k, r in rings.items()]
    poly = spark.createDataFrame(rows, "location string, polygon_id long, ring array<struct<x:double,y:double>>")
    want = {(r.id, k) for r in pdf.itertuples() for k, ring in rings.items() if inside(r.x, r.y, ring)}
    for cell in ((1.0, None), (2.0, 2.0)):
        got = spatial.points_in_polygons(spark.createDataFrame(pdf), poly, cell).collect()
        assert {(r.id, r.polygon_id) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("hot_cell", [10**6, 2])
def test_cell_statistics_on_both_paths(spark, hot_cell):
    rng = np.random.default_rng(1)
    n = 300
    pdf = pd.DataFrame({
        "location": "S", "mode": "erosion", "d1": D1, "d2": D2, "polygon_id": np.where(rng.random(n) < 0.5, 0, rng.integers(0, 9, n)),
        "z": rng.uniform(0, 3, n), "m3c2": -np.round(rng.random(n), 1), "cluster_id": rng.integers(1, 4, n), "uncertainty": rng.random(n),
    })
    got = grid.grid_cells(spark.createDataFrame(pdf), 1.0, 3.0, hot_cell=hot_cell).toPandas().set_index(["polygon_id", "z_idx"])
    for key, g in pdf.assign(z_idx=pdf.z.astype(int)).groupby(["polygon_id", "z_idx"]):
        r = got.loc[key]
        assert r.n == len(g)
        assert r.dist == pytest.approx(g.m3c2.abs().median())
        assert r.cluster_id == g.cluster_id.mode().iloc[0]
        assert r.unc == pytest.approx(np.sqrt((g.uncertainty**2).mean()))


def test_mode_tie_takes_the_least(spark):
    rows = [("S", "erosion", D1, D2, 0, 0.5, -0.3, c, 0.1) for c in (3, 3, 1, 1, 2)]
    df = spark.createDataFrame(rows, "location string, mode string, d1 date, d2 date, polygon_id long, z double, m3c2 double, cluster_id int, uncertainty double")
    assert grid.grid_cells(df, 1.0, 3.0).first().cluster_id == 1


def test_change_filters(spark):
    df = spark.createDataFrame([(-0.3, True), (0.25, True), (0.0, True), (0.24, True), (0.9, False)], "m3c2 double, significant boolean")
    got = {(r.m3c2, r.mode) for r in grid.split_mode(grid.significant_changes(df, 0.25)).collect()}
    assert got == {(-0.3, "erosion"), (0.25, "deposition")}
    assert grid.split_mode(grid.significant_changes(df, 0)).count() == 3
    assert grid.significant_changes(df.drop("significant"), 0.25).count() == 3


def test_column_lookup(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1)], "`M3C2 distance` double, `Distance uncertainty` double, `sig_change` int")
    assert change_columns(df) == {"m3c2": "M3C2 distance", "uncertainty": "Distance uncertainty", "significant": "sig_change"}
    with pytest.raises(KeyError):
        change_columns(df.select("sig_change"))


def test_cleaning_drops_small_clusters_and_label_zero(spark):
    df = cells(spark, [(0, 0, 1, 1), (0, 1, 1, 1), (1, 0, 1, 2), (2, 0, 1, 0), (3, 0, None, None)])
    got = {(r.polygon_id, r.z_idx): (r.dist, r.cluster_id) for r in grid.clean_cells(df, None, 2).collect()}
    assert got == {(0, 0): (1.0, 1), (0, 1): (1.0, 1), (1, 0): (0.0, 0), (2, 0): (0.0, 0), (3, 0): (0.0, 0)}


def test_cutoff(spark):
    tops = spark.createDataFrame([("S", 0, 1.0)], "location string, polygon_id long, cliff_top_z double")
    df = cells(spark, [(0, 1, 1, 1), (0, 2, 1, 1), (0, 3, 0, 0), (5, 9, 1, 1)])
    got = {(r.polygon_id, r.z_idx): (r.dist, r.cut) for r in grid.apply_cutoff(df, tops).collect()}
    assert got == {(0, 1): (1.0, False), (0, 2): (0.0, True), (0, 3): (0.0, False), (5, 9): (1.0, False)}


def test_footprint_looks_up_from_the_lowest_bin(spark):
    dep = cells(spark, [(10, 5, 1, 1), (10, 6, 1, 1), (100, 5, 1, 2), (300, 2, 1, 3), (700, 2, 1, 3)], "deposition")
    for ero, kept in (
        ([(12, 5, 1, 9)], {1}), ([(12, 4, 1, 9)], set()), ([(13, 9, 1, 9)], set()), ([(8, 7, 1, 9), (101, 5, 1, 9)], {1, 2}),
        ([(500, 2, 1, 9)], {3}), ([(500, 1, 1, 9), (702, 3, 1, 9)], {3}), ([(703, 3, 1, 9), (297, 8, 1, 9)], set()),
    ):
        out = grid.footprint_check(dep, cells(spark, ero), 2)
        assert {r.cluster_id for r in out.where("cluster_id <> 0").collect()} == kept
        assert out.count() == 5 and out.where("cluster_id = 0 and dist <> 0").isEmpty()


def test_shape_check(spark):
    first = cells(spark, [(0, 0, 1, 1), (1, 1, 2, 1)])
    later = first.withColumns({"d1": F.lit(D2), "d2": F.lit(datetime.date(2020, 5, 1))})
    odd = later.where("polygon_id = 0").withColumns({"d1": F.lit(datetime.date(2021, 1, 1)), "d2": F.lit(datetime.date(2021, 2, 1))})
    both = first.unionByName(later).unionByName(odd)
    assert {r.d1: r.same_shape for r in grid.shape_flags(both).collect()}[datetime.date(2021, 1, 1)] is False
    got = {r.polygon_id: r.cum_dist for r in grid.cumulative_grid(both, check_shape=True).collect()}
    assert got == {0: 2.0, 1: 4.0}
    assert {r.polygon_id: r.cum_dist for r in grid.cumulative_grid(both).collect()} == {0: 3.0, 1: 4.0}


def test_pick_stage(spark):
    df = cells(spark, [(0, 0, 1, 1)])
    both = df.withColumn("stage", F.lit("raw")).unionByName(df.withColumn("stage", F.lit("cleaned")))
    assert [r.stage for r in grid.pick_stage(both).collect()] == ["cleaned"]


def brute_nearest(occupied, hole):
    return min(((hole[0] - p) ** 2 + (hole[1] - z) ** 2, p, z, c) for (p, z), c in occupied.items())


def test_nearest_cluster_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    grid_cells = list(itertools.product(range(15), range(8)))
    occupied = {g: int(rng.integers(1, 4)) for g in grid_cells if rng.random() < 0.1}
    rows = [(p, z, 1.0 if (p, z) in occupied else 0.0, occupied.get((p, z), 0)) for p, z in grid_cells]
    got = nearest_cluster(cells(spark, rows)).collect()
    assert len(got) == len(grid_cells) - len(occupied)
    for r in got:
        assert (r.sq_dist, r.near_polygon, r.near_z, r.cluster_id) == brute_nearest(occupied, (r.polygon_id, r.z_idx))


def test_fill_restores_a_plane(spark):
    plane = lambda p, z: 0.2 + 0.01 * p + 0.02 * z
    rows = []
    for p, z in itertools.product(range(30), range(12)):
        gap = 12 <= p <= 15 and 4 <= z <= 6
        inside = 5 <= p <= 24 and 2 <= z <= 9
        small = (p, z) in ((0, 0), (1, 0), (0, 2), (1, 2))
        solid = inside and not gap
        rows.append((p, z, plane(p, z) if solid else 0.1 if small else 0.0, 1 if solid else 2 if small else 0))
    r = RESOLUTIONS["10cm"]
    got = fill_holes(cells(spark, rows), r.alpha, r.buffer, min_volume=2.0).toPandas().set_index(["polygon_id", "z_idx"])
    for p, z, d, c in rows:
        row = got.loc[(p, z)]
        if 12 <= p <= 15 and 4 <= z <= 6:
            assert row.dist == pytest.approx(plane(p, z)) and row.cluster_id == 1
        else:
            assert row.dist == d and row.cluster_id == c
    assert len(got) == len(rows)
    stats = events.fill_stats(cells(spark, rows), fill_holes(cells(spark, rows), r.alpha, r.buffer), 2.0).first()
    assert (stats.holes_filled, stats.clusters_processed, stats.clusters_skipped) == (12, 1, 1)
    assert stats.volume_change == pytest.approx(sum(plane(p, z) for p in range(12, 16) for z in range(4, 7)))


def blobs(seed, wide, high):
    """Two ragged clusters with gaps, a thin one and three cells far apart."""
    rng = np.random.default_rng(seed)
    rows = {}
    for p, z in itertools.product(range(wide), range(high)):
        left = abs(p - wide * 0.3) < wide * 0.22 and rng.random() < 0.25
        right = 0.55 * wide < p < 0.9 * wide and z < high * 0.8 and not (0.65 * wide < p < 0.8 * wide and z > high * 0.2)
        if left or right:
            rows[p, z] = 1 if left else 2
    for k in range(3):
        rows[wide + 2 + 6 * k, high - 1 - (k % 2) * (high - 3)] = 3
    value = lambda p, z: float(1 + rng.integers(1, 50) / 10)
    return [(p, z, value(p, z) if (p, z) in rows else 0.0, rows.get((p, z), 0)) for p, z in itertools.product(range(wide + 20), range(high))]


def brute_fill(rows, radius, buffer):
    """Each hole by the whole triangulation of its nearest cluster."""
    occupied = {(p, z): c for p, z, d, c in rows if d}
    value = {(p, z): d for p, z, d, c in rows if d}
    out = {}
    shapes = {}
    for c in set(occupied.values()):
        points = [k for k, own in occupied.items() if own == c]
        shape = triangles.Shape(points, (-np.inf, np.inf, -np.inf, np.inf), triangles.hull(points), radius, buffer)
        shape.convex = not triangles.has_narrow(shape)
        shapes[c] = shape, [value[k] for k in points]
    for p, z, d, _ in rows:
        if not d:
            c = brute_nearest(occupied, (p, z))[3]
            state, v = triangles.fill(*shapes[c], [(p, z)])[0]
            if state == triangles.Shape.IN:
                out[p, z] = (c, v)
    return out, {c: s.convex for c, (s, _) in shapes.items()}


def test_fill_does_not_depend_on_tiles(spark):
    rows = blobs(3, 44, 26)
    want, convex = brute_fill(rows, 4.0, 0.7)
    assert convex == {1: False, 2: False, 3: True} and {c for c, _ in want.values()} == {1, 2, 3}
    dense = cells(spark, rows)
    for tile, offset in ((None, 0), (8, 5), (3, 1), (200, 0)):
        filled = fill_holes(dense, 0.25, 0.7, min_volume=0.0, tile=tile, offset=offset).collect()
        holes = {(p, z) for p, z, d, _ in rows if not d}
        got = {(r.polygon_id, r.z_idx): (r.cluster_id, r.dist) for r in filled if (r.polygon_id, r.z_idx) in holes and r.dist}
        assert got.keys() == want.keys()
        assert all(got[k][0] == c and got[k][1] == pytest.approx(v) for k, (c, v) in want.items())


def test_fill_of_three_cells_and_of_a_line(spark):
    rows = [(0, 0, 3.0, 1), (30, 0, 3.0, 1), (15, 24, 3.0, 1), (60, 2, 5.0, 2), (64, 2, 5.0, 2), (70, 2, 5.0, 2)]
    taken = {(p, z) for p, z, _, _ in rows}
    rows += [(p, z, 0.0, 0) for p, z in itertools.product(range(75), range(25)) if (p, z) not in taken]
    got = fill_holes(cells(spark, rows), 0.1, 0.2, min_volume=0.0).where("dist <> 0").collect()
    inside = {(r.polygon_id, r.z_idx) for r in got}
    assert (15, 8) in inside and {r.dist for r in got if r.cluster_id == 1} == {3.0}
    assert {k for k in inside if k[0] >= 40} == {(60, 2), (64, 2), (70, 2)}


def test_finished_grid_and_events(spark, tmp_path):
    rows = [(p, z, 0.5, 1) for p in range(3, 9) for z in range(2, 7) if (p, z) != (5, 4)]
    raw = cells(spark, rows).unionByName(cells(spark, [(4, 4, 0.3, 1), (5, 4, 0.3, 1), (30, 4, 0.2, 2)], "deposition"))
    polys = spark.createDataFrame([("S", i) for i in range(40)], "location string, polygon_id long")
    done = stages.finished_grid(raw, polys, None, "S", RESOLUTIONS["1m"])
    filled = done.where("stage = 'filled' and polygon_id = 5 and z_idx = 4").first()
    assert filled.dist == pytest.approx(0.5) and filled.cluster_id == 1
    dep = done.where("mode = 'deposition' and cluster_id <> 0")
    assert {r.cluster_id for r in dep.collect()} == {1}
    ev = stages.events_of(done, 0.005).collect()
    assert len(ev) == 1 and ev[0].volume == pytest.approx(15.0) and ev[0].width == 6.0 and ev[0].height == 5.0
    assert ev[0].mid == datetime.datetime(2020, 1, 31) and ev[0].month == 1 and ev[0].winter


def test_transpose_and_wide(spark):
    df = cells(spark, [(0, 0, 1, 1), (1, 2, 3, 1)])
    t = {r.z_idx: (r["0"], r["1"]) for r in grid.to_elevation_rows(df, "dist", [0, 1], ["mode"]).collect()}
    assert t == {0: (1.0, None), 2: (None, 3.0)}
    wide = grid.to_wide(df, "cluster_id", 1.0, 3.0, grids.PREFIX["cluster_id"], ["mode"])
    assert wide.columns == ["mode", "polygon_id", "ClusterID_0.00m", "ClusterID_1.00m", "ClusterID_2.00m"]
