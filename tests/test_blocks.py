"""Grids at size: holes are searched block by block, and empty cells are laid out once and late."""

import itertools

import numpy as np
from pyspark.sql import functions as F
from test_grid import brute_nearest, cells

from talus.operators import fill, grid


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_cluster_does_not_depend_on_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    places = list(itertools.product([p for p in range(3, 60) if p % 7], range(6)))
    occupied = {g: int(rng.integers(1, 4)) for g in places if rng.random() < 0.03 and not 20 <= g[0] < 40}
    rows = [(p, z, 1.0 if (p, z) in occupied else None, occupied.get((p, z))) for p, z in places]
    blank = cells(spark, [(p, 0, None, None) for p in range(9)], mode="deposition")
    for block in (1, 4, 512):
        monkeypatch.setattr(fill, "BLOCK", block)
        found = fill.nearest_cluster(cells(spark, rows).unionByName(blank))
        assert "lambdafunction" not in plan(found)  # offers of a column are not walked for every hole
        got = {(r.polygon_id, r.z_idx): (r.sq_dist, r.near_polygon, r.near_z, r.cluster_id) for r in found.collect()}
        assert got == {g: brute_nearest(occupied, g) for g in places if g not in occupied}


def test_bins_of_a_dense_frame_are_looked_up_not_filtered(spark):
    some = cells(spark, [(1, 0, 0.5, 7), (1, 2, 0.25, 8), (1, 2, 0.75, 9), (2, 40, 1.0, 3)])
    polys = spark.createDataFrame([("S", p) for p in (1, 2)], "location string, polygon_id long")
    dense = grid.densify(some, polys, 1.0, 4.0)
    top = plan(dense).split("Generate explode")[0]
    assert "lambdafunction" not in top
    got = sorted((r.polygon_id, r.z_idx, r.cluster_id or 0) for r in dense.collect())
    assert got == [(1, 0, 7), (1, 1, 0), (1, 2, 8), (1, 2, 9), (1, 3, 0), (2, 0, 0), (2, 1, 0), (2, 2, 0), (2, 3, 0)]


def test_queries_do_not_clean_empty_cells(spark, monkeypatch):
    import __spark_entry__ as entry

    seen = []
    clean = grid.clean_cells
    monkeypatch.setattr(grid, "clean_cells", lambda c, *a: seen.append(c.where(F.col("dist").isNull()).count()) or clean(c, *a))
    for name in ("footprint", "align_cells", "blank_intervals"):
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert seen == [0, 0, 0]
