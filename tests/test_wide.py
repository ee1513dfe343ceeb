"""Wide grids and back: lists instead of a sum for every cell, headers read when the query is planned."""

from pyspark.sql import functions as F

from talus.operators import grid


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_wide_and_long(spark):
    rows = [("s", p, z, None if p == 2 or z == 1 else p * 10.0 + z) for p in (1, 2, 3) for z in range(4)]
    cells = spark.createDataFrame([*rows, ("s", 1, 9, 5.0)], "location string, polygon_id long, z_idx int, dist double")
    wide = grid.to_wide(cells, "dist", 0.5, 2.0, "M3C2", ["location"])
    assert "pivotfirst" not in plan(wide)
    assert wide.columns == ["location", "polygon_id", "M3C2_0.00m", "M3C2_0.50m", "M3C2_1.00m", "M3C2_1.50m"]
    assert sorted(tuple(r)[1:] for r in wide.collect()) == [
        (1, 10.0, None, 12.0, 13.0), (2, None, None, None, None), (3, 30.0, None, 32.0, 33.0),
    ]
    long = grid.to_long(wide, ["location", "polygon_id"], 0.5, "dist")
    assert "regexp" not in plan(long) and "expand" not in plan(long)
    assert {(r.polygon_id, r.z_idx, r.dist) for r in long.collect()} == {r[1:] for r in rows}
    assert long.where(F.col("z_low") == F.col("z_idx") * 0.5).count() == 12
