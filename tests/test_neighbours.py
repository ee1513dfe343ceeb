"""Copies made for range joins: few, complete, and never broadcast."""

import math
import random

import pytest
from pyspark.sql import functions as F

from talus.operators import cluster, lineage, neighbours, thin
from talus.operators.neighbours import AXES, Cylinder, Sphere, cell_hash, cell_keys


def cloud(spark, n=400, spread=6.0, seed=1):
    rng = random.Random(seed)
    rows = [(i, *[rng.uniform(-spread, spread) for _ in AXES]) for i in range(n)]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double")


def axes(seed=2):
    rng = random.Random(seed)
    for _ in range(60):
        v = [rng.gauss(0, 1) for _ in AXES]
        norm = math.sqrt(sum(c * c for c in v))
        yield [c / norm for c in v]
    yield [0.0, 0.0, 1.0]
    yield [1.0, 0.0, 0.0]


@pytest.mark.parametrize("shape, most", [(Sphere(0.5), 5.2), (Cylinder(0.5, 2.0), 9.0)])
def test_every_member_is_met_by_few_copies(spark, shape, most):
    normals = list(axes())
    rows = [(i, *[(i * k) % 13 - 6.0 for k in (5, 7, 11)], *normals[i % len(normals)]) for i in range(124)]
    q = spark.createDataFrame(rows, "query_id long, qx double, qy double, qz double, nx double, ny double, nz double")
    # whole and quarter positions, so that members lie on edges of cells and shapes too
    grid = spark.range(36**3).selectExpr("id % 36 * 0.5D - 9 AS px", "id div 36 % 36 * 0.5D - 9 AS py", "id div 1296 * 0.5D - 9 AS pz")
    grid = grid.withColumn("k", cell_hash(cell_keys([F.col(f"p{a}") for a in AXES], shape.side)))
    inside = q.withColumn("keys", shape.keys()).crossJoin(grid).where(shape.member([F.col(f"p{a}") for a in AXES]))
    found = inside.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.array_contains("keys", F.col("k"))).alias("lost")).first()
    assert found["n"] > 124 and found["lost"] == 0
    spread = q.withColumns({f"q{a}": F.col(f"q{a}") + F.rand(i) * 10 for i, a in enumerate(AXES)})
    assert spread.agg(F.avg(F.size(shape.keys()))).first()[0] < most


@pytest.fixture()
def joins(monkeypatch):
    """Plans of everything stored on the way."""
    seen = []

    def noted(df, cut=lineage.cut):
        seen.append(df._jdf.queryExecution().toString())
        return cut(df)

    for module in (neighbours, cluster, thin):
        monkeypatch.setattr(module, "cut", noted)
    return seen


def copied_side_broadcast(plan: str) -> bool:
    """A broadcast of copies that no join or aggregate has reduced."""
    lines = plan[plan.index("== Physical Plan ==") :].split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for other in lines[i + 1 :]:
                if depth(other) <= depth(line) or "Join" in other or "Aggregate" in other:
                    break
                below.append(other)
            if any("Generate explode" in other for other in below):
                return True
    return False


def test_copies_are_not_broadcast(spark, joins):
    p = cloud(spark)
    p = lineage.cut(p)
    for out in (
        neighbours.radius_pairs(p, 0.5),
        neighbours.radius_counts(p, 0.5),
        neighbours.radius_counts(p, 4.0, leaf=4),
        cluster.dbscan(p, 1.5, 4),
        thin.thin(p, 0.5),
    ):
        joins.append(out._jdf.queryExecution().toString())
    assert not [plan for plan in joins if copied_side_broadcast(plan)]


@pytest.mark.parametrize("shape", [Sphere(0.5), Cylinder(0.3, 0.8)])
def test_dense_cells_are_searched_in_place(spark, joins, shape):
    """Queries of dense cells are not multiplied by boxes; copies, groups and rows without a group count as in a join."""
    p = cloud(spark, 6000, spread=1.0).withColumns({"w": F.lit(2), "g": F.when(F.col("point_id") % 50 > 0, F.lit("a"))})
    p = p.unionByName(p.where("point_id < 100")).unionByName(p.where("point_id < 40").withColumn("g", F.lit("b")))
    normals = list(axes())
    turned = spark.createDataFrame([(i, *normals[i % len(normals)]) for i in range(60)], "point_id long, nx double, ny double, nz double")
    q = p.where("point_id < 60").distinct().join(turned, "point_id").withColumnRenamed("point_id", "query_id").withColumn("x", F.col("x").cast("double"))
    got = neighbours.range_moments(q, p, shape, ["g"], weight="w", least="point_id").toPandas().set_index(["g", "query_id"])
    assert not [plan for plan in joins if "_whole" in plan]
    pts, asked = p.toPandas(), q.where("g IS NOT NULL").toPandas()
    assert len(got) == len(asked) and set(asked.g) == {"a", "b"}
    for row in asked.itertuples():
        own = pts[pts.g == row.g]
        d = own[list(AXES)].to_numpy() - [row.x, row.y, row.z]
        t = d @ [row.nx, row.ny, row.nz]
        hit = (d**2).sum(1) <= 0.25 if isinstance(shape, Sphere) else (abs(t) <= 0.8) & ((d**2).sum(1) - t * t <= 0.09)
        m, found = d[hit], got.loc[(row.g, row.query_id)]
        second = [(m[:, a] * m[:, b]).sum() for a in range(3) for b in range(a, 3)]
        assert found[neighbours.MOMENTS].tolist() == pytest.approx([2 * v for v in [len(m), *m.sum(0), *second]], abs=1e-8)
        assert found["least"] == own.point_id[hit].min()


def test_members_in_one_place_have_no_spread(spark):
    rows = spark.range(400).selectExpr("id AS point_id", "0.1D + 0.2D AS x", "IF(id < 300, 0.7D, 9.1D) AS y", "id div 300 * 1.1D + 0.3D AS z")
    got = neighbours.range_moments(rows.withColumnRenamed("point_id", "query_id"), rows, Sphere(0.5)).collect()
    assert len(got) == 400 and {r.n for r in got} == {300, 100}
    assert all(r[m] == 0 for r in got for m in neighbours.MOMENTS[1:])
