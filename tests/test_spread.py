"""Work that is much for its bytes is not merged into one task."""

import pytest
from pyspark.sql import functions as F

from talus.operators import fill, grid, model


def tasks(df) -> int:
    return df.select(F.spark_partition_id().alias("t")).distinct().count()


@pytest.fixture()
def cells(spark):
    return spark.range(60).selectExpr(
        "'s' AS location", "'erosion' AS mode", "date'2020-01-01' AS d1", "date'2020-02-01' AS d2", "1.0D AS resolution",
        "id % 12 AS polygon_id", "cast(id div 12 AS int) AS z_idx", "0D AS z_low",
        "IF(id = 30, 0D, 1D + id / 60) AS dist", "IF(id = 30, 0, 1) AS cluster_id", "0.1D AS unc", "1L AS n",
    )


def test_bins_are_laid_out_by_many_tasks(spark, cells):
    polys = spark.range(300).selectExpr("'s' AS location", "id AS polygon_id")
    dense = grid.densify(cells.where("polygon_id <> 5"), polys, 1.0, 30.0)
    assert tasks(dense) > 8
    assert dense.columns[:7] == ["location", "mode", "d1", "d2", "resolution", "polygon_id", "z_idx"]
    assert dense.count() == 300 * 30 and dense.where("n IS NOT NULL").count() == 55
    found = {(r.polygon_id, r.z_idx): (r.dist, r.cluster_id) for r in dense.where("n IS NOT NULL").collect()}
    assert found == {(r.polygon_id, r.z_idx): (r.dist, r.cluster_id) for r in cells.where("polygon_id <> 5").collect()}
    assert [r.z_low for r in dense.where("polygon_id = 5").orderBy("z_idx").collect()] == [float(k) for k in range(30)]


def test_repeated_cells_and_strange_bins(spark, cells):
    """A cell that is there twice stays twice, bins outside of the grid have no place in it."""
    polys = spark.range(12).selectExpr("'s' AS location", "id AS polygon_id")
    odd = cells.where("polygon_id = 1 AND z_idx = 2").unionByName(cells.where("polygon_id = 1 AND z_idx >= 2"))
    odd = odd.unionByName(cells.where("polygon_id = 2 AND z_idx = 0").withColumn("z_idx", F.lit(99)))
    dense = grid.densify(odd, polys, 1.0, 30.0)
    assert dense.count() == 12 * 30 + 1 and dense.where("n IS NOT NULL").count() == 4


def test_tiles_are_filled_by_many_tasks(cells, monkeypatch):
    plans = []

    def noted(df, cut=fill.cut):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(fill, "cut", noted)
    fill.fill_holes(cells, 0.2, 1.0, min_volume=0.0, tile=4)
    grouped = [p for p in plans if "FlatMapCoGroupsInArrow" in p]
    assert grouped and all(p.count("REPARTITION_BY_NUM") == 2 for p in grouped)


def test_forests_grow_on_many_tasks(spark, monkeypatch):
    seen = []

    class Watched:
        def fit(self, train):
            seen.append(tasks(train))
            raise StopIteration

    monkeypatch.setattr(model, "forest", lambda *a, **k: Watched())
    rows = spark.range(4000, numPartitions=1).selectExpr(
        "id AS point_id", "id % 7D AS x", "id % 11D AS y", "id % 13D AS z", "id % 17D AS intensity", "cast(id % 2 AS int) AS label"
    )
    with pytest.raises(StopIteration):
        model.train_beach_model(rows)
    with pytest.raises(StopIteration):
        model.cross_validate(rows)
    assert min(seen) > 8


def test_bags_are_drawn_once_and_read_by_many_tasks(spark, monkeypatch):
    seen = []

    class Watched:
        def getStages(self):
            return [self]

        def setBootstrap(self, _):
            return self

        def setSubsamplingRate(self, _):
            return self

        def fit(self, train):
            seen.append((train._jdf.queryExecution().toString(), tasks(train), train.schema["label"].metadata, train.agg(F.sum("weight")).first()[0]))

    monkeypatch.setattr(model, "forest", lambda *a, **k: Watched())
    rows = spark.range(4000, numPartitions=1).selectExpr(
        "id AS point_id", "id % 7D AS x", "id % 11D AS y", "id % 13D AS z", "id % 17D AS intensity_norm", "cast(id % 2 AS int) AS label", "1D AS weight"
    )
    model.bagged_forest(rows, trees=3, bags=2, seed=4)
    assert len(seen) == 2 and not any("md5" in plan or "Exchange" in plan for plan, *_ in seen)
    assert all(count >= 8 and classes == model.TWO_CLASSES for _, count, classes, _ in seen)
    assert [total for *_, total in seen] == [rows.agg(F.sum(model.times_drawn(bag, seed=4))).first()[0] for bag in range(2)]
