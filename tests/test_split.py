"""The split ranks no more than the rows around its ends."""

import pytest
from pyspark.sql import functions as F

from talus.operators import model
from talus.operators.sampling import draw


@pytest.mark.parametrize("share", [0.0, 0.2, 1.0])
def test_split_ranks_few_rows(spark, monkeypatch, share):
    seen = []

    def noted(df, *a, f=model.row_ranks, **k):
        seen.append(df.count())
        return f(df, *a, **k)

    monkeypatch.setattr(model, "row_ranks", noted)
    # a label of every size, one of them null; ids 0 to 9 are there twice
    rows = spark.range(5000).selectExpr("id AS point_id", "IF(id < 3, NULL, IF(id % 9 = 0, 1, 0)) AS label")
    rows = rows.unionByName(rows.where("point_id < 10"))
    got = model.stratified_split(rows, share, seed=7).toPandas()
    assert len(got) == 5010 and sum(seen) < 50
    want = rows.withColumn("d", draw("point_id", 7)).toPandas().sort_values(["d", "point_id"])
    for label in (0, 1, None):
        own = want[want.label.isna() if label is None else want.label == label]
        mine = got[got.label.isna() if label is None else got.label == label]
        tests = int(len(own) * share + 0.5)
        assert sorted(mine[mine.is_test].point_id) == sorted(own.point_id[:tests])
