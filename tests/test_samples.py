"""Large samples are the rows with the lowest draws, without a sort of more than those."""

import pytest
from pyspark.sql import functions as F

from talus.operators import sampling
from talus.operators.sampling import draw, sample_n


@pytest.mark.parametrize("n", [5, 300, 1999, 2000, 3000])
def test_lowest_draws(spark, monkeypatch, n):
    monkeypatch.setattr(sampling, "FEW", 10)
    df = spark.range(2000).withColumnRenamed("id", "k")
    want = [r.k for r in df.orderBy(draw("k", 4), "k").limit(n).collect()]
    assert sorted(r.k for r in sample_n(df, n, "k", 4).collect()) == sorted(want)


def test_uneven_draws_raise_the_limit(spark, monkeypatch):
    """Draws that all lie high: the first guesses find too few rows."""
    monkeypatch.setattr(sampling, "FEW", 10)
    monkeypatch.setattr(sampling, "draw", lambda key, seed: 0.9 + F.col(key) / 100_000)
    got = sample_n(spark.range(5000), 100, "id").collect()
    assert sorted(r.id for r in got) == list(range(100))


def test_large_samples_sort_little(spark):
    ordered = sample_n(spark.range(200_000), 2000, "id", 1)
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan and sample_n(spark.range(0), 2000, "id", 1).count() == 0
