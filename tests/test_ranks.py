import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talus.operators import ranks


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    g = np.where(rng.random(3000) < 0.4, "hot", rng.choice(list("abc"), 3000))
    v = np.round(rng.normal(size=3000), 2)
    v[:900] = 0.5
    pdf = pd.DataFrame({"g": g, "v": v, "id": np.arange(3000)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("hot_rows", [10, 10**6])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranked(skewed, by, hot_rows):
    pdf, df = skewed
    got = ranks.ranked(df, by, "v", sums=True, hot_rows=hot_rows).toPandas()
    groups = pdf.groupby(by)["v"] if by else [((), pdf["v"])]
    for key, vals in groups:
        mine = got[got.g == key[0]] if by else got
        assert len(mine) == vals.nunique()
        for r in mine.itertuples():
            assert r.n == (vals == r.v).sum()
            assert r.before == (vals < r.v).sum()
            assert r.total == len(vals)
            assert r.sum_before == pytest.approx(vals[vals < r.v].sum(), abs=1e-8)
            assert r.sum_total == pytest.approx(vals.sum(), abs=1e-8)


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_quantiles(skewed, hot_rows):
    pdf, df = skewed
    probs = {"lo": 0.0, "q1": 0.25, "med": 0.5, "p98": 0.98, "hi": 1.0}
    got = ranks.quantiles(df, ["g"], "v", probs, hot_rows=hot_rows).toPandas().set_index("g")
    for name, p in probs.items():
        want = pdf.groupby("g")["v"].quantile(p)
        pd.testing.assert_series_equal(got[name].sort_index(), want, check_names=False)


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_row_ranks_break_ties(skewed, hot_rows):
    pdf, df = skewed
    got = ranks.row_ranks(df, ["g"], "v", tie="id", hot_rows=hot_rows).toPandas().set_index("id")["rank"]
    want = pdf.sort_values(["v", "id"]).groupby("g").cumcount()
    assert (got.sort_index() == want.sort_index()).all()


def test_every_kth_and_limit(skewed):
    pdf, df = skewed
    got = ranks.every_kth(df, 7, ["g"], "id").toPandas()
    want = pdf[pdf.sort_values("id").groupby("g").cumcount() % 7 == 0]
    assert sorted(got.id) == sorted(want.id)
    assert ranks.limit_points(df, 5, ["g"], "id").groupBy("g").count().agg(F.max("count")).first()[0] == 5


def test_ecdf(skewed):
    pdf, df = skewed
    got = ranks.ecdf(df, [], "v").toPandas()
    for r in got.sample(20, random_state=0).itertuples():
        assert r.ecdf == pytest.approx((pdf.v <= r.v).mean())


def test_few_points_of_a_group_are_kept_before_they_move(skewed):
    pdf, df = skewed
    got = ranks.limit_points(df, 5, ["g"], "id")
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    want = pdf.sort_values("id").groupby("g").head(5)
    assert sorted(got.toPandas().id) == sorted(want.id)
    many = ranks.limit_points(df, ranks.FEW + 1, ["g"], "id").toPandas()
    assert sorted(many.id) == sorted(pdf.sort_values("id").groupby("g").head(ranks.FEW + 1).id)


def test_what_is_ranked_is_computed_once(skewed):
    pdf, df = skewed
    keyed = df.withColumn("key", F.md5(F.col("id").cast("string")))
    got = ranks.row_ranks(keyed.select("g", "key", "v", "id"), ["g"], "v", tie="id")
    assert "md5" not in got._jdf.queryExecution().executedPlan().toString()
