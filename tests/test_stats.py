import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talus.functions import naming, numeric
from talus.operators import events, inventory, model, radiometry, sampling, series, stats
from test_grid import CELLS, cells  # noqa: F401

VOLUMES = np.exp(np.random.default_rng(0).normal(0, 1.5, 500)).round(4)


@pytest.fixture(scope="module")
def volumes(spark):
    return spark.createDataFrame(pd.DataFrame({"volume": VOLUMES, "vol_unc": VOLUMES / 10, "month": np.arange(500) % 5 + 8}))


def test_zero_weight_event_has_no_centroid(spark):
    got = {r.cluster_id: r for r in events.extract_events(cells(spark, [(0, 0, 0, 1), (3, 2, 1.0, 2), (4, 2, 3.0, 2)])).collect()}
    assert got[1].elevation is None and got[1].volume == 0
    assert got[2].elevation == 2.0 and got[2].x_m == pytest.approx(3.75) and got[2].width == 2.0


def test_volume_bounds(spark):
    df = cells(spark, [(0, 0, 0.005, 1, 0.1), (1, 0, 0.3, 1, 0.4), (2, 0, 1.0, 1)])
    a = events.volume_bounds_cell(df).first()
    assert (a.volume, a.vol_lower, a.vol_upper) == pytest.approx((1.305, 0.805, 1.805))
    b = events.volume_bounds_mean(df).first()
    assert (b.volume, b.vol_lower, b.vol_upper) == pytest.approx((1.305, 0.805, 1.805))
    assert b.days == 60


def test_gini(spark):
    df = spark.createDataFrame([("a", 1.0)] * 4 + [("b", 0.0)] * 3 + [("b", 1.0)] + [("c", 0.0)], "g string, volume double")
    assert {r.g: r.gini for r in stats.gini(df, ["g"]).collect()} == pytest.approx({"a": 0.0, "b": 0.75, "c": 0.0})


def test_lorenz_and_top_share(volumes):
    v = np.sort(VOLUMES)[::-1]
    want = np.cumsum(v) / v.sum() * 100
    got = stats.lorenz(volumes, []).toPandas().sort_values("rank")
    assert len(got) == 500 and np.allclose(got.volume_pct, want) and np.allclose(got.events_pct, np.arange(1, 501) / 5)
    top = stats.top_share(volumes, []).first()
    assert top.ordinate_pct == pytest.approx(want[25]) and top.ceil_pct == pytest.approx(want[24])


def test_power_law(volumes):
    edges = np.logspace(np.log10(VOLUMES.min()), np.log10(VOLUMES.max()), 30)
    edges[0], edges[-1] = VOLUMES.min(), VOLUMES.max()
    hist, _ = np.histogram(VOLUMES, edges)
    centres = (edges[:-1] + edges[1:]) / 2
    used = (centres >= 0.25) & (hist > 0)
    slope, icpt = np.polyfit(np.log10(centres[used]), np.log10(hist[used]), 1)
    got = stats.power_law_hist(volumes).toPandas().sort_values("bin")
    assert list(got.events) == list(hist) and np.allclose(got.centre, centres)
    assert got.beta.iloc[0] == pytest.approx(-slope) and got.intercept.iloc[0] == pytest.approx(icpt)
    tail = VOLUMES[VOLUMES >= 0.25]
    assert stats.power_law_mle(volumes).first().beta == pytest.approx(1 + len(tail) / np.log(tail / 0.25).sum())
    idx = np.digitize(VOLUMES, edges)
    unc = stats.bin_uncertainty(volumes).toPandas().set_index("bin").mean_unc
    for i in range(1, 30):
        if (idx == i).any():
            assert unc[i - 1] == pytest.approx(VOLUMES[idx == i].mean() / 10)
    assert 29 not in unc.index


def test_too_few_events_for_a_fit(spark):
    df = spark.createDataFrame([(0.3,), (0.4,)], "volume double")
    assert stats.power_law_hist(df).first().beta == 0.0
    assert stats.power_law_mle(df).first().beta == 0.0


def test_months_without_events_are_zero(volumes):
    m = stats.seasonality(volumes).toPandas().set_index("month")
    assert len(m) == 12 and m.volume[1] == 0.0 and m.pct.sum() == pytest.approx(100)
    s = stats.season_summary(volumes).first()
    per = pd.Series(VOLUMES).groupby(np.arange(500) % 5 + 8).sum()
    assert s.peak_month == per.idxmax() and s.winter_pct == pytest.approx((per[10] + per[11] + per[12]) / per.sum() * 100)


def test_histogram_folds_the_maximum(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    got = {r.bin: r.rows for r in stats.histogram(df, [], "v", 5).collect()}
    assert got == dict(enumerate(np.histogram(np.arange(11), 5)[0], 1))


def test_color_limits_and_describe(volumes):
    lim = stats.color_limits(volumes, [], "volume").first()
    assert (lim.p2, lim.p98, lim["p99_5"]) == pytest.approx(tuple(np.percentile(VOLUMES, [2, 98, 99.5])))
    d = stats.describe(volumes, [], ["volume"]).first()
    assert (d.q1, d.median, d.q3, d.n) == pytest.approx((*np.percentile(VOLUMES, [25, 50, 75]), 500))


def test_tukey(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)], "g string, v double")
    assert sorted(r.v for r in stats.remove_outliers(df, ["g"], "v").collect()) == [1, 2, 3, 4]
    assert stats.class_summary(df, ["g"], "v").first()["mean"] == 2.5


def test_rolling_mean(spark):
    day = datetime.date(2020, 1, 1)
    rows = [("S", "erosion", day + datetime.timedelta(i), day + datetime.timedelta(i + 1), 1.0, float(i + 1)) for i in range(4)]
    df = spark.createDataFrame(rows, "location string, mode string, d1 date, d2 date, resolution double, volume double")
    got = [r.smooth_rate for r in series.rolling_rate(df).orderBy("d1").collect()]
    assert got == [1.5, 2.0, 3.0, 3.5]


def test_histogram_match_positions(spark):
    src = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate((7, 3, 5))], "survey_date string, point_id long, intensity double")
    ref = spark.createDataFrame([(float(v),) for v in (50, 10, 20, 40, 30)], "intensity double")
    got = {r.intensity: r.matched for r in radiometry.match_histogram(src, ref).collect()}
    assert got == {3.0: 10.0, 5.0: 30.0, 7.0: 50.0}
    assert radiometry.match_histogram(src, None).where("matched <> intensity").isEmpty()
    one = src.where("point_id = 0")
    assert radiometry.match_histogram(one, ref).first().matched == 10.0


def test_histogram_match_like_interp(spark):
    rng = np.random.default_rng(1)
    s, r = rng.integers(0, 50, 300).astype(float), rng.normal(size=77)
    src = spark.createDataFrame(pd.DataFrame({"survey_date": "d", "point_id": np.arange(300), "intensity": s}))
    got = radiometry.match_histogram(src, spark.createDataFrame(pd.DataFrame({"intensity": r}))).toPandas().sort_values("point_id").matched
    order = np.lexsort((np.arange(300), s))
    want = np.empty(300)
    want[order] = np.interp(np.linspace(0, 1, 300), np.linspace(0, 1, 77), np.sort(r))
    assert np.allclose(got, want)


def test_standardize_constant(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "intensity double")
    assert [r.intensity_norm for r in radiometry.standardize(df, radiometry.fit_scaler(df)).collect()] == [0.0, 0.0]


def test_robust_scale(spark):
    v = np.random.default_rng(2).integers(0, 60000, 500).astype(float)
    p2, p98 = np.percentile(v, (2, 98))
    want = np.clip((v - p2) / (p98 - p2) * 255, 0, 255).astype(np.uint8)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(500), "red": v, "flat": 1.0}))
    got = radiometry.robust_scale(df, ["red", "flat"]).toPandas().sort_values("i")
    assert (got.red_8bit == want).all() and (got.flat_8bit == 0).all()


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(2000).withColumnRenamed("id", "point_id")
    a = {r.point_id for r in sampling.sample_n(df, 50, "point_id", 1).collect()}
    assert len(a) == 50 and a == {r.point_id for r in sampling.sample_n(df.repartition(7), 50, "point_id", 1).collect()}
    assert abs(sampling.sample_frac(df, 0.6, "point_id").count() - 1200) < 100


def test_qc_limit(spark):
    df = spark.createDataFrame([(999,), (1000,), (1001,)], "points long")
    assert [(r.status, r.suspect) for r in numeric.qc_flag(df).collect()] == [("SUSPECT", True), ("SUSPECT", False), ("OK", False)]


def test_overlap_rule(spark):
    df = spark.createDataFrame([("a", 590, 611), ("b", 590, 612)], "folder string, mop1 int, mop2 int")
    pick = lambda strict: {r.folder for r in inventory.surveys_for_locations(df, not strict).where("location = 'DelMar'").collect()}
    assert pick(False) == {"a", "b"} and pick(True) == {"b"}


def test_late_and_duplicate_surveys(spark):
    d = datetime.date
    existing = spark.createDataFrame([("DelMar", d(2020, 1, 1), "x")], "location string, survey_date date, folder string")
    found = spark.createDataFrame([("DelMar", d(2019, 12, 31), "l"), ("DelMar", d(2020, 1, 2), "n"), ("Torrey", d(2018, 1, 1), "t")], existing.schema)
    files = spark.createDataFrame([(f, f"{f}_beach_cliff_ground.las") for f in "lnt"], "folder string, filename string")
    get = lambda late: {r.folder for r in inventory.new_surveys(existing, found, files, late).collect()}
    assert get("drop") == {"n", "t"} and get("accept") == {"l", "n", "t"}
    assert [r.folder for r in inventory.update_surveys(existing, found, files).collect()] == ["t", "x", "n"]
    twice = existing.unionByName(existing.withColumn("folder", F.lit("y")))
    assert inventory.epoch_days(twice).isEmpty()


def test_names(spark):
    df = spark.createDataFrame([("20200229_10_20_x",), ("2020_1",), ("20200229_a_20",), ("20201301_1_2",)], "n string")
    got = [r.p for r in df.select(naming.parse_survey_name(F.col("n")).alias("p")).collect()]
    assert (got[0].survey_date, got[0].mop1, got[0].mop2) == (datetime.date(2020, 2, 29), 10, 20)
    assert got[1] is None and got[2] is None and got[3].survey_date is None
    i = spark.sql("select 'a/20200101_to_20200102' n").select(naming.parse_interval(F.col("n")).alias("p")).first().p
    assert i.days == 1 and i.mid == datetime.datetime(2020, 1, 1, 12)
    t = spark.sql("select 'x2020_03_04' a, '1m' r, '25cm' q, 'M3C2_0.10m' h, ' /a/b/ ' p, '20200101.0' s").select(
        naming.parse_any_date(F.col("a")).alias("d"), naming.resolution_metres(F.col("q")).alias("q"), naming.resolution_metres(F.col("r")).alias("rm"),
        naming.resolution_tag(F.col("r")).alias("r"), naming.elev_from_label(F.col("h")).alias("h"), naming.base_name(F.col("p")).alias("p"),
        naming.strip_decimal_suffix(F.col("s")).alias("s"), numeric.snap_bin(F.lit(0.3), 0.1).alias("k")).first()
    assert tuple(t) == (datetime.date(2020, 3, 4), 0.25, 1.0, "100cm", 0.1, "b", "20200101", 3)
    names = spark.createDataFrame([("a_m3c2.las",), ("a_M3C2_clustered.las",), ("b.las",)], "n string")
    assert [r.n for r in names.where(naming.is_change_file(F.col("n"))).collect()] == ["a_m3c2.las"]


def test_sequential_pairs_within_and_across_dates(spark):
    d = datetime.date
    rows = [("S", d(2020, 1, 1), "b"), ("S", d(2020, 1, 1), "a"), ("S", d(2020, 2, 1), "c"), ("T", d(2020, 1, 5), "z")]
    df = spark.createDataFrame(rows, "location string, survey_date date, folder string")
    assert {(r.ref, r.cmp) for r in inventory.sequential_pairs(df).collect()} == {("a", "b"), ("b", "c")}


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "v string")
    assert [r.v for r in numeric.zero_fill(df, ["v"]).collect()] == [1.5, 0.0, 0.0, 0.0]
    r = spark.range(1).select(numeric.safe_pct(F.lit(1), F.lit(3)).alias("a"), numeric.safe_pct(F.lit(1), F.lit(0)).alias("b")).first()
    assert (r.a, r.b) == (33.33, 0.0)
    e = spark.createDataFrame([(1.0, 1.2, 0.5)], "volume double, vol_lower double, vol_upper double")
    assert tuple(numeric.error_bars(e).select("err_low", "err_high").first()) == (0.0, 0.0)


def test_model_learns_and_removes(spark):
    rng = np.random.default_rng(0)
    n = 1500
    pdf = pd.DataFrame(rng.uniform(0, 20, (n, 3)), columns=["x", "y", "z"]).assign(intensity=rng.uniform(0, 100, n), point_id=np.arange(n), survey_date="d")
    pdf["label"] = (pdf.z < 6).astype(int)
    df = spark.createDataFrame(pdf)
    fitted, scaler, scored = model.train_beach_model(df, seed=3, trees=10, depth=6)
    report = model.training_report(scored).first()
    assert report.test_accuracy > 0.95 and len(report.classes) == 2
    kept = model.remove_beach(df, fitted, scaler)
    assert kept.where("z < 5").count() < 20 and kept.where("z > 7").count() > 800
    row = model.removal_stats(model.score(df, fitted, scaler), ["survey_date"]).first()
    assert row.total_points == n and row.removed + row.kept == n and row.status == "Success"
    split = model.stratified_split(df, seed=1)
    assert split.where("is_test").count() == round((pdf.label == 1).sum() * 0.2) + round((pdf.label == 0).sum() * 0.2)
    with pytest.raises(ValueError):
        model.score(df.drop("z"), fitted, scaler)


def test_vegetation_removal(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"p1": np.r_[rng.normal(0.4, 0.03, 200), rng.normal(0.6, 0.03, 200)], "p2": 0.3, "label": np.r_[np.ones(200, int), np.zeros(200, int)]})
    df = spark.createDataFrame(pdf)
    fitted = model.vegetation_classifier(["p1", "p2"]).fit(df)
    kept = model.remove_vegetation(df.drop("label"), fitted).toPandas()
    assert 150 < len(kept) <= 205 and kept.p1.min() > 0.45


def test_out_of_bag_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    xyz = rng.uniform(0, 10, (400, 3))
    label = (xyz[:, 2] + rng.normal(0, 1.5, 400) < 5).astype(int)
    rows = [(i, *map(float, p), float(p[0]), int(c)) for i, (p, c) in enumerate(zip(xyz, label))]
    df = model.balanced_weights(spark.createDataFrame(rows, "point_id long, x double, y double, z double, intensity_norm double, label int"))
    df = df.cache()
    fitted = model.bagged_forest(df, trees=4, bags=3, depth=4, seed=5)
    assert [m.stages[-1].getNumTrees for m in fitted] == [2, 1, 1]
    seen, votes = [], []
    for bag, one in enumerate(fitted):
        seen.append({r.point_id: r.n for r in df.select("point_id", model.times_drawn(bag, seed=5).alias("n")).collect()})
        votes.append({r.point_id: r.rawPrediction.toArray() for r in one.transform(df).collect()})
    drawn = np.array([n for own in seen for n in own.values()])
    assert 0.3 < (drawn == 0).mean() < 0.43 and abs(drawn.mean() - 1) < 0.1
    right = total = 0
    for i in range(400):
        own = [votes[b][i] for b in range(3) if seen[b][i] == 0]
        if own:
            total += 1
            right += int(sum(own)[1] > sum(own)[0]) == label[i]
    got = model.out_of_bag(df, fitted, seed=5).first()
    assert (got.rows, got.oob_score) == (total, pytest.approx(right / total))
    every = {r.point_id: (r.bags, r.prediction) for r in model.votes(df, fitted).collect()}
    assert all(every[i] == (3, float(sum(v[i] for v in votes)[1] > sum(v[i] for v in votes)[0])) for i in range(400))


def test_cross_fitting_scores_every_row(spark):
    rows = [(i, i / 100, int(i > 50)) for i in range(100)]
    df = spark.createDataFrame(rows, "point_id long, a double, label int")
    got = model.cross_fitted(df, model.vegetation_classifier(["a"]), folds=3).collect()
    assert sorted(r.point_id for r in got) == list(range(100)) and {r.fold for r in got} == {0, 1, 2}
    assert sum(r.prediction == r.label for r in got) > 90
