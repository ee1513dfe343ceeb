"""Forests grown on counts of cells against trees grown row by row, and against MLlib's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.functions import trees
from talus.operators import model


def brute(rows, labels, weights, depth):
    """Nested splits of whole rows: (feature, last value on the left, left, right) or the share of each class."""
    total = np.bincount(labels, weights, 2)
    share = total / total.sum()
    best = None
    for f in range(rows.shape[1]):
        for end in range(rows[:, f].max()):
            left = np.bincount(labels[rows[:, f] <= end], weights[rows[:, f] <= end], 2)
            right = total - left
            if left.sum() > 1e-9 and right.sum() > 1e-9:
                gini = [s.sum() - (s**2).sum() / s.sum() for s in (total, left, right)]
                gain = (gini[0] - gini[1] - gini[2]) / total.sum()
                if best is None or gain > best[0] + 1e-12:
                    best = gain, f, end
    if not depth or best is None or best[0] <= 1e-12:
        return share
    low = rows[:, best[1]] <= best[2]
    parts = [brute(rows[m], labels[m], weights[m], depth - 1) for m in (low, ~low)]
    if all(isinstance(p, np.ndarray) for p in parts) and parts[0].argmax() == parts[1].argmax():
        return share
    return best[1], best[2], *parts


def says(tree, row):
    while not isinstance(tree, np.ndarray):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_a_tree_of_cells_is_the_tree_of_their_rows():
    rng = np.random.default_rng(2)
    shape = [5, 4, 1, 3]
    for seed in range(20):
        cells = np.sort(rng.integers(0, 60, 40))
        labels = ((cells // 12 + rng.integers(0, 3, 40)) > 3).astype(np.int32)
        counts, weights = rng.integers(1, 6, 40), np.where(labels == 1, 0.75, 1.5)
        leaves = trees.grow(cells, labels, counts, weights, shape, 2, 4, 4, [seed])
        table = trees.votes([leaves], shape, 2)
        assert table.sum(1) == pytest.approx(np.ones(60))
        drawn = np.random.default_rng([seed]).poisson(counts)
        rows = np.repeat(np.array(np.unravel_index(cells, shape)).T, drawn, axis=0)
        tree = brute(rows, np.repeat(labels, drawn), np.repeat(weights, drawn), 4)
        for cell in range(60):
            assert table[cell] == pytest.approx(says(tree, np.unravel_index(cell, shape)))


def test_thresholds_hold_equal_weights():
    values = np.arange(100.0)
    assert list(trees.weighted_cuts(values, np.ones(100), 4)) == [24, 49, 74]
    assert list(trees.weighted_cuts(values, np.where(values < 20, 4.0, 1.0), 4)) == [9, 19, 59]
    assert list(trees.weighted_cuts(np.array([3.0, 1.0, 3.0, 1.0]), np.ones(4), 32)) == [1]
    codes = trees.codes([np.array([1.0, 2.0, 2.1]), np.array([0.0, 5.0, 6.0])], [np.array([1.0, 2.0]), np.array([5.0])])
    assert list(codes) == [0, 2, 5]
    with pytest.raises(ValueError):
        trees.codes([np.array([np.nan])], [np.array([1.0])])


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    xyz = rng.uniform(0, 10, (3000, 4))
    label = (xyz[:, 2] + 0.3 * xyz[:, 3] + rng.normal(0, 0.5, 3000) < 5).astype(int)
    data = [(i, *map(float, p), int(c)) for i, (p, c) in enumerate(zip(xyz, label))]
    df = spark.createDataFrame(data, "point_id long, x double, y double, z double, intensity_norm double, label int")
    weighted = model.balanced_weights(df).cache()
    weighted.count()
    return weighted


def test_rows_are_passed_over_twice_however_deep_the_trees(spark, rows):
    tracker = spark.sparkContext.statusTracker()

    def jobs(depth):
        spark.sparkContext.setJobGroup(f"depth{depth}", "")
        fitted = model.forest(trees=4, depth=depth, seed=1).fit(rows)
        found = len(tracker.getJobIdsForGroup(f"depth{depth}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return fitted, found

    (_, few), (deep, many) = jobs(1), jobs(10)
    assert few == many
    again = model.forest(trees=4, depth=10, seed=1).fit(rows.repartition(13, "x"))
    assert (again.table == deep.table).all()


def test_forest_agrees_with_the_library(rows):
    own = model.forest(trees=30, depth=8, seed=3).fit(rows).transform(rows)
    theirs = model.forest(trees=30, depth=8, seed=3, bootstrap=False).fit(rows).transform(rows)
    both = own.alias("a").join(theirs.alias("b"), "point_id")
    row = both.agg(
        F.avg((F.col("a.prediction") == F.col("b.prediction")).cast("int")), F.avg((F.col("a.prediction") == F.col("a.label")).cast("int"))
    ).first()
    assert row[0] > 0.95 and row[1] > 0.93
    one = own.select("rawPrediction", "probability", "prediction").first()
    assert sum(one.rawPrediction) == pytest.approx(30) and list(one.probability * 30) == pytest.approx(list(one.rawPrediction))
    assert one.prediction == one.rawPrediction.toArray().argmax()


def test_cross_validation_scores_every_fold(rows):
    got = model.cross_validate(rows.drop("weight"), trees=10, depth=6).orderBy("fold").collect()
    assert [r.fold for r in got] == [0, 1, 2] and min(r.f1 for r in got) > 0.88
    assert got[0].f1_mean == pytest.approx(np.mean([r.f1 for r in got])) and got[0].f1_std == pytest.approx(np.std([r.f1 for r in got]))
