"""Point classification: training, validation, scoring and removal."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import trees as cell_trees
from talus.functions.numeric import safe_pct
from talus.operators.lineage import cut, spread
from talus.operators.radiometry import fit_scaler, match_histogram, standardize
from talus.operators.ranks import row_ranks
from talus.operators.sampling import draw, sample_frac
from talus.operators.stats import confusion, evaluate

cloudpickle.register_pickle_by_value(cell_trees)  # travels to executors with the job

FEATURES = ["x", "y", "z", "intensity_norm"]
TREES = 50
TEST_SHARE = 0.2
SUBSAMPLE = 0.6
TWO_CLASSES = {"ml_attr": {"type": "nominal", "vals": ["0", "1"]}}  # else every fit looks for the highest label first
BINS = 32  # of each feature, between which trees can split
MAX_CELLS = 1 << 20  # combinations of bins up to which a forest is grown on their counts
STEPS = 1024  # values of a class from which thresholds are taken
SLICES = 1 << 16  # slices of the range of draws that are counted before any row moves


def labelled(beach: DataFrame, cliff: DataFrame) -> DataFrame:
    return beach.withColumn("label", F.lit(1)).unionByName(cliff.withColumn("label", F.lit(0)))


def balanced_weights(df: DataFrame) -> DataFrame:
    """Weight n / (2 * n_class), so both classes count alike."""
    per = df.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    weights = per.withColumn("weight", per.agg(F.sum("_n")).scalar() / (2 * F.col("_n"))).drop("_n")
    return df.join(F.broadcast(weights), "label")  # one row per label


def stratified_split(df: DataFrame, share: float = TEST_SHARE, key: str = "point_id", seed: int = 0) -> DataFrame:
    """Adds ``is_test``: within each label the given share of lowest draws.

    Draws are uniform, so counts of narrow slices of them tell in which slice
    the share of a label ends. Only the rows of that slice are ranked.
    """
    drawn = cut(df.withColumn("_draw", draw(key, seed)).withColumn("_slice", F.floor(F.col("_draw") * SLICES)))
    per_slice = drawn.groupBy("label", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("label")
    upto = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    placed = per_slice.select(
        "label", "_slice", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(upto).alias("_upto"),
        F.round(F.sum("_n").over(whole) * share).alias("_tests"),
    )
    end = (F.col("_before") < F.col("_tests")) & (F.col("_tests") <= F.col("_upto"))
    ends = cut(placed.where(end).select(F.col("label").alias("_label"), F.col("_slice").alias("_end"), "_before", "_tests"))
    # one row per label
    marked = drawn.join(F.broadcast(ends), F.col("label").eqNullSafe(F.col("_label")), "left")
    sure = marked.where(~F.col("_slice").eqNullSafe(F.col("_end"))).withColumn("is_test", F.coalesce(F.col("_slice") < F.col("_end"), F.lit(False)))
    last = row_ranks(marked.where(F.col("_slice") == F.col("_end")), ["label"], "_draw", tie=key)
    last = last.withColumn("is_test", F.col("_before") + F.col("rank") < F.col("_tests"))
    return sure.select(*df.columns, "is_test").unionByName(last.select(*df.columns, "is_test"))


@dataclass
class Forest:
    """A random forest that is grown on the counts of binned rows (``functions/trees``).

    Thresholds lie between equal weights, seen from ``STEPS`` values of each
    class. All rows take part: one pass counts them by cell and label, after
    which every tree is a task that no longer depends on their number. Weights
    are those of classes; rows of a cell and label count with their mean weight.
    """

    features: list[str]
    trees: int
    depth: int
    seed: int

    def _thresholds(self, rows: DataFrame) -> list[np.ndarray]:
        probs = F.expr(f"array({', '.join(f'{i}D / {STEPS}' for i in range(1, STEPS + 1))})")  # parsed at once
        picks = [F.percentile_approx(F.col(f).cast("double"), probs).alias(f"_q{i}") for i, f in enumerate(self.features)]
        found = rows.groupBy("label").agg(F.sum("weight").alias("_w"), *picks).orderBy("label").collect()
        weights = np.repeat([r["_w"] / STEPS for r in found], STEPS)
        return [cell_trees.weighted_cuts(np.concatenate([r[f"_q{i}"] for r in found]), weights, BINS) for i in range(len(self.features))]

    def _counts(self, rows: DataFrame, thresholds: list[np.ndarray]) -> pa.Table:
        width = math.prod(len(t) + 1 for t in thresholds)
        schema = pa.schema([("cell", pa.int32()), ("label", pa.int32()), ("n", pa.int64()), ("w", pa.float64())])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                *columns, label, weight = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                cells = cell_trees.codes(columns, thresholds)
                for one in np.unique(label):
                    n, w = seen.setdefault(int(one), (np.zeros(width, np.int64), np.zeros(width)))
                    own = label == one
                    np.add.at(n, cells[own], 1)
                    np.add.at(w, cells[own], weight[own])
            for one, (n, w) in seen.items():
                at = np.flatnonzero(n)
                yield pa.record_batch([at.astype(np.int32), np.full(len(at), one, np.int32), n[at], w[at]], schema=schema)

        columns = [F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(self.features)]
        counted = rows.select(*columns, F.col("label").cast("int"), F.col("weight").cast("double")).mapInArrow(count, "cell int, label int, n long, w double")
        # cells and labels are few by construction
        return counted.groupBy("cell", "label").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).toArrow().sort_by([("cell", "ascending"), ("label", "ascending")])

    def fit(self, rows: DataFrame) -> ForestModel:
        thresholds = self._thresholds(rows)
        shape = [len(t) + 1 for t in thresholds]
        cells, labels, counts, weights = (c.to_numpy() for c in self._counts(rows, thresholds).columns)
        # sums of equal weights differ in their last digits with the order of the tasks
        weights = np.round(weights / counts, 9)
        classes, depth, seed = max(2, int(labels.max()) + 1), self.depth, self.seed
        tries = math.ceil(math.sqrt(len(self.features)))
        kinds = {"id": pa.int64(), "lows": pa.list_(pa.int32()), "highs": pa.list_(pa.int32()), "shares": pa.list_(pa.float64())}
        schema = pa.schema(list(kinds.items()))

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tree in batch["id"].to_pylist():
                    grown = cell_trees.grow(cells, labels, counts, weights, shape, classes, depth, tries, [seed & 0xFFFFFFFF, tree])
                    yield pa.record_batch([[tree], *([a.ravel()] for a in grown)], schema=schema)

        one_each = rows.sparkSession.range(0, self.trees, 1, self.trees)
        grown = one_each.mapInArrow(grow, "id long, lows array<int>, highs array<int>, shares array<double>").collect()
        size = len(shape)
        leaves = [(np.reshape(r.lows, (-1, size)), np.reshape(r.highs, (-1, size)), np.reshape(r.shares, (-1, classes))) for r in sorted(grown, key=lambda r: r.id)]
        return ForestModel(self.features, thresholds, cell_trees.votes(leaves, shape, classes), self.trees)


@dataclass
class ForestModel:
    """What the trees vote in every cell; adds ``rawPrediction``, ``probability`` and ``prediction``."""

    features: list[str]
    thresholds: list[np.ndarray]
    table: np.ndarray
    trees: int

    def transform(self, df: DataFrame) -> DataFrame:
        thresholds, table = self.thresholds, self.table

        @F.arrow_udf("array<double>")
        def voted(*columns: pa.Array) -> pa.Array:
            cells = cell_trees.codes([c.to_numpy(zero_copy_only=False) for c in columns], thresholds)
            found = table[cells]
            return pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * table.shape[1], found.ravel())

        out = df.withColumn("_votes", voted(*[F.col(f).cast("double") for f in self.features]))
        best = F.array_position("_votes", F.array_max("_votes")) - 1
        return out.withColumns(
            {
                "rawPrediction": array_to_vector("_votes"),
                "probability": array_to_vector(F.transform("_votes", lambda v: v / self.trees)),
                "prediction": best.cast("double"),
            }
        ).drop("_votes")


def forest(features: list[str] = FEATURES, trees: int = TREES, depth: int = 10, seed: int = 0, bootstrap: bool = True) -> Forest | Pipeline:
    """Estimator of a random forest; MLlib's for rows that have been drawn already and for more features than cells can tell apart."""
    if bootstrap and BINS ** len(features) <= MAX_CELLS:
        return Forest(features, trees, depth, seed)
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="features"),
            RandomForestClassifier(
                numTrees=trees, maxDepth=depth, weightCol="weight", labelCol="label", featuresCol="features", seed=seed,
                featureSubsetStrategy="sqrt", bootstrap=bootstrap, maxBins=BINS,
            ),
        ]
    )


def _dealt(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Rows on all cores, for work that is much for their bytes.

    Rows of a ``stored`` table that many tasks read stay where they are.
    """
    if stored is not None and stored.rdd.getNumPartitions() >= rows.sparkSession.sparkContext.defaultParallelism:
        return rows
    return spread(rows, "point_id")


def prepare(points: DataFrame, seed: int = 0, fraction: float = SUBSAMPLE) -> tuple[DataFrame, DataFrame]:
    """Complete, subsampled rows with normalised intensity, and the scaler."""
    clean = cut(sample_frac(points.na.drop(subset=["x", "y", "z", "intensity"]), fraction, "point_id", seed))
    scaler = fit_scaler(clean)
    return standardize(clean, scaler), scaler


def train_beach_model(
    points: DataFrame, seed: int = 0, trees: int = TREES, depth: int = 10, fraction: float = SUBSAMPLE
) -> tuple[ForestModel | PipelineModel, DataFrame, DataFrame]:
    """Model, scaler and scored test rows."""
    data, scaler = prepare(points, seed, fraction)
    split = cut(stratified_split(data, seed=seed + 1))
    model = forest(trees=trees, depth=depth, seed=seed).fit(_dealt(balanced_weights(split.where(~F.col("is_test"))), split))
    return model, scaler, model.transform(split.where("is_test"))


def cross_validate(
    df: DataFrame, folds: int = 3, features: list[str] = FEATURES, seed: int = 0, trees: int = TREES, depth: int = 10
) -> DataFrame:
    """Weighted F1 per fold with its mean and population deviation.

    F1 is read from the counts of labels and predictions.
    """
    fold = F.floor(draw("point_id", seed) * folds).cast("int")
    marked = cut(df.withColumn("fold", fold))
    metric = MulticlassClassificationEvaluator(labelCol="label", metricName="weightedFMeasure", weightCol="rows")
    scores = []
    for k in range(folds):
        model = forest(features, trees, depth, seed).fit(_dealt(balanced_weights(marked.where(F.col("fold") != k)), marked))
        scored = model.transform(marked.where(F.col("fold") == k))
        scores.append((k, float(metric.evaluate(cut(scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).cast("double").alias("rows")))))))
    out = df.sparkSession.createDataFrame(scores, "fold int, f1 double")
    stats = out.agg(F.struct(F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("std"))).scalar()
    return out.withColumn("_s", stats).select("fold", "f1", F.col("_s.mean").alias("f1_mean"), F.col("_s.std").alias("f1_std"))


#: Distribution function of a Poisson variable of mean 1: how often a row is drawn into a bag as large as the data.
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def times_drawn(bag: int, key: str = "point_id", seed: int = 0) -> Column:
    """How often a row is in a bag: a Poisson draw from a digest of bag, seed and key, so every scan agrees on it."""
    u = draw(key, seed * 100_003 + bag)
    # a sum, not a chain of cases: Spark makes the digest once for all its terms
    return reduce(lambda a, b: a + b, [(u >= upto).cast("int") for upto in _POISSON])


def bagged_forest(
    df: DataFrame, features: list[str] = FEATURES, trees: int = TREES, bags: int | None = None, depth: int = 10, seed: int = 0
) -> list[PipelineModel]:
    """The trees of a forest, grown by bags: trees of one bag see the same draw of rows and differ in the features tried.

    Every tree has a bag of its own unless fewer are asked for, which saves
    passes over the data.
    """
    bags = bags or trees
    # every pass of every bag reads these rows: draws are made once, and files that many tasks wrote are read by many
    draws = [times_drawn(bag, seed=seed).cast("tinyint").alias(f"_times{bag}") for bag in range(bags)]
    drawn = cut(_dealt(df.select("point_id", *features, "label", "weight")).select("*", *draws))
    fitted = []
    for bag in range(bags):
        times = F.col(f"_times{bag}")
        own = drawn.where(times > 0).select(*features, F.col("label").alias("label", metadata=TWO_CLASSES), (F.col("weight") * times).alias("weight"))
        grown = forest(features, trees // bags + (bag < trees % bags), depth, seed + bag, bootstrap=False)
        grown.getStages()[-1].setSubsamplingRate(1.0)
        fitted.append(grown.fit(own))
    return fitted


def votes(df: DataFrame, fitted: list[PipelineModel], unseen: bool = False, seed: int = 0) -> DataFrame:
    """Rows with the summed votes for each class, how many bags voted, and the prediction.

    ``unseen`` counts only the bags without the row: the out-of-bag vote.  A row
    that is in every bag has no prediction then.
    """
    taken, out = [], df
    for bag, one in enumerate(fitted):
        names = {c: f"_{c}{bag}" for c in ("features", "rawPrediction", "probability", "prediction")}
        out = one.transform(out).withColumnsRenamed(names)
        own = vector_to_array(F.col(names["rawPrediction"]))
        taken.append(F.when(times_drawn(bag, seed=seed) == 0, own) if unseen else own)
        out = out.withColumn(f"_votes{bag}", taken[-1]).drop(*names.values())
    held = [F.col(f"_votes{bag}") for bag in range(len(fitted))]
    total = [reduce(lambda a, b: a + b, [F.coalesce(v[k], F.lit(0.0)) for v in held]) for k in (0, 1)]
    bags = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in held])
    out = out.select(*df.columns, F.array(*total).alias("votes"), bags.alias("bags"))
    prediction = F.when(F.col("bags") > 0, (F.col("votes")[1] > F.col("votes")[0]).cast("double"))
    return out.withColumn("prediction", prediction)


def out_of_bag(df: DataFrame, fitted: list[PipelineModel], seed: int = 0) -> DataFrame:
    """One row: rows that some bag did not see, and the share of them that its trees classify rightly."""
    voted = votes(_dealt(df), fitted, unseen=True, seed=seed).where(F.col("bags") > 0)
    return voted.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("oob_score"))


def cross_fitted(df: DataFrame, estimator: Pipeline, folds: int = 5, key: str = "point_id", seed: int = 0) -> DataFrame:
    """Every row scored by a model that has been fitted on the other folds."""
    marked = cut(df.withColumn("fold", F.floor(draw(key, seed) * folds).cast("int")))
    parts = [
        estimator.fit(marked.where(F.col("fold") != k)).transform(marked.where(F.col("fold") == k)) for k in range(folds)
    ]
    return reduce(DataFrame.unionByName, parts)


def training_report(scored: DataFrame, cv: DataFrame | None = None, oob: DataFrame | None = None) -> DataFrame:
    """One row: accuracy, per-class scores, confusion counts, cross-validation result and out-of-bag score."""
    per = evaluate(scored)
    row = per.agg(
        F.first("accuracy").alias("test_accuracy"),
        F.sort_array(F.collect_list(F.struct("class", "precision", "recall", "f1", "support"))).alias("classes"),
    )
    cm = confusion(scored).agg(F.sort_array(F.collect_list(F.struct("label", "prediction", "rows"))).alias("c")).scalar()
    row = row.withColumn("confusion", cm)
    if cv is not None:
        best = cv.agg(F.struct(F.first("f1_mean").alias("mean"), F.first("f1_std").alias("std"))).scalar()
        row = row.withColumn("_cv", best).select("*", F.col("_cv.mean").alias("cv_f1_mean"), F.col("_cv.std").alias("cv_f1_std")).drop("_cv")
    return row if oob is None else row.withColumn("oob_score", oob.select("oob_score").scalar())


def keep_class(df: DataFrame, label: int = 0, confidence: float | None = None) -> DataFrame:
    """Points predicted as the class, optionally only with the given confidence."""
    out = df.where(F.col("prediction") == label)
    if confidence is not None:
        out = out.where(F.get(vector_to_array("probability"), F.lit(label)) >= confidence)
    return out


def score(points: DataFrame, model: ForestModel | PipelineModel, scaler: DataFrame, ref: DataFrame | None = None,
          by: list[str] = ("survey_date",)) -> DataFrame:
    """Intensity matching (when there is a reference), scaling and prediction."""
    wanted = set(FEATURES) - {"intensity_norm"} | {"intensity"}
    missing = wanted - set(points.columns)
    if missing:
        raise ValueError(f"model features missing: {sorted(missing)}")
    matched = match_histogram(points, ref, by=by)
    return model.transform(standardize(matched, scaler, "matched"))


def remove_beach(points: DataFrame, model: ForestModel | PipelineModel, scaler: DataFrame, ref: DataFrame | None = None,
                 by: list[str] = ("survey_date",)) -> DataFrame:
    """Points classified as cliff; a survey without any yields no rows."""
    return keep_class(score(points, model, scaler, ref, by), 0).select(*points.columns)


def removal_stats(scored: DataFrame, by: list[str]) -> DataFrame:
    """Points kept and removed per survey."""
    kept = F.count_if(F.col("prediction") == 0)
    total = F.count(F.lit(1))
    return scored.groupBy(*by).agg(
        total.alias("total_points"),
        (total - kept).alias("removed"),
        kept.alias("kept"),
        safe_pct(total - kept, total).alias("percent_removed"),
        F.when(kept == 0, "No Cliff Points").otherwise("Success").alias("status"),
    )


def vegetation_classifier(features: list[str], seed: int = 0) -> Pipeline:
    """Linear separation in the space of local shape features."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="features"),
            LogisticRegression(labelCol="label", featuresCol="features", maxIter=50),
        ]
    )


def remove_vegetation(points: DataFrame, model: PipelineModel, confidence: float = 0.8) -> DataFrame:
    """Points confidently classified as bare ground (label 0)."""
    return keep_class(model.transform(points), 0, confidence).select(*points.columns)
