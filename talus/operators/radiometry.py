"""Intensity matching and channel scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.lineage import cut
from talus.operators.ranks import quantiles, ranked, row_ranks

SLICES = 4096  # slices of the reference's rank range, each ordered on its own


def _reference_at(placed: DataFrame, ref: DataFrame, col: str) -> DataFrame:
    """Adds the reference values ``_lo`` and ``_hi`` at rank ``_at`` and the one after it.

    The reference is one step per distinct value, however many copies it has.
    Steps and positions are merged slice by slice; the step that reaches into a
    slice from below comes from a table with one row per slice.
    """
    steps = ranked(ref, [], col)
    follow = steps.select(F.col("before").alias("_end"), F.col(col).cast("double").alias("_next"))
    steps = steps.select(
        F.col("before").alias("_at"), (F.col("before") + F.col("n")).alias("_end"), F.col(col).cast("double").alias("_v"), "total"
    ).join(follow, "_end", "left")
    steps = cut(steps.withColumn("_slice", F.floor(F.col("_at") * SLICES / F.col("total"))))
    total = steps.agg(F.max("total")).scalar()
    step = F.struct("_v", "_end", "_next")

    tops = steps.groupBy("_slice").agg(F.max_by(step, "_at").alias("_top"))
    slices = placed.sparkSession.range(SLICES).withColumnRenamed("id", "_slice").join(tops, "_slice", "left")
    below = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("_slice", F.last("_top", ignorenulls=True).over(below).alias("_carried"))

    marks = steps.select("_slice", "_at", F.lit(0).alias("_kind"), step.alias("_step"))
    asked = placed.withColumns({"_slice": F.floor(F.col("_at") * SLICES / total), "_kind": F.lit(1)})
    merged = asked.unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy("_slice").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn("_found", F.last("_step", ignorenulls=True).over(upto)).where("_kind = 1")
    # one row per slice
    found = found.join(F.broadcast(carried), "_slice").withColumn("_s", F.coalesce("_found", "_carried"))
    after = F.when(F.col("_at") + 1 < F.col("_s._end"), F.col("_s._v")).otherwise(F.coalesce("_s._next", "_s._v"))
    return found.select(*placed.columns, F.col("_s._v").alias("_lo"), after.alias("_hi"))


def match_histogram(
    df: DataFrame, ref: DataFrame | None, col: str = "intensity", by: list[str] = ("survey_date",), tie: str = "point_id",
    out: str = "matched",
) -> DataFrame:
    """Map each value to the reference distribution at the same quantile.

    The lowest and highest rank of a group meet the reference's extremes;
    between, the reference is interpolated linearly.  Ties are ordered by
    ``tie``.  Without a reference the value stays as it is.
    """
    by = list(by)
    if ref is None:
        return df.withColumn(out, F.col(col).cast("double"))
    size = ref.where(F.col(col).isNotNull()).agg(F.count(F.lit(1))).scalar()
    ranks = row_ranks(df, by, col, tie)
    pos = F.when(F.col("total") > 1, F.col("rank") * (size - 1) / (F.col("total") - 1)).otherwise(0.0)
    placed = ranks.withColumn("_pos", pos).withColumn("_at", F.floor("_pos"))
    joined = _reference_at(placed, ref, col)
    blend = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.col("_at"))
    return joined.select(*df.columns, blend.alias(out))


def normalize_sensors(points: DataFrame, baseline: str, col: str = "intensity", tie: str = "point_id") -> DataFrame:
    """Every sensor's intensities mapped to the baseline sensor's; the baseline itself is unchanged."""
    base = points.where(F.col("sensor") == baseline)
    others = match_histogram(points.where(F.col("sensor") != baseline), base, col, ["sensor"], tie)
    return others.unionByName(base.withColumn("matched", F.col(col).cast("double")))


def fit_scaler(df: DataFrame, col: str = "intensity") -> DataFrame:
    """One row with mean and population deviation."""
    return df.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))


def standardize(df: DataFrame, stats: DataFrame, col: str = "intensity", out: str = "intensity_norm") -> DataFrame:
    """Centre and scale with stored statistics; a zero deviation counts as one."""
    s = stats.select(F.struct(F.col("mean"), F.when(F.col("std") > 0, F.col("std")).otherwise(1.0).alias("std"))).scalar()
    return df.withColumn("_s", s).withColumn(out, (F.col(col) - F.col("_s.mean")) / F.col("_s.std")).drop("_s")


def robust_scale(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """Channels stretched between their 2nd and 98th percentile to 0..255, clipped and truncated."""
    by = list(by)
    out = df
    for c in cols:
        q = quantiles(df, by, c, {"_p2": 0.02, "_p98": 0.98})
        if by:
            out = out.join(q, by)
        else:
            out = out.withColumn("_q", q.select(F.struct("_p2", "_p98")).scalar()).select("*", "_q._p2", "_q._p98").drop("_q")
        span = F.col("_p98") - F.col("_p2")
        scaled = F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col(c) - F.col("_p2")) / span * 255))
        out = out.withColumn(f"{c}_8bit", F.when(span == 0, 0).otherwise(scaled.cast("int"))).drop("_p2", "_p98")
    return out
