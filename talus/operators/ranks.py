"""Ranks, quantiles and running sums that never sort one group in one task.

A plain window over a group sends the whole group to one task, which fails as
soon as one key holds much of the table.  Here copies of a value are counted
first; groups that still have many distinct values are cut at approximate
quantiles into buckets which sort independently, and exact bucket totals give
each bucket its offset.  The results are exact wherever the cuts fall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.lineage import cut

HOT_ROWS = 1_000_000
MAX_BUCKETS = 1 << 16
FEW = 1000  # rows of a group up to which Spark limits groups before they are shuffled


def _cuts(value: str, buckets: int) -> Column:
    probs = [i / buckets for i in range(1, buckets)]
    # every task sends its summary, which is as long as it is accurate; an eighth of a bucket is near enough
    return F.percentile_approx(value, probs, max(1_000, 8 * buckets))


def _bucket(value: Column, cuts: Column, buckets: int) -> Column:
    """Number of cuts below the value, by binary search."""
    steps = F.array(*[F.lit(buckets >> i) for i in range(1, buckets.bit_length())])

    def probe(pos: Column, step: Column) -> Column:
        nxt = pos + step
        return F.when((nxt <= F.size(cuts)) & (F.get(cuts, nxt - 1) < value), nxt).otherwise(pos)

    return F.aggregate(steps, F.lit(0), probe)


def _placed(
    rows: DataFrame, keys: DataFrame, by: list[str], value: str, order: list[str], measures: dict, hot_rows: int
) -> DataFrame:
    """``rows`` with, for every measure, the sum over earlier rows of the group and over the whole group.

    ``measures`` maps the names of the two results to an expression over a row.
    ``keys`` holds the same groups and values with few other columns; group
    sizes are read off it before the rest is planned and tell whether any group
    has to be cut into buckets, and into how many.
    """
    sizes = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    largest = sizes.agg(F.max("_m")).first()[0]
    parts, split, offsets = list(by), rows, None
    if (largest or 0) > hot_rows:
        parts = by + ["_bucket"]
        buckets = min(MAX_BUCKETS, 1 << (max(2, largest // hot_rows)).bit_length())
        if by:
            hot = sizes.where(F.col("_m") > hot_rows).select(*by)
            crowded = keys.join(hot, by, "left_semi")
            cuts = cut(crowded.groupBy(*by).agg(_cuts(value, buckets).alias("_cuts")))
            mark = lambda df: df.join(cuts, by, "left")
        else:
            cuts = cut(keys.agg(_cuts(value, buckets).alias("_cuts")))
            mark = lambda df: df.withColumn("_cuts", cuts.scalar())
        at = F.when(F.col("_cuts").isNotNull(), _bucket(F.col(value), F.col("_cuts"), buckets)).otherwise(-1)
        split = mark(rows).withColumn("_bucket", at).drop("_cuts")
        sums = [F.sum(e).alias(f"_{lo}") for (lo, _), e in measures.items()]
        per_bucket = mark(rows).withColumn("_bucket", at).where("_bucket >= 0").groupBy(*parts).agg(*sums)
        ordered = Window.partitionBy(*by).orderBy("_bucket")
        prior, whole = ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
        offsets = per_bucket.select(
            *parts,
            *[F.coalesce(F.sum(f"_{lo}").over(prior), F.lit(0)).alias(f"_{lo}_offset") for lo, _ in measures],
            *[F.sum(f"_{lo}").over(whole).alias(f"_{lo}_whole") for lo, _ in measures],
        )

    inner = Window.partitionBy(*parts)
    below = inner.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = split.select(
        "*",
        *[F.coalesce(F.sum(e).over(below), F.lit(0)).alias(lo) for (lo, _), e in measures.items()],
        *[F.sum(e).over(inner).alias(hi) for (_, hi), e in measures.items()],
    )
    if offsets is not None:
        # same keys as the windows, so only the small side moves
        out = out.join(offsets, parts, "left").withColumns(
            {lo: F.col(lo) + F.coalesce(F.col(f"_{lo}_offset"), F.lit(0)) for lo, _ in measures}
            | {hi: F.coalesce(F.col(f"_{lo}_whole"), F.col(hi)) for lo, hi in measures}
        )
    return out.select(*rows.columns, *[c for names in measures for c in names])


def ranked(
    df: DataFrame, by: list[str], value: str, sums: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per group and distinct value.

    Adds ``n`` (copies), ``before`` (rows with a smaller value) and ``total``
    (rows of the group); with ``sums`` also ``sum_before`` and ``sum_total``.
    Null values are left out.  Group keys must not be null; values are numbers,
    dates or timestamps.
    """
    by = list(by)
    counts = cut(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")))
    measures = {("before", "total"): F.col("n")}
    if sums:
        measures[("sum_before", "sum_total")] = F.col("n") * F.col(value)
    return _placed(counts, counts, by, value, [value], measures, hot_rows)


def row_ranks(
    df: DataFrame, by: list[str], value: str, tie: str | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every row with its 0-based ``rank`` in the group and the group's ``total``.

    Without ``tie`` the value must be unique within the group; with it, copies
    are ordered by the (unique) tie column.  Null values are left out.
    """
    by = list(by)
    # passed over for sizes, cuts, totals and ranks, so computed once
    rows, one = cut(df.where(F.col(value).isNotNull())), F.lit(1).cast("long")
    keys = rows.select(*by, value)
    copies = None
    if tie is not None:
        counts = keys.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
        copies = (counts.agg(F.max("_c")).first()[0] or 0) > hot_rows
    if not copies:
        order = [value] if tie is None else [value, tie]
        return _placed(rows, keys, by, value, order, {("rank", "total"): one}, hot_rows)
    # one value alone would fill a bucket: rank the values, then the copies of each
    rows = rows.join(ranked(df, by, value, hot_rows=hot_rows), by + [value])
    inside = row_ranks(rows.drop("total"), by + [value], tie, None, hot_rows).withColumnRenamed("total", "_copies")
    totals = cut(keys.groupBy(*by).agg(F.count(F.lit(1)).alias("total")))
    inside = inside.withColumn("rank", F.col("before") + F.col("rank"))
    out = inside.join(totals, by) if by else inside.withColumn("total", totals.scalar())
    return out.select(*df.columns, "rank", "total")


def quantiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``."""
    r = ranked(df, by, value, hot_rows=hot_rows)
    v, first, last = F.col(value), F.col("before"), F.col("before") + F.col("n") - 1
    picks = []
    for name, p in probs.items():
        pos = (F.col("total") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            picks.append(F.max(F.when((first <= at) & (at <= last), v)).alias(f"_{name}_{side}"))
    agg = r.groupBy(*by).agg(F.max("total").alias("_total"), *picks)

    def lerp(name: str, p: float) -> Column:
        pos = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return lo + (hi - lo) * (pos - F.floor(pos))

    return agg.select(*by, *[lerp(name, p).alias(name) for name, p in probs.items()])


def ecdf(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values with the share of rows at or below each."""
    r = ranked(df, by, value)
    return r.select(*by, value, ((F.col("before") + F.col("n")) / F.col("total")).alias("ecdf"))


def every_kth(df: DataFrame, k: int, by: list[str], order: str) -> DataFrame:
    """Systematic sample: rows 0, k, 2k, ... of each group in the given (unique) order."""
    return row_ranks(df, by, order).where(F.col("rank") % k == 0).drop("rank", "total")


def limit_points(df: DataFrame, max_points: int, by: list[str], order: str) -> DataFrame:
    """First ``max_points`` rows of each group, in the given (unique) order.

    A small number is kept task by task before anything moves, so groups need
    not be ranked as a whole.
    """
    if max_points <= FEW:
        first = Window.partitionBy(*by).orderBy(order)
        ranked_few = df.where(F.col(order).isNotNull()).withColumn("_rank", F.row_number().over(first))
        return ranked_few.where(F.col("_rank") <= max_points).drop("_rank")
    return row_ranks(df, by, order).where(F.col("rank") < max_points).drop("rank", "total")
