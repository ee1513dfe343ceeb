"""Distribution statistics of events, surveys, files and training results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.config import POWER_LAW_CUTOFF, QC_MIN_POINTS, WINTER_MONTHS
from talus.functions.numeric import safe_ratio
from talus.operators.lineage import cut
from talus.operators.ranks import quantiles, ranked

CHUNK = 100_000
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def describe(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Count, mean, total and exact quartiles, one row per group and column."""
    by = list(by)
    named = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in cols]
    long = df.select(*by, F.explode(F.array(*named)).alias("_m")).select(*by, "_m.*").where(F.col("value").isNotNull())
    keys = by + ["measure"]
    sums = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.sum("value").alias("total")
    )
    return sums.join(quantiles(long, keys, "value", QUARTILES), keys)


def describe_events(events: DataFrame, by: list[str] = ()) -> DataFrame:
    return describe(events, by, ["volume", "elevation", "width", "height"])


def describe_surveys(surveys: DataFrame, by: list[str] = ()) -> DataFrame:
    return describe(surveys, by, ["size_gb", "density"])


def gini(df: DataFrame, by: list[str], value: str = "volume") -> DataFrame:
    """Gini coefficient, 0 when the values sum to nothing."""
    r = ranked(df, by, value)
    n, before, total = F.col("n"), F.col("before"), F.col("total")
    # copies of a value occupy ranks before+1 .. before+n
    num = F.sum(F.col(value) * n * (2 * before + n - total))
    den = F.sum(F.col(value) * n) * F.max("total")
    return r.groupBy(*by).agg(F.when(den != 0, num / den).otherwise(0.0).alias("gini"))


def lorenz(df: DataFrame, by: list[str], value: str = "volume") -> DataFrame:
    """Share of the total held by the largest events, one row per event, largest first."""
    r = ranked(df, by, value, sums=True)
    # copies are listed chunk by chunk, so no array grows with their number
    chunk = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"), F.lit(CHUNK))).alias("_c")
    r = r.select("*", chunk)
    j = F.explode(F.sequence(F.col("_c"), F.least(F.col("n"), F.col("_c") + CHUNK - 1))).alias("_j")
    at = r.select("*", j).withColumn("rank", F.col("total") - F.col("before") - F.col("n") + F.col("_j"))
    held = F.col("sum_total") - F.col("sum_before") - (F.col("n") - F.col("_j")) * F.col(value)
    return at.select(
        *by,
        "rank",
        value,
        (F.col("rank") / F.col("total") * 100).alias("events_pct"),
        (held / F.col("sum_total") * 100).alias("volume_pct"),
    )


def top_share(df: DataFrame, by: list[str], value: str = "volume", share: float = 0.05) -> DataFrame:
    """Share of the largest events in two readings.

    ``ordinate_pct`` is the Lorenz curve at position ``int(share * n)`` counted
    from 0; ``ceil_pct`` is the sum of the first ``ceil(share * n)`` events.
    """
    r = ranked(df, by, value, sums=True)
    n, before, total = F.col("n"), F.col("before"), F.col("total")

    def held(k: Column) -> Column:
        copies = k - (total - before - n)
        at = (copies >= 1) & (copies <= n)
        return F.max(
            F.when(at, (F.col("sum_total") - F.col("sum_before") - (n - copies) * F.col(value)) / F.col("sum_total") * 100)
        )

    return r.groupBy(*by).agg(
        held(F.floor(total * F.lit(share)) + 1).alias("ordinate_pct"), held(F.ceil(total * F.lit(share))).alias("ceil_pct")
    )


def _log_edges(lo: Column, hi: Column, n_edges: int) -> Column:
    """Logarithmically spaced edges, ends exact."""
    a, b = F.log10(lo), F.log10(hi)
    step = (b - a) / (n_edges - 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_edges - 1)),
        lambda i: F.when(i == 0, lo).when(i == n_edges - 1, hi).otherwise(F.pow(F.lit(10.0), a + i * step)),
    )


def _log_bins(df: DataFrame, by: list[str], value: str, n_edges: int) -> DataFrame:
    """Rows with ``edges`` and the index ``bin`` of the last edge not above the value."""
    by = list(by)
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    edges = ends.select(*by, _log_edges(F.col("_lo"), F.col("_hi"), n_edges).alias("edges"))
    # one row of edges per group
    joined = df.join(edges, by) if by else df.withColumn("edges", edges.scalar())
    at = F.aggregate("edges", F.lit(-1), lambda acc, e: acc + F.when(e <= F.col(value), 1).otherwise(0))
    return joined.withColumn("bin", at)


def power_law_hist(
    df: DataFrame, by: list[str] = (), value: str = "volume", cutoff: float = POWER_LAW_CUTOFF, n_edges: int = 30
) -> DataFrame:
    """Log-spaced histogram with the straight-line fit of its tail.

    Bins are half-open except the last.  The fit uses bins with counts whose
    centre reaches the cutoff; with fewer than three of them ``beta`` is 0.
    """
    by = list(by)
    df = cut(df.select(*by, value))
    bins = n_edges - 1
    counts = (
        _log_bins(df, by, value, n_edges)
        .withColumn("bin", F.least("bin", F.lit(bins - 1)))
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("events"), F.first("edges").alias("edges"))
    )
    frame = counts.groupBy(*by).agg(F.first("edges").alias("edges"), F.map_from_entries(
        F.collect_list(F.struct("bin", "events"))).alias("_h"))  # at most one entry per bin
    centre = (F.get("edges", F.col("bin")) + F.get("edges", F.col("bin") + 1)) / 2
    hist = frame.select(*by, "edges", "_h", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select(
        *by, "bin", centre.alias("centre"), F.coalesce(F.try_element_at("_h", F.col("bin")), F.lit(0)).alias("events")
    )
    used = (F.col("centre") >= cutoff) & (F.col("events") > 0)
    lx, ly = F.when(used, F.log10("centre")), F.when(used, F.log10("events"))
    fit = hist.groupBy(*by).agg(
        F.count_if(used).alias("_k"), F.regr_slope(ly, lx).alias("_slope"), F.regr_intercept(ly, lx).alias("_icpt")
    )
    enough = F.col("_k") >= 3
    fit = fit.select(
        *by,
        F.when(enough, -F.col("_slope")).otherwise(0.0).alias("beta"),
        F.when(enough, F.col("_icpt")).alias("intercept"),
    )
    # the fit is one row per group
    if by:
        return hist.join(fit, by)
    row = fit.select(F.struct("beta", "intercept")).scalar()
    return hist.withColumn("_f", row).select("bin", "centre", "events", "_f.beta", "_f.intercept")


def power_law_mle(df: DataFrame, by: list[str] = (), value: str = "volume", cutoff: float = POWER_LAW_CUTOFF) -> DataFrame:
    """Maximum-likelihood exponent above the cutoff; 0 with fewer than ten events."""
    tail = F.col(value) >= cutoff
    n, logs = F.count_if(tail), F.sum(F.when(tail, F.ln(F.col(value) / cutoff)))
    return df.groupBy(*by).agg(n.alias("n"), F.when(n < 10, 0.0).otherwise(1 + n / logs).alias("beta"))


def bin_uncertainty(
    df: DataFrame, by: list[str] = (), value: str = "volume", unc: str = "vol_unc", n_edges: int = 30
) -> DataFrame:
    """Mean uncertainty per half-open log bin; the largest value belongs to none."""
    by = list(by)
    df = cut(df.select(*by, value, unc))
    binned = _log_bins(df, by, value, n_edges).where(F.col("bin") < n_edges - 1)
    return binned.groupBy(*by, "bin").agg(F.avg(unc).alias("mean_unc"), F.count(F.lit(1)).alias("events"))


def seasonality(events: DataFrame, by: list[str] = ()) -> DataFrame:
    """Volume per calendar month with its share; months without events are 0."""
    by = list(by)
    months = [F.sum(F.when(F.col("month") == m, F.col("volume")).otherwise(0.0)) for m in range(1, 13)]
    wide = events.groupBy(*by).agg(F.array(*months).alias("_v"), F.sum("volume").alias("_total"))
    return wide.select(*by, "_total", F.posexplode("_v").alias("_pos", "volume")).select(
        *by,
        (F.col("_pos") + 1).alias("month"),
        "volume",
        F.when(F.col("_total") > 0, F.col("volume") / F.col("_total") * 100).otherwise(0.0).alias("pct"),
    )


def season_summary(events: DataFrame, by: list[str] = ()) -> DataFrame:
    """Winter, summer and December shares and the peak month (earliest on ties)."""
    by = list(by)
    m = seasonality(events, by)
    total = F.sum("volume")
    share = lambda cond: F.when(total > 0, F.sum(F.when(cond, F.col("volume")).otherwise(0.0)) / total * 100).otherwise(0.0)
    winter = share(F.col("month").isin(*WINTER_MONTHS))
    return m.groupBy(*by).agg(
        total.alias("volume"),
        winter.alias("winter_pct"),
        (100 - winter).alias("summer_pct"),
        share(F.col("month") == 12).alias("december_pct"),
        F.max_by("month", F.struct("volume", -F.col("month"))).alias("peak_month"),
        F.max("pct").alias("peak_pct"),
    )


def histogram(df: DataFrame, by: list[str], value: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram between the extremes, last bin closed; empty bins are left out."""
    by = list(by)
    ends = df.groupBy(*by).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    if by:
        joined = df.join(ends, by)
    else:
        joined = df.withColumn("_e", ends.select(F.struct("lo", "hi")).scalar()).select("*", "_e.lo", "_e.hi")
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.width_bucket(value, "lo", "hi", F.lit(bins)), F.lit(bins)))
    counts = joined.groupBy(*by, F.coalesce(b, F.lit(1)).cast("int").alias("bin"), "lo", "hi").agg(
        F.count(F.lit(1)).alias("rows")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return counts.select(
        *by, "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("left"), (F.col("lo") + F.col("bin") * width).alias("right"), "rows"
    )


def remove_outliers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows within 1.5 interquartile ranges of their group's quartiles."""
    q = quantiles(df, by, value, {"_q1": 0.25, "_q3": 0.75})
    iqr = F.col("_q3") - F.col("_q1")
    kept = df.join(q, list(by)).where(
        (F.col(value) >= F.col("_q1") - 1.5 * iqr) & (F.col(value) <= F.col("_q3") + 1.5 * iqr)
    )
    return kept.drop("_q1", "_q3")


def class_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and median per group after outlier removal."""
    clean = cut(remove_outliers(df, by, value).select(*by, value))
    means = clean.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return means.join(quantiles(clean, by, value, {"median": 0.5}), list(by))


def below_quantile(df: DataFrame, value: str, p: float = 0.99) -> DataFrame:
    """Rows strictly below a quantile of the whole column."""
    return df.where(F.col(value) < quantiles(df, [], value, {"q": p}).scalar())


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def color_limits(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """2nd and 98th percentile of the non-zero values and 99.5th of all."""
    by = list(by)
    df = cut(df.select(*by, value))
    nz = quantiles(df.where(F.col(value) != 0), by, value, {"p2": 0.02, "p98": 0.98})
    every = quantiles(df, by, value, {"p99_5": 0.995})
    return every.join(nz, by, "left") if by else every.withColumn("_n", nz.select(F.struct("p2", "p98")).scalar()).select(
        "_n.p2", "_n.p98", "p99_5"
    )


def linear_trend(df: DataFrame, by: list[str], x: str, y: str, more_than: int = 1) -> DataFrame:
    """Least-squares line; null unless there are more than the given number of rows."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return df.groupBy(*by).agg(
        n.alias("n"),
        F.when(n > more_than, F.regr_slope(y, x)).alias("slope"),
        F.when(n > more_than, F.regr_intercept(y, x)).alias("intercept"),
    )


def class_composition(stages: DataFrame, ids: list[str]) -> DataFrame:
    """Beach, vegetation and cliff percentages from the point counts of three stages, three rows per survey."""
    c, b, v = F.col("cropped"), F.col("nobeach"), F.col("noveg")
    pct = stages.select(
        *ids,
        (F.greatest(c - b, F.lit(0)) / c * 100).alias("Beach"),
        (F.greatest(b - v, F.lit(0)) / c * 100).alias("Vegetation"),
        (v / c * 100).alias("Cliff"),
    )
    return pct.unpivot(ids, ["Beach", "Vegetation", "Cliff"], "class", "percentage")


def qc_summary(files: DataFrame, min_points: int = QC_MIN_POINTS) -> DataFrame:
    return files.groupBy("location").agg(
        F.count(F.lit(1)).alias("files"),
        F.avg("size_mb").alias("mean_mb"),
        F.avg("points").alias("mean_points"),
        F.count_if(F.col("points") < min_points).alias("suspects"),
    )


def status_summary(stats: DataFrame, by: list[str] = ()) -> DataFrame:
    """Outcome counts, mean duration of processed files and totals."""
    s = F.lower("status")
    done = s.isin("processed", "success")
    return stats.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(done).alias("succeeded"),
        F.count_if(s == "skipped").alias("skipped"),
        F.count_if(~done & (s != "skipped")).alias("failed"),
        F.coalesce(F.avg(F.when(done, F.col("duration"))), F.lit(0.0)).alias("mean_duration"),
        F.coalesce(F.sum(F.when(done, F.col("points"))), F.lit(0)).alias("points"),
    )


def with_totals(stats: DataFrame, label: str, sums: list[str]) -> DataFrame:
    """The rows plus one totals row."""
    total = stats.agg(*[F.sum(c).alias(c) for c in sums]).withColumn(label, F.lit("TOTAL"))
    return stats.unionByName(total, allowMissingColumns=True)


def cluster_run_stats(points: DataFrame, by: list[str] = ("location", "d1", "d2")) -> DataFrame:
    """Clusters, noise and points by mode for every interval, with the derived ratios."""
    by = list(by)
    per = points.groupBy(*by, "mode", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    agg = []
    for m, p in (("erosion", "ero"), ("deposition", "dep")):
        here = F.col("mode") == m
        agg += [
            F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias(f"{p}_points"),
            F.count_if(here & (F.col("cluster_id") != -1)).alias(f"{p}_clusters"),
            F.coalesce(F.sum(F.when(here & (F.col("cluster_id") == -1), F.col("n"))), F.lit(0)).alias(f"{p}_noise"),
        ]
    out = per.groupBy(*by).agg(*agg)
    e, d = F.col("ero_clusters"), F.col("dep_clusters")
    extra = {"ed_ratio": F.when(d != 0, e / (d + 0.001)).otherwise(0.0)}
    for p in ("ero", "dep"):
        extra[f"{p}_noise_pct"] = safe_ratio(F.col(f"{p}_noise"), F.col(f"{p}_points")) * 100
        extra[f"{p}_points_per_cluster"] = safe_ratio(F.col(f"{p}_points"), F.col(f"{p}_clusters"))
    return out.withColumns(extra)


def cluster_totals(runs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Totals over intervals of :func:`cluster_run_stats`."""
    e, d = F.sum("ero_clusters"), F.sum("dep_clusters")
    return runs.groupBy(*by).agg(
        e.alias("ero_clusters"),
        d.alias("dep_clusters"),
        (e / (d + 0.001)).alias("ed_ratio"),
        F.avg("ero_noise_pct").alias("mean_ero_noise_pct"),
        F.avg("dep_noise_pct").alias("mean_dep_noise_pct"),
        (F.sum("ero_points") / (e + 0.001)).alias("points_per_ero_cluster"),
        (F.sum("dep_points") / (d + 0.001)).alias("points_per_dep_cluster"),
        F.avg("ero_points").alias("mean_ero_points"),
        F.stddev_pop("ero_points").alias("std_ero_points"),
    )


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def evaluate(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class (0 where undefined) with the overall accuracy."""
    cm = confusion(df, label, prediction)
    sides = F.explode(
        F.array(
            F.struct(F.col("label").alias("class"), F.col("rows").alias("support"), F.lit(0).cast("long").alias("predicted")),
            F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), F.col("rows").alias("predicted")),
        )
    )
    hit = F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0)
    per = cm.select(hit.alias("hit"), sides.alias("s")).groupBy("s.class").agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum(F.when(F.col("s.support") > 0, F.col("hit")).otherwise(0)).alias("hits")
    )
    precision = safe_ratio(F.col("hits"), F.col("predicted"))
    recall = safe_ratio(F.col("hits"), F.col("support"))
    accuracy = cm.agg(F.sum(hit) / F.sum("rows")).scalar()
    return per.select(
        "class",
        "support",
        precision.alias("precision"),
        recall.alias("recall"),
        safe_ratio(2 * precision * recall, precision + recall).alias("f1"),
        accuracy.alias("accuracy"),
    )
