"""Survey inventory: selection, pairing, lookup and update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.config import MOP_RANGES
from talus.functions.naming import base_name, is_target_file, parse_survey_name, sensor_label
from talus.functions.numeric import mop_overlap, overlap_needed


def location_ranges(spark) -> DataFrame:
    rows = [(name, lo, hi) for name, (lo, hi) in MOP_RANGES.items()]
    return spark.createDataFrame(rows, "location string, mop_lo int, mop_hi int")


def with_parsed_name(folders: DataFrame, col: str = "folder") -> DataFrame:
    """Folders that follow the naming rule, with date and transects."""
    parsed = folders.withColumn("_p", parse_survey_name(F.col(col))).where(F.col("_p").isNotNull())
    return parsed.select(*folders.columns, "_p.*")


def surveys_for_locations(surveys: DataFrame, floor_threshold: bool = True, ranges: dict | None = None) -> DataFrame:
    """Surveys repeated for every site whose transect range they cover to two thirds.

    The site ranges are configuration, so they travel as a literal array and
    the range condition is evaluated without a join.
    """
    sites = [(name, *r) for name, r in (ranges or MOP_RANGES).items()]
    literal = F.array(
        *[
            F.struct(F.lit(s).alias("location"), F.lit(lo).alias("mop_lo"), F.lit(hi).alias("mop_hi"))
            for s, lo, hi in sites
        ]
    )
    fits = F.filter(
        literal,
        lambda r: mop_overlap(F.col("mop1"), F.col("mop2"), r["mop_lo"], r["mop_hi"])
        >= overlap_needed(r["mop_lo"], r["mop_hi"], floor_threshold),
    )
    return surveys.select("*", F.explode(fits).alias("_site")).select(*surveys.columns, "_site.location")


def _with_next(df: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Following row in (survey_date, tie) order without a window over the whole group.

    Rows are ordered within one date of a group; the last of a date continues
    with the first row of the group's next date, taken from a table with one
    row per date.
    """
    row = F.struct("survey_date", tie)
    days = df.groupBy(*by, "survey_date").agg(F.min(row).alias("_first"))
    nxt = days.withColumn("_next_day", F.lead("_first").over(Window.partitionBy(*by).orderBy("survey_date")))
    within = Window.partitionBy(*by, "survey_date").orderBy(tie)
    out = df.withColumn("_same_day", F.lead(row).over(within)).join(nxt.drop("_first"), by + ["survey_date"])
    return out.withColumn("_next", F.coalesce("_same_day", "_next_day")).drop("_same_day", "_next_day")


def sequential_pairs(surveys: DataFrame, by: list[str] = ("location",), tie: str = "folder") -> DataFrame:
    """Each survey with the next one of its site, ordered by date then name."""
    by = list(by)
    paired = _with_next(surveys.select(*by, "survey_date", tie), by, tie)
    return paired.where(F.col("_next").isNotNull()).select(
        *by,
        F.col("survey_date").alias("d1"),
        F.col("_next.survey_date").alias("d2"),
        F.col(tie).alias("ref"),
        F.col(f"_next.{tie}").alias("cmp"),
    )


def epoch_days(surveys: DataFrame, by: list[str] = ("location",)) -> DataFrame:
    """Days since the previous distinct survey date; the first date is dropped."""
    dates = surveys.select(*by, "survey_date").distinct()
    w = Window.partitionBy(*by).orderBy("survey_date")
    days = F.datediff("survey_date", F.lag("survey_date").over(w))
    return dates.withColumn("epoch_days", days).where(F.col("epoch_days").isNotNull())


def mean_epoch(surveys: DataFrame, by: list[str] = ("location",)) -> DataFrame:
    return epoch_days(surveys, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("epochs"), F.avg("epoch_days").alias("mean_days")
    )


def with_sensor(df: DataFrame, surveys: DataFrame, order: str, on: list[str] = ("location", "survey_date")) -> DataFrame:
    """Sensor of the last listed survey of the date, ``Unknown`` when none is listed."""
    on = list(on)
    last = surveys.groupBy(*on).agg(F.max_by("method", order).alias("_m"))
    out = df.join(last, on, "left")
    return out.withColumn("sensor", F.coalesce(sensor_label(F.col("_m")), F.lit("Unknown"))).drop("_m")


def sensor_by_date(dates: DataFrame, folders: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Sensor whose folder carries the date, in order of priority; ``Unknown`` when none does."""
    order = F.create_map(*[F.lit(v) for kv in priority.items() for v in kv])
    best = (
        folders.withColumn("_rank", F.try_element_at(order, F.col("method")))
        .where(F.col("_rank").isNotNull())
        .groupBy("survey_date")
        .agg(F.min_by("method", "_rank").alias("sensor"))
    )
    return dates.join(best, "survey_date", "left").na.fill("Unknown", ["sensor"])


def pick_one(df: DataFrame, by: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """First (or last) row of each group, by aggregation instead of a sort."""
    by = list(by)
    rest = [c for c in df.columns if c not in by]
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*by).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*by, "_r.*")


def shortest_name(files: DataFrame, by: list[str], name: str = "filename", longest: bool = False) -> DataFrame:
    size = F.length(name)
    return pick_one(files, by, [-size if longest else size, F.col(name)])


def latest_survey(surveys: DataFrame, sensor: str, by: list[str] = ("location",)) -> DataFrame:
    """Newest survey of a sensor per site (ties: last folder name)."""
    mine = surveys.where(F.lower("method").contains(sensor.lower()))
    return pick_one(mine, list(by), [F.col("survey_date"), F.col("folder")], last=True)


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sort_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.orderBy(*cols)


def only_missing(df: DataFrame, done: DataFrame, keys: list[str], replace: bool = False) -> DataFrame:
    """Rows whose output does not exist yet; all of them with ``replace``."""
    return df if replace else df.join(done.select(*keys), list(keys), "left_anti")


def new_surveys(existing: DataFrame, found: DataFrame, files: DataFrame, late: str = "drop") -> DataFrame:
    """Found surveys that are new to their site and hold a target file.

    ``late="drop"`` takes only dates after the site's newest listed date;
    ``late="accept"`` takes every folder that is not listed.
    """
    complete = files.where(is_target_file(F.col("filename"))).select("folder").distinct()
    held = found.join(complete, "folder", "left_semi")
    if late == "accept":
        return held.join(existing.select("location", "folder"), ["location", "folder"], "left_anti")
    newest = existing.groupBy("location").agg(F.max("survey_date").alias("_newest"))
    fresh = held.join(newest, "location", "left").where(
        F.col("_newest").isNull() | (F.col("survey_date") > F.col("_newest"))
    )
    return fresh.drop("_newest")


def update_surveys(existing: DataFrame, found: DataFrame, files: DataFrame, late: str = "drop") -> DataFrame:
    """The list with its new surveys, by date."""
    return existing.unionByName(new_surveys(existing, found, files, late)).orderBy("survey_date", "location", "folder")


def resolve_files(surveys: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """First existing file of each survey folder, in order of the roots it may live under.

    Listed paths may be stale: only the folder name is trusted.
    """
    root_rank = F.coalesce(
        *[F.when(F.col("path").startswith(r.rstrip("/") + "/"), F.lit(i)) for i, r in enumerate(roots)]
    )
    known = files.withColumn("_rank", root_rank).where(F.col("_rank").isNotNull())
    best = known.groupBy("folder").agg(F.min_by("path", F.struct("_rank", "path")).alias("file"))
    return surveys.withColumn("folder", base_name(F.col("folder"))).join(best, "folder")


def stage_composition(files: DataFrame, ids: list[str] = ("location", "survey_date")) -> DataFrame:
    """Point counts of the cropped, beach-free and vegetation-free file of each survey.

    The shortest file name wins within a stage; surveys whose counts grow along
    the stages, or with no points, are left out.
    """
    ids = list(ids)
    best = files.groupBy(*ids, "stage").agg(
        F.min_by("points", F.struct(F.length("filename"), F.col("filename"))).alias("points")
    )
    wide = best.groupBy(*ids).pivot("stage", ["cropped", "nobeach", "noveg"]).agg(F.first("points"))
    ok = (F.col("cropped") > 0) & (F.col("nobeach") <= F.col("cropped")) & (F.col("noveg") <= F.col("nobeach"))
    return wide.where(ok)


def latest_run(df: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows of the latest run; the run id is a scalar subquery, so partitions prune."""
    return df.where(F.col(run) == df.agg(F.max(run)).scalar())
