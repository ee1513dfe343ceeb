"""Column functions over folder names, file names, paths and header labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.config import RESOLUTIONS, SENSOR_RULES


def parse_survey_name(name: Column) -> Column:
    """``YYYYMMDD_MOP1_MOP2_...`` as struct(survey_date, mop1, mop2).

    Null when there are fewer than three parts or the transects are no integers.
    """
    part = F.split(name, "_")
    digits = F.get(part, F.lit(0))
    mop1 = F.get(part, F.lit(1)).try_cast("int")
    mop2 = F.get(part, F.lit(2)).try_cast("int")
    parsed = F.struct(_ymd(digits).alias("survey_date"), mop1.alias("mop1"), mop2.alias("mop2"))
    return F.when((F.size(part) >= 3) & mop1.isNotNull() & mop2.isNotNull() & digits.rlike(r"^\d{8}$"), parsed)


def _ymd(digits: Column) -> Column:
    return F.try_to_date(digits, "yyyyMMdd")


def leading_date(name: Column) -> Column:
    """Date given by the first eight digits of a file name."""
    return _ymd(F.regexp_extract(name, r"^(\d{8})", 1))


def parse_any_date(text: Column) -> Column:
    """First ``YYYYMMDD`` in the text, else first ``YYYY_MM_DD``."""
    plain = _ymd(F.regexp_extract(text, r"(\d{8})", 1))
    spaced = F.try_to_date(F.regexp_extract(text, r"(\d{4}_\d{2}_\d{2})", 1), "yyyy_MM_dd")
    return F.coalesce(plain, spaced)


def parse_interval(name: Column) -> Column:
    """``YYYYMMDD_to_YYYYMMDD`` as struct(d1, d2, days, mid); null when absent."""
    pattern = r"(\d{8})_to_(\d{8})"
    d1 = _ymd(F.regexp_extract(name, pattern, 1))
    d2 = _ymd(F.regexp_extract(name, pattern, 2))
    parsed = F.struct(
        d1.alias("d1"), d2.alias("d2"), interval_days(d1, d2).alias("days"), interval_mid(d1, d2).alias("mid")
    )
    return F.when(d1.isNotNull() & d2.isNotNull(), parsed)


def interval_days(d1: Column, d2: Column) -> Column:
    """Length in days, at least one."""
    return F.greatest(F.datediff(d2, d1), F.lit(1))


def interval_mid(d1: Column, d2: Column) -> Column:
    """Midpoint; falls on noon for an odd number of days."""
    hours = F.datediff(d2, d1) * 12
    return d1.cast("timestamp_ntz") + F.make_dt_interval(hours=hours)


def interval_name(d1: Column, d2: Column) -> Column:
    return F.concat(F.date_format(d1, "yyyyMMdd"), F.lit("_to_"), F.date_format(d2, "yyyyMMdd"))


def sensor_label(method: Column, default: str = "Unknown") -> Column:
    """Instrument label by name fragment; rules are tried in order."""
    label = F.lit(default)
    for name, fragments in reversed(SENSOR_RULES):
        hit = reduce(lambda a, b: a | b, [method.contains(f) for f in fragments])
        label = F.when(hit, F.lit(name)).otherwise(label)
    return label


def base_name(path: Column) -> Column:
    """Last path component, ignoring blanks and trailing slashes."""
    return F.element_at(F.split(F.regexp_replace(F.trim(path), r"/+$", ""), "/"), -1)


def normalize_path(path: Column, old: str, new: str) -> Column:
    """Replace a mount prefix, only at the start."""
    return F.when(path.startswith(old), F.concat(F.lit(new), path.substr(F.lit(len(old) + 1), F.length(path)))).otherwise(
        path
    )


def strip_decimal_suffix(text: Column) -> Column:
    return F.regexp_replace(text, r"\.0$", "")


def location_of(path: Column) -> Column:
    """Folder below ``results``; ``Unknown`` when there is none."""
    found = F.regexp_extract(path, r"(?:^|/)results/([^/]+)", 1)
    return F.when(found != "", found).otherwise(F.lit("Unknown"))


def file_meta(df: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    return df.withColumns(
        {
            "location": location_of(F.col(path)),
            "filename": base_name(F.col(path)),
            "size_mb": F.col(size) / (1024.0 * 1024.0),
            "size_gb": F.col(size) / 1e9,
        }
    )


def elev_from_label(label: Column) -> Column:
    """Elevation in a header such as ``M3C2_0.10m``."""
    return F.regexp_extract(label, r"(-?\d+(?:\.\d+)?)m?$", 1).try_cast("double")


def elev_label(prefix: str, k: Column, res: float) -> Column:
    """Header of bin ``k``: lower edge with two decimals."""
    return F.format_string(f"{prefix}_%.2fm", k * F.lit(res))


def resolution_metres(label: Column) -> Column:
    """Metres of a resolution label or file tag; 0.1 when unreadable."""
    cm = F.regexp_extract(label, r"^([\d.]+)cm$", 1).try_cast("double")
    m = F.regexp_extract(label, r"^([\d.]+)m$", 1).try_cast("double")
    return F.coalesce(cm / 100.0, m, F.lit(0.1))


def resolution_tag(label: Column) -> Column:
    """File tag of a resolution label (``1m`` is written ``100cm``)."""
    tag = label
    for r in RESOLUTIONS.values():
        tag = F.when(label == r.name, F.lit(r.file_tag)).otherwise(tag)
    return tag


def is_change_file(name: Column) -> Column:
    return F.lower(name).contains("m3c2") & ~name.contains("_clustered")


def is_target_file(name: Column) -> Column:
    return F.lower(name).endswith("_beach_cliff_ground.las")


def is_interval_folder(name: Column) -> Column:
    return name.contains("to")


def any_column_contains(df: DataFrame, text: str) -> DataFrame:
    """Rows in which some column contains the text, ignoring case."""
    hits = [F.coalesce(F.lower(F.col(f"`{c}`").cast("string")).contains(text.lower()), F.lit(False)) for c in df.columns]
    return df.where(reduce(lambda a, b: a | b, hits))


def resolve_column(df: DataFrame, *choices: tuple[str, ...]) -> str | None:
    """First column holding every fragment of a choice; choices are tried in order."""
    for fragments in choices:
        for name in df.columns:
            if all(f in name.lower() for f in fragments):
                return name
    return None


def change_columns(df: DataFrame) -> dict[str, str | None]:
    """Input columns holding change distance, uncertainty and significance."""
    found = {
        "m3c2": resolve_column(df, ("m3c2", "dist")) or next((c for c in df.columns if c.lower() == "m3c2"), None),
        "uncertainty": resolve_column(df, ("uncert",)),
        "significant": resolve_column(df, ("significant",), ("sig_change",)),
    }
    if found["m3c2"] is None:
        raise KeyError(f"no change distance among {df.columns}")
    return found
