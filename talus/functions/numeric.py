"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.config import QC_MIN_POINTS, WINTER_MONTHS, bin_count


def z_bin(z: Column, res: float, height: float) -> Column:
    """Left-closed bin index against the edges ``k * res``; null outside the grid.

    The quotient alone misplaces values equal to an edge that has no exact
    double, so the candidate is compared with the edges themselves.
    """
    k = F.floor(z / F.lit(res)).cast("int")
    k = (
        k
        + F.when(z >= (k + 1) * F.lit(res), 1).otherwise(0)
        - F.when(z < k * F.lit(res), 1).otherwise(0)
    )
    n = bin_count(height, res)
    return F.when((z >= 0) & (z < F.lit(n * res)), k)


def z_low(k: Column, res: float) -> Column:
    """Lower bin edge as written in grid headers (two decimals)."""
    return F.round(k * F.lit(res), 2)


def snap_bin(z: Column, res: float) -> Column:
    """Nearest integer bin, halves to even."""
    return F.bround(z * F.lit(1.0 / res)).cast("int")


def zero_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-numbers, NaN and null become zero."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0)) for c in cols})


def safe_pct(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.round(part / whole * 100, 2)).otherwise(F.lit(0.0))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def mop_overlap(mop1: Column, mop2: Column, lo: Column, hi: Column) -> Column:
    return F.least(mop2, hi) - F.greatest(mop1, lo)


def overlap_needed(lo: Column, hi: Column, floor_threshold: bool) -> Column:
    """Two thirds of the target range; the first build rounds down, updates do not."""
    need = (hi - lo) * 2 / 3
    return F.floor(need).cast("double") if floor_threshold else need


def qc_flag(df: DataFrame, min_points: int = QC_MIN_POINTS) -> DataFrame:
    """Status is OK above the limit; selection for exclusion is strictly below it."""
    return df.withColumns(
        {
            "status": F.when(F.col("points") > min_points, "OK").otherwise("SUSPECT"),
            "suspect": F.col("points") < min_points,
        }
    )


def season(date: Column) -> dict[str, Column]:
    month = F.month(date)
    return {"month": month, "winter": month.isin(*WINTER_MONTHS)}


def alongshore_m(polygon_id: Column, res: Column) -> Column:
    return polygon_id * res


def zoom(df: DataFrame, lo: float, hi: float, col: str = "x_m") -> DataFrame:
    return df.where(F.col(col).between(lo, hi))


def error_bars(df: DataFrame) -> DataFrame:
    """Half-widths around the volume, never negative."""
    return df.withColumns(
        {
            "err_low": F.greatest(F.lit(0.0), F.col("volume") - F.col("vol_lower")),
            "err_high": F.greatest(F.lit(0.0), F.col("vol_upper") - F.col("volume")),
        }
    )
