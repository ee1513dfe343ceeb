"""Reproducible samples: a row's fate depends on its key and the seed only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.operators.lineage import cut

FEW = 1000  # rows that every task may hand to the last one


def draw(key: str, seed: int) -> Column:
    """Number in [0, 1) from key and seed; the same after any retry or repartitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement: those with the lowest draws.

    Few are a bounded top-n. For more, the rows below a draw that should be
    enough are stored and counted, and the draw is raised until it is; what
    is sorted does not grow with the data then.
    """
    # a column, since an expression would be computed again for every comparison
    drawn = df.withColumn("_draw", draw(key, seed))
    if n > FEW:
        rows, enough = df.count(), n + 8 * math.sqrt(n)
        while enough < rows:
            low = cut(drawn.where(F.col("_draw") < enough / rows))
            if low.count() >= n:
                drawn = low
                break
            enough *= 2
    return drawn.orderBy("_draw", key).limit(n).drop("_draw")


def sample_frac(df: DataFrame, fraction: float, key: str, seed: int = 0) -> DataFrame:
    return df.where(draw(key, seed) < fraction)
