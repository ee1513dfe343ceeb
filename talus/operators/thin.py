"""Minimum-spacing thinning."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.config import THIN_RADIUS
from talus.operators.lineage import cut
from talus.operators.neighbours import AXES, SLACK, WIDTH, cell_hash, cell_keys, touched_cells


def thin(points: DataFrame, radius: float = THIN_RADIUS, by: list[str] = (), seed: int = 0) -> DataFrame:
    """A maximal subset in which no two points of a group are closer than the radius.

    Points of one cell of side radius/sqrt(3) exclude each other, so a cell
    keeps at most one point.  Each round every cell puts forward its open point
    of least hashed priority; one that beats the candidates of all cells around
    is kept, and open points too close to a kept point leave.  Candidates meet
    through a grid a few radii wide, which holds a bounded number of them per
    cell whatever the number of points.
    """
    by = list(by)
    side = radius / math.sqrt(3) * (1 - 1e-9)
    cell, coarse = [f"c{a}" for a in AXES], ["k"]
    wide, at = WIDTH * radius, [F.col(a) for a in AXES]

    def around(df: DataFrame) -> DataFrame:
        """The rows repeated for the coarse cells within reach, positions renamed; too many to be broadcast."""
        reach = F.array_distinct(touched_cells(at, [F.lit(radius * SLACK)] * 3, wide))
        return df.select(
            *by,
            F.col("point_id").alias("o_id"),
            F.col("pri").alias("o_pri"),
            *[F.col(a).alias(f"o_{a}") for a in AXES],
            F.explode(reach).alias("k"),
        ).hint("merge")

    close = reduce(lambda u, v: u + v, [(F.col(a) - F.col(f"o_{a}")) ** 2 for a in AXES]) < F.lit(radius**2)
    # of exact copies only one can stay
    first = F.min(F.struct(F.xxhash64(F.col("point_id"), F.lit(seed)).alias("pri"), "point_id")).alias("_m")
    unique = points.groupBy(*by, *AXES).agg(first).select(*by, *AXES, "_m.*")
    placed = unique.withColumns(dict(zip(cell, cell_keys(at, side))) | {"k": cell_hash(cell_keys(at, wide))})
    open_points = cut(placed)
    row = F.struct("pri", "point_id", *AXES, *coarse)
    kept = []
    while not open_points.isEmpty():
        candidates = cut(open_points.groupBy(*by, *cell).agg(F.min(row).alias("_r")).select(*by, *cell, "_r.*"))
        beaten = (
            candidates.join(around(candidates), by + coarse)
            .where(close & (F.struct("o_pri", "o_id") < F.struct("pri", "point_id")))
            .select(*by, "point_id")
            .distinct()
        )
        winners = cut(candidates.join(beaten, by + ["point_id"], "left_anti"))
        kept.append(winners.select(*by, "point_id"))
        # a kept point is close to itself and to the rest of its cell
        lost = open_points.join(around(winners), by + coarse).where(close).select(*by, "point_id").distinct()
        open_points = cut(open_points.join(lost, by + ["point_id"], "left_anti"))
    if not kept:
        return points
    return points.join(reduce(DataFrame.unionByName, kept), by + ["point_id"], "left_semi")
