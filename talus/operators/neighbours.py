"""Range aggregation: moments of the points around each query point.

Queries meet points through a grid key, so the join is an equi-join whose
partitions follow space.  A query is repeated for the cells that its shape can
touch only; cells are wider than the shape, which keeps that at a few rows, and
the repeated rows are never broadcast, since they are many times what Spark
takes them for.  Cells with few points are compared point by point, denser ones
are sorted and searched where they lie, so nothing but the copies moves however
dense they are.  Cells with very many points are summarised in boxes which are taken whole,
dropped, or split into eight: the work per query then grows with the surface of
its neighbourhood, not with the number of points inside.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.functions import nearby
from talus.operators.lineage import cut, spread

cloudpickle.register_pickle_by_value(nearby)  # travels to executors with the job

SPARSE = 128  # points of a cell that are joined with its queries pair by pair
LEAF = 1 << 15  # points, or places in a box, that one task holds to search them
WIDTH = 3  # side of a cell in radii: a ball touches (1 + 2/3)^3 = 4.6 cells on average
SLACK = 1 + 1e-9
AXES = ("x", "y", "z")
PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")
MOMENTS = ["n", *[f"s{a}" for a in AXES], *[f"s{p}" for p in PAIRS]]


def cell_keys(coords: list[Column], side: float) -> list[Column]:
    return [F.floor(c / F.lit(side)) for c in coords]


def cell_hash(keys: list[Column]) -> Column:
    """One join key per cell.

    Two cells that share a hash only add candidates, which the exact tests
    remove; within one query the keys are made distinct by hash.
    """
    return F.xxhash64(*keys)


def touched_cells(centre: list[Column], extent: list[Column], side: float) -> Column:
    """Hashes of the cells that a box of these half extents overlaps."""
    spans = [
        F.sequence(F.floor((c - e) / F.lit(side)), F.floor((c + e) / F.lit(side))) for c, e in zip(centre, extent)
    ]

    def walk(done: list[Column]) -> Column:
        if len(done) == len(spans) - 1:
            return F.transform(spans[-1], lambda i: cell_hash([*done, i]))
        return F.flatten(F.transform(spans[len(done)], lambda i: walk([*done, i])))

    return walk([])


class Sphere:
    """Ball of fixed radius around the query."""

    columns: tuple[str, ...] = ()

    def __init__(self, radius: float):
        self.radius, self.side = radius, WIDTH * radius

    def keys(self) -> Column:
        extent = [F.lit(self.radius * SLACK)] * 3
        return F.array_distinct(touched_cells([F.col(f"q{a}") for a in AXES], extent, self.side))

    def search(self):
        return nearby.ball(self.radius)

    def member(self, p: list[Column]) -> Column:
        return _norm2([c - F.col(f"q{a}") for a, c in zip(AXES, p)]) <= F.lit(self.radius**2)

    def holds_box(self, lo: list[Column], hi: list[Column]) -> Column:
        far = [F.greatest(F.abs(l - F.col(f"q{a}")), F.abs(h - F.col(f"q{a}"))) for a, l, h in zip(AXES, lo, hi)]
        return _norm2(far) <= F.lit(self.radius**2)

    def misses_box(self, lo: list[Column], hi: list[Column]) -> Column:
        return _norm2(_gaps(lo, hi)) > F.lit(self.radius**2)


class Cylinder:
    """Cylinder along the query's unit axis (nx, ny, nz), reaching ``depth`` to both sides."""

    columns = ("nx", "ny", "nz")

    def __init__(self, radius: float, depth: float):
        self.radius, self.depth = radius, depth
        self.side = WIDTH * math.sqrt(radius * max(radius, depth))

    def keys(self) -> Column:
        # cut into pieces, each in a box of its own: a slanting cylinder fills little of the box around all of it
        steps = math.ceil(self.depth / self.radius)
        half = self.depth / steps
        axis = [F.col(f"n{a}") for a in AXES]
        extent = [
            (F.abs(n) * half + F.sqrt(F.greatest(1 - n * n, F.lit(0.0))) * self.radius) * F.lit(SLACK) + F.lit(1e-7 * self.radius)
            for n in axis
        ]
        pieces = F.transform(
            F.sequence(F.lit(1 - steps), F.lit(steps - 1), F.lit(2)),
            lambda i: touched_cells(
                [F.col(f"q{a}") + i * F.lit(half) * n for a, n in zip(AXES, axis)], extent, self.side
            ),
        )
        return F.array_distinct(F.flatten(pieces))

    def search(self):
        return nearby.rod(self.radius, self.depth)

    def member(self, p: list[Column]) -> Column:
        d = [c - F.col(f"q{a}") for a, c in zip(AXES, p)]
        along = reduce(lambda u, v: u + v, [x * F.col(f"n{a}") for a, x in zip(AXES, d)])
        across = [x - along * F.col(f"n{a}") for a, x in zip(AXES, d)]
        return (F.abs(along) <= self.depth) & (_norm2(across) <= F.lit(self.radius**2))

    def holds_box(self, lo: list[Column], hi: list[Column]) -> Column:
        # convex: a box lies inside when its corners do
        corners = itertools.product(*zip(lo, hi))
        return reduce(lambda a, b: a & b, [self.member(list(c)) for c in corners])

    def misses_box(self, lo: list[Column], hi: list[Column]) -> Column:
        return _norm2(_gaps(lo, hi)) > F.lit(self.radius**2 + self.depth**2)


def _norm2(v: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c * c for c in v])


def _gaps(lo: list[Column], hi: list[Column]) -> list[Column]:
    return [
        F.greatest(l - F.col(f"q{a}"), F.col(f"q{a}") - h, F.lit(0.0)) for a, l, h in zip(AXES, lo, hi)
    ]


def _point_moments(w: Column, d: list[Column]) -> dict[str, Column]:
    by_axis = dict(zip(AXES, d))
    out = {"n": F.sum(w)}
    out |= {f"s{a}": F.sum(w * by_axis[a]) for a in AXES}
    out |= {f"s{p}": F.sum(w * by_axis[p[0]] * by_axis[p[1]]) for p in PAIRS}
    return out


def range_moments(
    queries: DataFrame,
    points: DataFrame,
    shape: Sphere | Cylinder,
    by: list[str] = (),
    weight: str | None = None,
    least: str | None = None,
    moments: list[str] = tuple(MOMENTS),
    leaf: int = LEAF,
) -> DataFrame:
    """Moments, about the query, of the points inside its shape.

    ``queries`` holds ``by``, ``query_id``, x, y, z and the shape's columns;
    ``points`` holds ``by``, x, y, z and optionally a weight and a column whose
    least value is wanted.  Returns one row per query that has any member.
    """
    by = list(by)
    w = F.col(weight) if weight else F.lit(1)
    q = queries.select(*by, "query_id", *[F.col(a).alias(f"q{a}") for a in AXES], *shape.columns)
    pts = points.select(
        *by,
        *[F.col(a).alias(f"p{a}") for a in AXES],
        w.alias("w"),
        *([F.col(least).alias("least")] if least else []),
        cell_hash(cell_keys([F.col(a) for a in AXES], shape.side)).alias("k"),
    )
    keys = by + ["k"]
    wanted = list(moments) + (["least"] if least else [])
    p = [F.col(f"p{a}") for a in AXES]

    def from_points(joined: DataFrame, *group: str) -> DataFrame:
        hit = joined.where(shape.member(p))
        m = _point_moments(F.col("w"), [F.col(f"p{a}") - F.col(f"q{a}") for a in AXES])
        return hit.groupBy(*by, "query_id", *group).agg(
            *[m[k].alias(k) for k in moments], *([F.min("least").alias("least")] if least else [])
        ).drop(*group)

    # the size that Spark estimates knows nothing of the copies: without the hint it would broadcast them
    reach = q.select("*", F.explode(shape.keys()).alias("k"))
    crowded = cut(pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min(SPARSE, leaf)))
    if crowded.isEmpty():
        return from_points(reach.hint("merge").join(pts, keys))

    # the rows of a cell are together then: grouped by cell, too, they stay where they are
    few = [df.join(crowded, keys, "left_anti") for df in (reach, pts)]
    parts = [from_points(few[0].hint("merge").join(few[1], keys), "k")]
    dense, heavy = (crowded.where(c).select(*keys) for c in (F.col("_n") <= leaf, F.col("_n") > leaf))
    if not dense.isEmpty():
        some = [df.join(dense, keys, "left_semi") for df in (reach, pts)]
        parts.append(_searched(*some, keys, shape, by, moments, least))
    if not heavy.isEmpty():
        full = pts.join(heavy, keys, "left_semi")
        locs = cut(
            full.groupBy(*by, "px", "py", "pz").agg(
                F.sum("w").alias("w"), *([F.min("least").alias("least")] if least else [])
            )
        )
        parts += _from_boxes(reach.join(heavy, keys, "left_semi"), locs, shape, by, moments, least, leaf)
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy(*by, "query_id").agg(
        *[(F.min if k == "least" else F.sum)(k).alias(k) for k in wanted]
    )


def _searched(asked, points, keys, shape, by, moments, least) -> DataFrame:
    """Partial moments of the queries of each cell, searched among its points by the task that has the cell."""
    given = {f.name: f.dataType for f in asked.schema} | {f.name: f.dataType for f in points.schema}
    own = ["w", *(["least"] if least else [])]
    none = lambda c: F.lit(None).cast(given[c]).alias(c)
    queries = asked.select(
        *keys, F.lit(True).alias("asked"), "query_id", *[F.col(f"q{a}").alias(a) for a in AXES], *shape.columns, *map(none, own)
    )
    known = points.select(
        *keys, F.lit(False).alias("asked"), none("query_id"), *[F.col(f"p{a}").alias(a) for a in AXES], *map(none, shape.columns), *own
    )
    both = known.unionByName(queries).na.drop(subset=keys)
    count = T.LongType() if isinstance(given["w"], T.IntegralType) else T.DoubleType()
    schema = T.StructType([T.StructField(c, given[c]) for c in [*by, "query_id"]])
    for m in moments:
        schema.add(m, count if m == "n" else T.DoubleType())
    if least:
        schema.add("least", given["least"])
    find = nearby.searcher(keys, by, list(shape.columns), shape.search(), list(moments), bool(least))
    return spread(both, *keys).sortWithinPartitions(*keys, "asked").mapInArrow(find, schema)


def _from_boxes(frontier, locs, shape, by, moments, least, leaf) -> list[DataFrame]:
    parts, side = [], shape.side
    keys = by + ["k"]
    needed = [k for k in MOMENTS if k in moments] if set(moments) <= {"n"} else MOMENTS
    at = [f"k{a}" for a in AXES]
    q_cols = ["query_id", *[f"q{a}" for a in AXES], *shape.columns]
    while True:
        placed = locs.withColumns({f"k{a}": F.floor(F.col(f"p{a}") / F.lit(side)) for a in AXES})
        placed = placed.withColumn("k", cell_hash([F.col(c) for c in at]))
        corner = [F.col(f"k{a}") * F.lit(side) for a in AXES]
        m = _point_moments(F.col("w"), [F.col(f"p{a}") - c for a, c in zip(AXES, corner)])
        boxes = placed.groupBy(*keys, *at).agg(
            F.count(F.lit(1)).alias("_locs"),
            *[F.min(f"p{a}").alias(f"lo_{a}") for a in AXES],
            *[F.max(f"p{a}").alias(f"hi_{a}") for a in AXES],
            *[m[k].alias(f"b_{k}") for k in needed],
            *([F.min("least").alias("least")] if least else []),
        )
        lo, hi = [F.col(f"lo_{a}") for a in AXES], [F.col(f"hi_{a}") for a in AXES]
        met = frontier.hint("merge").join(boxes, keys).where(~shape.misses_box(lo, hi))
        met = cut(met.withColumn("_whole", shape.holds_box(lo, hi)))

        shift = {a: F.col(f"k{a}") * F.lit(side) - F.col(f"q{a}") for a in AXES}
        b = {k: F.col(f"b_{k}") for k in needed}
        moved = dict(b)
        if "sx" in b:
            moved |= {f"s{a}": b[f"s{a}"] + b["n"] * shift[a] for a in AXES}
        for i, j in PAIRS if "sx" in b else ():
            moved[f"s{i}{j}"] = (
                b[f"s{i}{j}"] + b[f"s{i}"] * shift[j] + b[f"s{j}"] * shift[i] + b["n"] * shift[i] * shift[j]
            )
        parts.append(
            met.where("_whole").select(
                *by, "query_id", *[moved[k].alias(k) for k in moments], *(["least"] if least else [])
            )
        )
        split = met.where(~F.col("_whole"))
        near = split.where(F.col("_locs") <= leaf).select(*keys, *at, *q_cols)
        known = placed.join(boxes.where(F.col("_locs") <= leaf).select(*keys, *at), keys + at, "left_semi")
        parts.append(_searched(near, known, keys + at, shape, by, moments, least))

        children = F.array(
            *[
                cell_hash([F.col(f"k{a}") * 2 + F.lit(d).cast("long") for a, d in zip(AXES, offset)])
                for offset in itertools.product((0, 1), repeat=3)
            ]
        )
        big = split.where(F.col("_locs") > leaf)
        if big.isEmpty():
            return parts
        frontier = big.select(*by, *q_cols, F.explode(F.array_distinct(children)).alias("k")).distinct()
        side /= 2


def radius_counts(
    points: DataFrame, radius: float, by: list[str] = (), key: str = "point_id", leaf: int = LEAF
) -> DataFrame:
    """Number of points within the radius of each point, itself included."""
    q = points.withColumnRenamed(key, "query_id")
    out = range_moments(q, points, Sphere(radius), by, moments=["n"], leaf=leaf)
    return out.withColumnRenamed("query_id", key)


def radius_pairs(points: DataFrame, radius: float, by: list[str] = (), key: str = "point_id") -> DataFrame:
    """Unordered pairs (a < b) of points within the radius of each other.

    The result itself grows with the square of the local density; counting,
    clustering, thinning and change detection do not go through it.
    """
    by = list(by)
    at = [F.col(a) for a in AXES]
    shape = Sphere(radius)
    q = points.select(*by, F.col(key).alias("a"), *[F.col(c).alias(f"q{c}") for c in AXES])
    q = q.select("*", F.explode(shape.keys()).alias("k")).hint("merge")
    p = points.select(
        *by,
        F.col(key).alias("b"),
        *[F.col(c).alias(f"p{c}") for c in AXES],
        cell_hash(cell_keys(at, shape.side)).alias("k"),
    )
    d2 = _norm2([F.col(f"p{c}") - F.col(f"q{c}") for c in AXES])
    hit = q.join(p, by + ["k"]).where(F.col("a") < F.col("b")).where(d2 <= F.lit(radius**2))
    return hit.select(*by, "a", "b", F.sqrt(d2).alias("distance"))
