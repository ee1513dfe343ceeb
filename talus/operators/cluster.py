"""Density clustering of change points.

Points of one cell of side eps/sqrt(3) are mutual neighbours, so the graph to
connect has cells for nodes, not points: a cell holding ``min_samples`` points
consists of core points and needs no distance at all, and two cells are linked
as soon as one pair of their core points is close enough.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.config import CLUSTER_EPS, CLUSTER_MIN_SAMPLES
from talus.operators.lineage import cut
from talus.operators.neighbours import AXES, LEAF, Sphere, range_moments
from talus.operators.ranks import ranked

PAIR_LIMIT = 4096
NOISE = -1


def dbscan(
    points: DataFrame,
    eps: float = CLUSTER_EPS,
    min_samples: int = CLUSTER_MIN_SAMPLES,
    by: list[str] = (),
    label_base: int = 1,
    leaf: int = LEAF,
    pair_limit: int = PAIR_LIMIT,
) -> DataFrame:
    """Adds ``cluster_id``: noise is -1, clusters count from ``label_base`` in order of their first core point.

    A border point joins the lowest numbered adjacent cluster.  Groups with
    fewer than ``min_samples`` points yield no rows.  ``point_id`` must be
    unique within a group.
    """
    by = list(by)
    side = eps / math.sqrt(3) * (1 - 1e-9)
    cell = [f"c{a}" for a in AXES]
    locs = points.groupBy(*by, *AXES).agg(F.count(F.lit(1)).alias("w"), F.min("point_id").alias("pid"))
    locs = cut(locs.withColumns({f"c{a}": F.floor(F.col(a) / F.lit(side)) for a in AXES}))

    weights = locs.groupBy(*by, *cell).agg(F.sum("w").alias("cell_w"))
    locs = locs.join(weights, by + cell)
    sparse = locs.where(F.col("cell_w") < min_samples).withColumnRenamed("pid", "query_id")
    counts = range_moments(sparse, locs, Sphere(eps), by, weight="w", moments=["n"], leaf=leaf)
    counts = counts.select(*by, F.col("query_id").alias("pid"), F.col("n").alias("_n"))
    locs = locs.join(counts, by + ["pid"], "left")
    core = (F.col("cell_w") >= min_samples) | (F.coalesce("_n", F.lit(0)) >= min_samples)
    locs = cut(locs.select(*by, "pid", *AXES, *cell, core.alias("core")))

    core_locs = locs.where("core")
    nodes = core_locs.groupBy(*by, *cell).agg(
        F.min("pid").alias("node"),
        F.count(F.lit(1)).alias("size"),
        *[F.min(a).alias(f"lo_{a}") for a in AXES],
        *[F.max(a).alias(f"hi_{a}") for a in AXES],
    )
    nodes = cut(nodes)
    edges = _cell_links(nodes, core_locs, eps, side, by, pair_limit)
    roots = components(nodes.select(*by, "node"), edges, by)
    numbered = ranked(roots.select(*by, "root").distinct(), by, "root")
    numbered = numbered.select(*by, "root", (F.col("before") + label_base).cast("int").alias("label"))
    cells = nodes.join(roots, by + ["node"]).join(numbered, by + ["root"]).select(*by, *cell, "label")

    labelled = cut(core_locs.join(cells, by + cell).select(*by, "pid", *AXES, "label"))
    rest = locs.where(~F.col("core"))
    border = range_moments(
        rest.withColumnRenamed("pid", "query_id"), labelled, Sphere(eps), by, least="label", moments=[], leaf=leaf
    ).select(*by, F.col("query_id").alias("pid"), F.col("least").alias("label"))
    rest = rest.join(border, by + ["pid"], "left")
    result = labelled.select(*by, *AXES, "label").unionByName(rest.select(*by, *AXES, "label"))

    out = points.join(result, by + list(AXES)).withColumn("cluster_id", F.coalesce("label", F.lit(NOISE))).drop("label")
    if by:
        enough = points.groupBy(*by).count().where(F.col("count") >= min_samples).select(*by)
        return out.join(enough, by, "left_semi")
    return out.where(points.agg(F.count(F.lit(1))).scalar() >= min_samples)


def _cell_links(nodes, core_locs, eps, side, by, pair_limit) -> DataFrame:
    """Pairs of cells holding two core points within eps, as (src, dst) node ids."""
    # lower corners of two linked cells are at most eps + side apart, so cells meet
    # through a grid of that side: each of its cells with itself and half of its neighbours
    coarse = (eps + side) * (1 + 1e-9)
    half = [o for o in itertools.product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]
    offsets = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o)]) for o in half])
    box = [f"{end}_{a}" for end in ("lo", "hi") for a in AXES]

    def side_of(s: str, name: str) -> DataFrame:
        return nodes.select(
            *by,
            F.col("node").alias(name),
            F.col("size").alias(f"size_{s}"),
            *[F.col(f"c{a}").alias(f"c{s}_{a}") for a in AXES],
            *[F.col(c).alias(f"{s}_{c}") for c in box],
            *[F.floor(F.col(f"lo_{a}") / F.lit(coarse)).alias(f"k{a}") for a in AXES],
        )

    left = side_of("a", "src").withColumn("_o", F.explode(offsets))
    same = reduce(lambda u, v: u & v, [F.col(f"_o.d{a}") == 0 for a in AXES])
    left = left.withColumn("_same", same).withColumns({f"k{a}": F.col(f"k{a}") + F.col(f"_o.d{a}") for a in AXES})
    # Spark's estimate leaves out the copies, so without the hint it would broadcast them
    pairs = left.drop("_o").hint("merge").join(side_of("b", "dst"), by + [f"k{a}" for a in AXES])
    pairs = pairs.where(~F.col("_same") | (F.col("src") < F.col("dst"))).drop("_same", *[f"k{a}" for a in AXES])
    links = []
    while True:
        pairs = cut(
            pairs.where(_box_gap2() <= F.lit(eps**2)).withColumn("_sure", _box_reach2() <= F.lit(eps**2))
        )
        links.append(pairs.where("_sure").select(*by, "src", "dst"))
        open_pairs = pairs.where(~F.col("_sure"))
        small = open_pairs.where(F.col("size_a") * F.col("size_b") <= pair_limit)
        placed = core_locs.select(
            *by, *AXES, *[F.floor(F.col(a) / F.lit(side)).alias(f"k{a}") for a in AXES]
        )
        a = placed.select(*by, *[F.col(c).alias(f"xa_{c}") for c in AXES], *[F.col(f"k{c}").alias(f"ca_{c}") for c in AXES])
        b = placed.select(*by, *[F.col(c).alias(f"xb_{c}") for c in AXES], *[F.col(f"k{c}").alias(f"cb_{c}") for c in AXES])
        d2 = reduce(lambda u, v: u + v, [(F.col(f"xa_{c}") - F.col(f"xb_{c}")) ** 2 for c in AXES])
        close = (
            small.select(*by, "src", "dst", *[f"ca_{c}" for c in AXES], *[f"cb_{c}" for c in AXES])
            .join(a, by + [f"ca_{c}" for c in AXES])
            .join(b, by + [f"cb_{c}" for c in AXES])
            .where(d2 <= F.lit(eps**2))
        )
        links.append(close.select(*by, "src", "dst").distinct())
        big = open_pairs.where(F.col("size_a") * F.col("size_b") > pair_limit)
        if big.isEmpty():
            return reduce(DataFrame.unionByName, links).distinct()
        # split both cells of the large pairs into eight and look again; pairs already linked need no more work
        side /= 2
        big = big.join(reduce(DataFrame.unionByName, links), by + ["src", "dst"], "left_anti")
        boxes = core_locs.groupBy(*by, *[F.floor(F.col(a) / F.lit(side)).alias(f"k{a}") for a in AXES]).agg(
            F.count(F.lit(1)).alias("size"),
            *[F.min(a).alias(f"lo_{a}") for a in AXES],
            *[F.max(a).alias(f"hi_{a}") for a in AXES],
        )
        pairs = big.select(*by, "src", "dst", *[f"ca_{c}" for c in AXES], *[f"cb_{c}" for c in AXES])
        for s in ("a", "b"):
            halves = F.array(
                *[
                    F.struct(*[(F.col(f"c{s}_{c}") * 2 + d).alias(f"c{s}_{c}") for c, d in zip(AXES, o)])
                    for o in itertools.product((0, 1), repeat=3)
                ]
            )
            keep = [c for c in pairs.columns if not c.startswith(f"c{s}_")]
            pairs = pairs.select(*keep, F.explode(halves).alias("_k")).select(*keep, "_k.*")
            sub = boxes.select(
                *by,
                *[F.col(f"k{c}").alias(f"c{s}_{c}") for c in AXES],
                F.col("size").alias(f"size_{s}"),
                *[F.col(c).alias(f"{s}_{c}") for c in box],
            )
            pairs = pairs.join(sub, by + [f"c{s}_{c}" for c in AXES])


def _box_gap2() -> Column:
    """Squared distance between two boxes."""
    gaps = [
        F.greatest(
            F.col(f"a_lo_{a}") - F.col(f"b_hi_{a}"), F.col(f"b_lo_{a}") - F.col(f"a_hi_{a}"), F.lit(0.0)
        )
        for a in AXES
    ]
    return reduce(lambda u, v: u + v, [g * g for g in gaps])


def _box_reach2() -> Column:
    """Squared distance of the two farthest corners."""
    spans = [
        F.greatest(F.col(f"a_hi_{a}") - F.col(f"b_lo_{a}"), F.col(f"b_hi_{a}") - F.col(f"a_lo_{a}")) for a in AXES
    ]
    return reduce(lambda u, v: u + v, [s * s for s in spans])


def components(nodes: DataFrame, edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """Connected components as (node, root), the root being the least node.

    Each round contracts the graph: a node hooks to its least lesser neighbour,
    chains of hooks are followed to their ends, and the edges become the
    distinct pairs of different ends, so nodes and edges that are settled are
    not read again. The least node of a component never hooks, so it is the root.
    What the rounds have hooked is put together from the last round back.
    Hubs only occur on the side of joins that adaptive execution can split.
    """
    by = list(by)
    a, b = F.greatest("src", "dst"), F.least("src", "dst")
    links = edges.where(F.col("src") != F.col("dst")).select(*by, a.alias("hi"), b.alias("lo"))
    layers: list[DataFrame] = []
    while True:
        links = cut(links)
        if links.isEmpty():
            break
        hooks = links.groupBy(*by, F.col("hi").alias("node")).agg(F.min("lo").alias("parent"))
        layer = _followed(hooks, by)
        layers.append(layer)
        upper = layer.select(*by, F.col("node").alias("hi"), F.col("parent").alias("p"))
        lower = layer.select(*by, F.col("node").alias("lo"), F.col("parent").alias("q"))
        moved = links.join(upper, by + ["hi"]).join(lower, by + ["lo"], "left")
        moved = moved.select(*by, "p", F.coalesce("q", "lo").alias("q")).where(F.col("p") != F.col("q"))
        links = moved.select(*by, F.greatest("p", "q").alias("hi"), F.least("p", "q").alias("lo")).distinct()
    if not layers:
        return nodes.select(*by, "node", F.col("node").alias("root"))
    known = layers.pop()
    while layers:
        top = known.select(*by, F.col("node").alias("parent"), F.col("parent").alias("top"))
        below = layers.pop().join(top, by + ["parent"], "left").select(*by, "node", F.coalesce("top", "parent").alias("parent"))
        known = cut(known.unionByName(below))
    found = nodes.select(*by, "node").join(known, by + ["node"], "left")
    return cut(found.select(*by, "node", F.coalesce("parent", "node").alias("root")))


def _followed(hooks: DataFrame, by: list[str]) -> DataFrame:
    """Every node with the end of its chain of hooks; a chain gets to a third with each round."""
    hooks = cut(hooks)
    while True:
        on = hooks.select(*by, F.col("node").alias("parent"), F.col("parent").alias("next"))
        # two steps of one table take every node three hooks on
        further = hooks.join(on, by + ["parent"], "left").select(*by, "node", F.coalesce("next", "parent").alias("parent"))
        ends = further.join(on, by + ["parent"], "left").select(*by, "node", F.coalesce("next", "parent").alias("parent"), "next")
        hooks = cut(ends)
        if hooks.where("next IS NOT NULL").isEmpty():
            return hooks.drop("next")
        hooks = hooks.drop("next")


def number_clusters(df: DataFrame, member: str, by: list[str] = (), label_base: int = 1) -> DataFrame:
    """Dense cluster numbers in order of the least member."""
    by = list(by)
    n = ranked(df.select(*by, member).distinct(), by, member)
    return df.join(n.select(*by, member, (F.col("before") + label_base).cast("int").alias("cluster_id")), by + [member])
