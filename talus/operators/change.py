"""Local shape and cloud-to-cloud change from neighbourhood moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.geometry import eigenvector, let, symmetric_eigen
from talus.operators.lineage import cut
from talus.operators.neighbours import AXES, PAIRS, Cylinder, Sphere, range_moments

CONFIDENCE = 1.96  # two-sided 95 %


def _covariance() -> Column:
    """Population covariance struct(xx .. zz) of the moments."""
    n = F.col("n")
    return F.struct(
        *[(F.col(f"s{i}{j}") / n - (F.col(f"s{i}") / n) * (F.col(f"s{j}") / n)).alias(i + j) for i, j in PAIRS]
    )


def shape_features(points: DataFrame, scales: list[float], by: list[str] = (), key: str = "point_id") -> DataFrame:
    """Shares of variance along the first two principal axes around each point, per scale.

    A scale is a diameter.  With fewer than three neighbours, or no spread, the
    shares are those of an isotropic neighbourhood.
    """
    by = list(by)
    queries = points.withColumnRenamed(key, "query_id")
    out = points
    for s in scales:
        tag = f"{round(s * 100)}cm"

        def shares(e: Column) -> Column:
            total = e["l1"] + e["l2"] + e["l3"]
            known = (F.col("n") >= 3) & (total > 0)
            return F.struct(
                *[F.when(known, e[f"l{i}"] / total).otherwise(F.lit(1.0 / 3)).alias(f"p{i}_{tag}") for i in (1, 2)]
            )

        m = range_moments(queries, points, Sphere(s / 2), by)
        m = m.withColumn("_p", let(symmetric_eigen(_covariance()), shares)).select(
            *by, F.col("query_id").alias(key), F.col("n").alias(f"n_{tag}"), "_p.*"
        )
        out = out.join(m, by + [key])
    return out


def normals(
    core: DataFrame, cloud: DataFrame, scale: float, by: list[str] = (), towards: tuple[float, float, float] = (0.0, 0.0, 1.0)
) -> DataFrame:
    """Unit normals of the cloud around core points (``query_id``), turned to the preferred side.

    Core points with fewer than three neighbours have none and are left out.
    """
    by = list(by)
    def turned(v: Column) -> Column:
        side = sum((v[a] * F.lit(t) for a, t in zip(AXES, towards)), start=F.lit(0.0))
        sign = F.when(side < 0, -1.0).otherwise(1.0)
        return F.struct(*[(v[a] * sign).alias(f"n{a}") for a in AXES])

    def normal(m: Column) -> Column:
        return let(symmetric_eigen(m), lambda e: let(eigenvector(m, e["l3"]), lambda v: F.when(v.isNotNull(), turned(v))))

    moments = range_moments(core, cloud, Sphere(scale / 2), by).where(F.col("n") >= 3)
    found = moments.select(*by, "query_id", F.inline(F.array(let(_covariance(), normal)))).where(F.col("nx").isNotNull())
    return core.select(*by, "query_id", *AXES).join(found, by + ["query_id"])


def _along(prefix: str) -> tuple[Column, Column]:
    """Mean and sample variance of the members' offsets along the axis."""
    n = F.col(f"{prefix}_n")
    axis = {a: F.col(f"n{a}") for a in AXES}
    mean = sum((F.col(f"{prefix}_s{a}") * axis[a] for a in AXES), start=F.lit(0.0)) / n
    square = F.lit(0.0)
    for i, j in PAIRS:
        square = square + (1 if i == j else 2) * F.col(f"{prefix}_s{i}{j}") * axis[i] * axis[j]
    return mean, F.greatest(square - n * mean * mean, F.lit(0.0)) / (n - 1)


def m3c2(
    core: DataFrame,
    ref: DataFrame,
    cmp: DataFrame,
    normal_scale: float,
    proj_scale: float,
    depth: float,
    reg: float = 0.0,
    by: list[str] = (),
    normal: str = "local",
    min_points: int = 2,
) -> DataFrame:
    """Signed distance between two clouds along local normals, with its 95 % detection level.

    For each core point (``point_id``) the points of both clouds within a
    cylinder of diameter ``proj_scale`` along the normal are averaged; the
    distance is the second mean less the first.  Uncertainty is
    ``1.96 * sqrt(s1^2/n1 + s2^2/n2) + reg`` and a change is significant when it
    exceeds that.  ``normal="vertical"`` uses the z axis throughout.  With
    fewer than ``min_points`` on a side there is no uncertainty.
    """
    by = list(by)
    q = core.withColumnRenamed("point_id", "query_id")
    if normal == "vertical":
        q = q.select(*by, "query_id", *AXES, *[F.lit(v).alias(f"n{a}") for a, v in zip(AXES, (0.0, 0.0, 1.0))])
    else:
        q = cut(normals(q, ref, normal_scale, by))
    shape = Cylinder(proj_scale / 2, depth)
    out = q
    for prefix, cloud in (("a", ref), ("b", cmp)):
        m = range_moments(q, cloud, shape, by)
        out = out.join(m.select(*by, "query_id", *[F.col(c).alias(f"{prefix}_{c}") for c in m.columns if c not in by + ["query_id"]]), by + ["query_id"])
    (m1, v1), (m2, v2) = _along("a"), _along("b")
    n1, n2 = F.col("a_n"), F.col("b_n")
    enough = (n1 >= min_points) & (n2 >= min_points) & (n1 > 1) & (n2 > 1)
    lod = F.when(enough, CONFIDENCE * F.sqrt(v1 / n1 + v2 / n2) + F.lit(reg))
    return out.select(
        *by,
        F.col("query_id").alias("point_id"),
        *AXES,
        "nx",
        "ny",
        "nz",
        n1.alias("n_ref"),
        n2.alias("n_cmp"),
        (m2 - m1).alias("m3c2"),
        lod.alias("uncertainty"),
        F.coalesce(F.abs(m2 - m1) > lod, F.lit(False)).alias("significant"),
    )
