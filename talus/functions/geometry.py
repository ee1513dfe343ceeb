"""Plane geometry as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and UTM projection constants.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_EASTING = 500000.0


def ring_edges(ring: Column) -> Column:
    """Edges of a ring given by its vertices, closed or not."""
    return F.transform(
        ring,
        lambda p, i: F.struct(
            p["x"].alias("x1"),
            p["y"].alias("y1"),
            F.get(ring, (i + 1) % F.size(ring))["x"].alias("x2"),
            F.get(ring, (i + 1) % F.size(ring))["y"].alias("y2"),
        ),
    )


def strictly_inside(x: Column, y: Column, edges: Column) -> Column:
    """Ray crossing, with points on an edge excluded."""

    def crosses(e: Column) -> Column:
        return ((e["y1"] > y) != (e["y2"] > y)) & (
            x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        )

    def touches(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (
            (cross == 0)
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    odd = F.aggregate(edges, F.lit(False), lambda acc, e: acc != F.coalesce(crosses(e), F.lit(False)))
    return odd & ~F.exists(edges, touches)


def is_box(ring: Column) -> Column:
    """True for an axis-parallel rectangle, where the bounding box is the polygon."""
    xs, ys = F.array_distinct(ring["x"]), F.array_distinct(ring["y"])
    corners = F.size(F.array_distinct(ring))
    bent = F.exists(ring_edges(ring), lambda e: (e["x1"] != e["x2"]) & (e["y1"] != e["y2"]))
    return (corners == 4) & (F.size(xs) == 2) & (F.size(ys) == 2) & ~bent


def to_utm(lon: Column, lat: Column, zone: int = 11) -> Column:
    """Northern-hemisphere UTM struct(x, y) by the transverse Mercator series in n to third order."""
    n = WGS84_F / (2 - WGS84_F)
    big_a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )
    e = 2 * math.sqrt(n) / (1 + n)
    phi = F.radians(lat)
    lam = F.radians(lon - F.lit(6.0 * zone - 183.0))
    s = F.sin(phi)
    atanh_s = F.log((1 + s) / (1 - s)) / 2
    atanh_es = F.log((1 + e * s) / (1 - e * s)) / 2
    t = F.sinh(atanh_s - e * atanh_es)
    xi = F.atan2(t, F.cos(lam))
    w = F.sin(lam) / F.sqrt(1 + t * t)
    eta = F.log((1 + w) / (1 - w)) / 2
    dx, dy = eta, xi
    for j, a in enumerate(alpha, start=1):
        dx = dx + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        dy = dy + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    scale = UTM_K0 * big_a
    return F.struct((UTM_EASTING + scale * dx).alias("x"), (scale * dy).alias("y"))


def extend_line(p: Column, q: Column, along: float) -> tuple[Column, Column]:
    """Both ends moved outwards; a line of zero length stays as it is."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    length = F.hypot(dx, dy)
    step = F.when(length > 0, along / length).otherwise(F.lit(0.0))

    def moved(v: Column, sign: int) -> Column:
        return F.struct((v["x"] + sign * step * dx).alias("x"), (v["y"] + sign * step * dy).alias("y"))

    return moved(p, -1), moved(q, 1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value bound to a variable, so that a value used many times is written once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def symmetric_eigen(m: Column) -> Column:
    """Eigenvalues struct(l1, l2, l3), largest first, of struct(xx, xy, xz, yy, yz, zz); trigonometric solution."""

    def spread2(m: Column, q: Column) -> Column:
        diagonal = sum(((m[k] - q) * (m[k] - q) for k in ("xx", "yy", "zz")), start=F.lit(0.0))
        return diagonal + 2 * (m["xy"] * m["xy"] + m["xz"] * m["xz"] + m["yz"] * m["yz"])

    def half_det(m: Column, q: Column, p: Column) -> Column:
        a, b, c, d, e, f = m["xx"] - q, m["yy"] - q, m["zz"] - q, m["xy"], m["xz"], m["yz"]
        det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))

    def roots(q: Column, p: Column, angle: Column) -> Column:
        l1, l3 = q + 2 * p * F.cos(angle), q + 2 * p * F.cos(angle + 2 * math.pi / 3)
        return F.struct(l1.alias("l1"), (3 * q - l1 - l3).alias("l2"), l3.alias("l3"))

    def solve(m: Column, q: Column, p: Column) -> Column:
        equal = F.struct(q.alias("l1"), q.alias("l2"), q.alias("l3"))
        return F.when(p > 0, let(F.acos(half_det(m, q, p)) / 3, lambda t: roots(q, p, t))).otherwise(equal)

    return let(
        m,
        lambda m: let(
            (m["xx"] + m["yy"] + m["zz"]) / 3,
            lambda q: let(F.sqrt(spread2(m, q) / 6), lambda p: solve(m, q, p)),
        ),
    )


def eigenvector(m: Column, lam: Column) -> Column:
    """Unit vector struct(x, y, z) of a simple eigenvalue.

    It is orthogonal to the rows of ``M - lam``; the longest of the three cross
    products is the best conditioned one.  Null when all vanish.
    """

    def cross(u, v):
        x, y, z = u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]
        return F.struct((x * x + y * y + z * z).alias("len2"), x.alias("x"), y.alias("y"), z.alias("z"))

    def longest(m: Column, lam: Column) -> Column:
        rows = ((m["xx"] - lam, m["xy"], m["xz"]), (m["xy"], m["yy"] - lam, m["yz"]), (m["xz"], m["yz"], m["zz"] - lam))
        return F.greatest(cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2]))

    def unit(b: Column) -> Column:
        return F.when(b["len2"] > 0, F.struct(*[(b[k] / F.sqrt(b["len2"])).alias(k) for k in ("x", "y", "z")]))

    return let(m, lambda m: let(lam, lambda e: let(longest(m, e), unit)))
