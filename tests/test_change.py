import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talus.functions.geometry import eigenvector, symmetric_eigen
from talus.operators.change import m3c2, normals, shape_features
from talus.operators.thin import thin


def frame(spark, xyz):
    pdf = pd.DataFrame(xyz, columns=["x", "y", "z"])
    pdf.insert(0, "point_id", np.arange(len(xyz)))
    return spark.createDataFrame(pdf)


def test_eigen_matches_numpy(spark):
    rng = np.random.default_rng(0)
    mats = [(lambda a: a @ a.T)(rng.normal(size=(3, 3))) for _ in range(50)] + [np.eye(3), np.diag([3.0, 2, 1])]
    rows = [tuple(float(v) for v in (m[0, 0], m[0, 1], m[0, 2], m[1, 1], m[1, 2], m[2, 2])) for m in mats]
    df = spark.createDataFrame(rows, "xx double, xy double, xz double, yy double, yz double, zz double")
    m = F.struct(*df.columns)
    df = df.withColumn("e", symmetric_eigen(m)).withColumn("v", eigenvector(m, F.col("e.l3")))
    for r, mat in zip(df.collect(), mats):
        want = np.linalg.eigvalsh(mat)[::-1]
        assert np.allclose([r.e.l1, r.e.l2, r.e.l3], want, atol=1e-9)
        if r.v is not None:
            v = np.array([r.v.x, r.v.y, r.v.z])
            assert np.allclose(mat @ v, want[2] * v, atol=1e-6)


def plane_points(offset, seed, n=400):
    """Points on a tilted plane, moved along its normal."""
    rng = np.random.default_rng(seed)
    normal = np.array([0.3, -0.2, 1.0])
    normal /= np.linalg.norm(normal)
    u = np.cross(normal, [1, 0, 0])
    u /= np.linalg.norm(u)
    v = np.cross(normal, u)
    st = rng.uniform(-2, 2, (n, 2))
    return st[:, :1] * u + st[:, 1:] * v + normal * (offset + rng.normal(0, 0.005, (n, 1))), normal


def test_planted_offset_is_found(spark):
    (a, normal), (b, _) = plane_points(0.0, 1), plane_points(-0.4, 2)
    ref, cmp = frame(spark, a), frame(spark, b)
    core = ref.where("abs(x) < 1 and abs(y) < 1")
    got = m3c2(core, ref, cmp, 1.0, 0.6, 2.0, 0.01).toPandas()
    assert len(got) == core.count()
    assert np.allclose(got.m3c2, -0.4, atol=0.02)
    assert got.significant.all()
    assert (got[["nx", "ny", "nz"]].to_numpy() @ normal > 0.99).all()


def test_m3c2_matches_brute_force(spark):
    (a, _), (b, _) = plane_points(0.0, 3, 150), plane_points(0.2, 4, 150)
    got = m3c2(frame(spark, a), frame(spark, a), frame(spark, b), 1.5, 0.8, 1.0, 0.02).toPandas().set_index("point_id")
    for i, q in enumerate(a):
        near = a[np.linalg.norm(a - q, axis=1) <= 0.75]
        if len(near) < 3:
            assert i not in got.index
            continue
        w, v = np.linalg.eigh(np.cov(near.T, bias=True))
        n = v[:, 0] * (1 if v[2, 0] >= 0 else -1)
        sides = []
        for cloud in (a, b):
            t = (cloud - q) @ n
            off = np.linalg.norm((cloud - q) - t[:, None] * n, axis=1)
            sides.append(t[(abs(t) <= 1.0) & (off <= 0.4)])
        if not all(len(s) for s in sides):
            assert i not in got.index
            continue
        row = got.loc[i]
        assert (row.n_ref, row.n_cmp) == (len(sides[0]), len(sides[1]))
        assert row.m3c2 == pytest.approx(sides[1].mean() - sides[0].mean(), abs=1e-6)
        if min(map(len, sides)) > 1:
            lod = 1.96 * np.sqrt(sum(s.var(ddof=1) / len(s) for s in sides)) + 0.02
            assert row.uncertainty == pytest.approx(lod, abs=1e-6)
            assert row.significant == (abs(row.m3c2) > lod)
        else:
            assert np.isnan(row.uncertainty) and not row.significant


def test_shape_features_tell_line_from_plane(spark):
    line = np.column_stack([np.linspace(0, 1, 60), np.zeros(60), np.zeros(60)])
    plane = np.random.default_rng(0).uniform(0, 1, (300, 3)) * [1, 1, 0] + [5, 5, 5]
    got = shape_features(frame(spark, np.concatenate([line, plane])), [0.6]).toPandas()
    assert got[got.x < 2].p1_60cm.min() > 0.99
    assert np.allclose((got.p1_60cm + got.p2_60cm)[got.x > 4], 1.0, atol=1e-6)
    assert got[got.x > 4].p1_60cm.median() < 0.8


@pytest.mark.parametrize("radius", [0.1, 0.3])
def test_thinning_keeps_spacing_and_is_maximal(spark, radius):
    rng = np.random.default_rng(7)
    xyz = np.concatenate([rng.uniform(0, 1, (400, 3)), np.tile([[0.5, 0.5, 0.5]], (30, 1)), rng.normal(0.2, 0.02, (200, 3))])
    kept = thin(frame(spark, xyz), radius, seed=3).toPandas()
    p = kept[["x", "y", "z"]].to_numpy()
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert d.min() >= radius
    assert (np.linalg.norm(xyz[:, None] - p[None], axis=2).min(axis=1) < radius).all()


def test_thinning_a_line(spark):
    line = np.column_stack([np.arange(200) * 0.01, np.zeros(200), np.zeros(200)])
    p = np.sort(thin(frame(spark, line), 0.05).toPandas().x.to_numpy())
    assert np.diff(p).min() >= 0.05 - 1e-12 and np.diff(p).max() < 0.1 + 1e-12


def test_normals_need_three_points(spark):
    q = frame(spark, np.array([[0, 0, 0], [9, 9, 9.0]])).withColumnRenamed("point_id", "query_id")
    cloud = frame(spark, np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [9, 9, 9], [9, 9, 9.5]], float))
    got = normals(q, cloud, 4.0).toPandas()
    assert list(got.query_id) == [0] and got.nz[0] == pytest.approx(1.0)
