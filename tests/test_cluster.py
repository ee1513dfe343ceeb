import numpy as np
import pandas as pd
import pytest

from talus.operators.cluster import components, dbscan
from talus.operators.neighbours import MOMENTS, Cylinder, Sphere, radius_counts, radius_pairs, range_moments


def brute_dbscan(xyz, eps, min_samples, base=1):
    """Textbook density clustering in index order."""
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2) <= eps
    core = d.sum(1) >= min_samples
    labels = np.full(len(xyz), -1)
    nxt = base
    for i in range(len(xyz)):
        if not core[i] or labels[i] != -1:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if labels[j] != -1:
                continue
            labels[j] = nxt
            if core[j]:
                stack += list(np.flatnonzero(d[j] & (labels == -1)))
        nxt += 1
    return labels


def cloud(seed=0, n=400):
    rng = np.random.default_rng(seed)
    blobs = np.concatenate(
        [
            rng.normal([0, 0, 0], 0.05, (n // 3, 3)),
            rng.normal([1, 0, 0], 0.25, (n // 3, 3)),
            rng.uniform(-1, 2, (n // 3, 3)),
            np.tile([[0.5, 0.5, 0.5]], (20, 1)),
        ]
    )
    rng.shuffle(blobs)
    return blobs


def frame(spark, xyz, **extra):
    pdf = pd.DataFrame(xyz, columns=["x", "y", "z"])
    pdf.insert(0, "point_id", np.arange(len(xyz)))
    for k, v in extra.items():
        pdf[k] = v
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("leaf,pair_limit", [(256, 4096), (4, 6)])
@pytest.mark.parametrize("base", [0, 1])
def test_dbscan_matches_brute_force(spark, leaf, pair_limit, base):
    xyz = cloud()
    df = frame(spark, xyz)
    got = dbscan(df, 0.2, 8, label_base=base, leaf=leaf, pair_limit=pair_limit).toPandas().sort_values("point_id")
    assert (got.cluster_id.to_numpy() == brute_dbscan(xyz, 0.2, 8, base)).all()


def test_dbscan_groups_and_small_groups(spark):
    xyz = cloud(3, 200)
    g = np.arange(len(xyz)) % 2
    g[:5] = 7
    got = dbscan(frame(spark, xyz, g=g), 0.25, 6, by=["g"]).toPandas()
    assert set(got.g) == {0, 1}
    for k in (0, 1):
        sub = got[got.g == k].sort_values("point_id")
        assert (sub.cluster_id.to_numpy() == brute_dbscan(xyz[g == k], 0.25, 6)).all()


def test_border_point_takes_first_cluster(spark):
    line = [[-0.3 - 0.1 * i, 0, 0] for i in range(5)] + [[0.3 + 0.1 * i, 0, 0] for i in range(5)] + [[0, 0, 0]]
    got = dbscan(frame(spark, np.array(line)), 0.31, 4).toPandas().sort_values("point_id")
    assert list(got.cluster_id) == list(brute_dbscan(np.array(line), 0.31, 4))
    assert got.cluster_id.iloc[-1] == 1


@pytest.mark.parametrize("leaf", [256, 3])
@pytest.mark.parametrize("kind", ["sphere", "cylinder"])
def test_range_moments(spark, leaf, kind):
    xyz = cloud(5, 200)
    rng = np.random.default_rng(2)
    axis = rng.normal(size=(30, 3))
    axis /= np.linalg.norm(axis, axis=1)[:, None]
    q = xyz[:30]
    qdf = frame(spark, q, nx=axis[:, 0], ny=axis[:, 1], nz=axis[:, 2]).withColumnRenamed("point_id", "query_id")
    shape = Sphere(0.4) if kind == "sphere" else Cylinder(0.2, 0.9)
    got = range_moments(qdf, frame(spark, xyz), shape, least="point_id", leaf=leaf).toPandas().set_index("query_id")
    for i in range(30):
        d = xyz - q[i]
        if kind == "sphere":
            hit = (d**2).sum(1) <= 0.4**2
        else:
            t = d @ axis[i]
            hit = (abs(t) <= 0.9) & ((d**2).sum(1) - t * t <= 0.2**2)
        m = d[hit]
        want = [len(m), *m.sum(0), *[(m[:, a] * m[:, b]).sum() for a, b in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]]
        assert np.allclose(got.loc[i, MOMENTS].to_numpy(float), want, atol=1e-9)
        assert got.loc[i, "least"] == np.flatnonzero(hit).min()


def test_radius_pairs_and_counts(spark):
    xyz = cloud(9, 150)
    df = frame(spark, xyz)
    near = np.linalg.norm(xyz[:, None] - xyz[None], axis=2) <= 0.3
    got = {(r.a, r.b) for r in radius_pairs(df, 0.3).collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
    counts = radius_counts(df, 0.3, leaf=5).toPandas().set_index("point_id")["n"].sort_index()
    assert (counts.to_numpy() == near.sum(1)).all()


def test_components_on_a_path(spark):
    rng = np.random.default_rng(0)
    ids = rng.permutation(300)
    nodes = spark.createDataFrame([(int(i),) for i in ids], "node long")
    edges = spark.createDataFrame(
        [(int(a), int(b)) for k, (a, b) in enumerate(zip(ids, ids[1:])) if k != 149], "src long, dst long"
    )
    got = components(nodes, edges).toPandas().set_index("node")["root"]
    for part in (ids[:150], ids[150:]):
        assert (got.loc[part] == part.min()).all()


def brute_roots(count, edges):
    root = list(range(count))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(count)]


def test_components_in_order_hubs_and_groups(spark):
    rng = np.random.default_rng(3)
    path = [(k, k + 1) for k in range(199)]
    hub = [(499, k) for k in range(200, 480)] + [(k, k) for k in range(480, 499)]
    loose = [tuple(map(int, rng.integers(500, 800, 2))) for _ in range(200)]
    edges = path + hub + loose
    both = [(g, a, b) for g in ("a", "b") for a, b in edges if g == "a" or a < 500]
    nodes = spark.createDataFrame([(g, k) for g in ("a", "b") for k in range(800)], "g string, node long")
    got = {(r.g, r.node): r.root for r in components(nodes, spark.createDataFrame(both, "g string, src long, dst long"), ["g"]).collect()}
    assert len(got) == 1600
    for g in ("a", "b"):
        want = brute_roots(800, [(a, b) for own, a, b in both if own == g])
        assert [got[g, k] for k in range(800)] == want
    none = components(nodes, spark.createDataFrame([], "g string, src long, dst long"), ["g"])
    assert none.where("root <> node").isEmpty() and none.count() == 1600
