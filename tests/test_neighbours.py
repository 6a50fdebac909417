"""k nearest through box pyramids, and normals in closed form, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymill.operators import neighbours as nb
from skymill.operators import spatial as sp


def cloud(spark, missions):
    rows = [(m, i, *map(float, p)) for m, pts in missions.items() for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, "mission_id long, point_id long, x double, y double, z double")


def shapes():
    rng = np.random.default_rng(6)
    blob = rng.normal(0, 1, (700, 3))
    far = np.vstack([blob, [[1e6, 0, 0]], blob[:30] * 1e-6 + 50])
    return {1: far, 2: np.vstack([rng.uniform(0, 9, (300, 3)), np.tile([[1.0, 2.0, 3.0]], (90, 1))]), 3: np.zeros((5, 3)), 4: np.c_[rng.uniform(0, 50, (400, 2)), np.zeros(400)], 5: rng.integers(0, 5, (200, 3)).astype(float)}


@pytest.mark.parametrize("include_self", [True, False])
def test_neighbours_of_every_shape(spark, monkeypatch, include_self):
    monkeypatch.setattr(nb, "LEAF", 8)
    monkeypatch.setattr(nb, "GROUP", 60)
    missions, k = shapes(), 7
    got = sp.nearest(cloud(spark, missions), k, include_self).toPandas()
    means = {(r.mission_id, r.loc_id): r.mean_dist for r in sp.mean_neighbour_distance(cloud(spark, missions), k, include_self).collect()}
    for m, pts in missions.items():
        d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
        if not include_self:
            np.fill_diagonal(d, np.inf)
        want = np.sort(d, axis=1)[:, : min(k, len(pts) - (not include_self))]
        mine = got[got.mission_id == m]
        assert set(mine.loc_id) == {int(np.flatnonzero((pts == p).all(1))[0]) for p in pts}
        for i, g in mine.groupby("loc_id"):
            assert np.allclose(np.sort(np.repeat(g.dist, g["take"])), want[i], rtol=1e-9, atol=1e-12)
            assert np.isclose(means[m, i], want[i].mean(), rtol=1e-9, atol=1e-12)


def test_far_points_meet_few_candidates(spark, monkeypatch):
    """Shares beside a blob borrow the leaves facing them, not the blob."""
    monkeypatch.setattr(nb, "LEAF", 16)
    monkeypatch.setattr(nb, "GROUP", 128)
    rng = np.random.default_rng(8)
    pts = np.vstack([rng.normal(0, 1, (6000, 3)), [[500.0 + 40 * i, 0.3 * i, 0] for i in range(4)]])
    locs = sp._asking(cloud(spark, {1: pts}), 10, True, False)
    points = nb.planted(locs)
    assert points.groupBy("share").count().agg(F.max("count")).first()[0] <= 128
    nodes = nb.pyramid(points)
    assert nodes.where("leaf").agg(F.max("n")).first()[0] <= 16
    bounds = points.groupBy("mission_id", "share").applyInPandas(lambda p: nb._bounds(p, True), "mission_id long, node string, reach double")
    asking = nodes.where("leaf").join(bounds, ["mission_id", "node"]).withColumn("_k", F.lit(10))
    far = asking.where("hi_x > 400")
    halo = nb._descend(far, nodes, points).join(nodes.where("leaf"), ["mission_id", "node"])
    assert far.count() >= 1 and halo.agg(F.sum("n")).first()[0] <= 40 * 10


def test_normals_in_closed_form(spark):
    rng = np.random.default_rng(9)
    m = []
    for _ in range(300):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        e = np.sort(rng.uniform(0, 1, 3)) * 10.0 ** rng.uniform(-6, 6)
        if rng.random() < 0.3:
            e[0] = 0.0
        m.append(q @ np.diag(e) @ q.T)
    m += [np.diag([1.0, 2.0, 0.0]), np.diag([0.0, 3.0, 4.0]), np.zeros((3, 3)), np.eye(3), np.diag([1.0, 0.0, 0.0]), np.diag([0.0, 0.0, 1.0])]
    names = {"xx": (0, 0), "xy": (0, 1), "xz": (0, 2), "yy": (1, 1), "yz": (1, 2), "zz": (2, 2)}
    df = spark.createDataFrame([(i, *(float(a[p]) for p in names.values())) for i, a in enumerate(m)], "i int, " + ", ".join(f"{n} double" for n in names))
    got = {r.i: r.nz for r in sp.flat_normals(df).withColumnRenamed("abs_nz", "nz").collect()}
    for i, a in enumerate(m[:302]):
        assert abs(got[i] - abs(np.linalg.eigh(a)[1][2, 0])) < 1e-6, i
    assert [got[i] for i in range(302, 306)] == [1.0, 1.0, 1.0, 0.0]
