import numpy as np
import pytest
from pyspark.sql import functions as F

from skymill.operators import confidence as cf
from skymill.operators import raster as rs
from skymill.operators import spatial as sp
from skymill.operators.quantiles import exact_percentiles

POINT = "mission_id long, point_id long, x double, y double, z double"


def cloud(spark, xyz):
    return spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(xyz)], POINT)


def test_tiers(spark):
    df = spark.createDataFrame([(6.0, 0.5), (5.0, 1.5), (2.0, 0.1), (1.0, 5.0)], "track_len double, reproj_err double")
    assert [r[0] for r in df.select(cf.confidence_tier()).collect()] == [2, 1, 0, 0]


def test_volumetrics(spark):
    cells = [(1, 0, 0, 10.0, 5.0), (1, 0, 1, 5.2, 5.0), (1, 1, 0, 7.0, None)]
    df = spark.createDataFrame(cells, "mission_id long, row long, col long, dsm double, dtm double")
    r = rs.volumetrics(df, 2.0).first()
    assert (r.total_above_ground_volume_m3, r.elevated_surface_area_m2, r.mean_elevated_height_m, r.max_height_m) == (20.0, 4.0, 5.0, 5.0)


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.gamma(1.0, 3.0, 500), 2)
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(v)], "k long, v double")
    for r in exact_percentiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}).collect():
        want = np.percentile(v[int(r.k)::2], [5, 50, 95])
        assert np.allclose([r.a, r.b, r.c], want)


@pytest.mark.parametrize("shape", ["even", "blob", "copies"])
def test_radius_and_nearest_match_brute_force(spark, shape, monkeypatch):
    monkeypatch.setattr(sp, "CROWDED", 20)  # make the box path run on a small cloud
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 20, (120, 3))
    if shape == "blob":
        p = np.vstack([p, rng.normal(10, 0.3, (150, 3))])
    if shape == "copies":
        p = np.vstack([p, np.tile([[5.0, 5.0, 5.0]], (60, 1))])
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    df = cloud(spark, p)
    kept = {r.point_id for r in sp.remove_radius_outliers(df, 4, 2.5).collect()}
    assert kept == set(np.flatnonzero((d <= 2.5).sum(1) > 4))
    means = df.join(sp.mean_neighbour_distance(df, 6), ["mission_id", "x", "y", "z"]).select("point_id", "mean_dist").collect()
    want = np.sort(d, axis=1)[:, :6].mean(1)
    assert len(means) == len(p) and all(abs(r.mean_dist - want[r.point_id]) < 1e-9 for r in means)


def test_dbscan_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sp, "CROWDED", 20)
    rng = np.random.default_rng(3)
    p = np.vstack([rng.normal(0, 1.2, (70, 3)), rng.normal([14, 0, 0], 0.4, (90, 3)), rng.uniform(-10, 25, (60, 3))])
    d = np.linalg.norm(p[:, None] - p[None], axis=2) <= 2.0
    core = d.sum(1) >= 8
    label = np.full(len(p), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            label[i] = label.max() + 1
            stack = [i]
            while stack:
                for j in np.flatnonzero(d[stack.pop()] & core & (label < 0)):
                    label[j] = label[i]
                    stack.append(j)
    for i in np.flatnonzero(~core):
        near = label[d[i] & core]
        label[i] = near.min() if len(near) else -1
    got = {r.point_id: r.cluster_id for r in sp.dbscan(cloud(spark, p), 2.0, 8).collect()}
    assert [got[i] for i in range(len(p))] == list(label)


def test_crowded_cells_are_split_not_multiplied(spark):
    rng = np.random.default_rng(4)
    p = np.vstack([rng.uniform(0, 1, (150, 3)), rng.uniform(0, 1, (150, 3)) + [2.2, 0, 0]])
    locs = sp._with_grid(sp.locations(cloud(spark, p)), 1.0)
    cells = locs.groupBy("mission_id", *sp.G).agg(F.min("loc_id").alias("node"), F.count(F.lit(1)).alias("n"), *sp._boxes())
    cores = locs.join(cells.select("mission_id", *sp.G, "node"), ["mission_id", *sp.G])
    few = {tuple(r) for r in sp._touching_cells(cores, cells, 1.0, 2.0, pair_cap=50).collect()}
    many = {tuple(r) for r in sp._touching_cells(cores, cells, 1.0, 2.0, pair_cap=10**9).collect()}
    assert few == many and many


def test_footprints(spark):
    rows = [(1, 0, i, float(x), float(y), 0.0) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 3), (0, 3), (2, 1)])]
    rows += [(1, 1, 10 + i, float(i), 2.0, 0.0) for i in range(5)] + [(1, 2, 20, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "mission_id long, cluster_id long, point_id long, x double, y double, z double")
    for cap in (50_000, 3):
        got = {r.cluster_id: r.footprint_area_m2 for r in sp.footprint_area(df, cap).collect()}
        assert got == {0: 12.0, 1: 2.0, 2: 1.0}


def test_flat_ground_and_wall_normals(spark):
    flat = [(x, y, 0.0) for x in range(8) for y in range(8)]
    wall = [(30.0, y, z) for y in range(8) for z in range(8)]
    df = cloud(spark, flat + wall)
    nz = {r.point_id: r.abs_nz for r in df.join(sp.normals(df, 9), ["mission_id", "x", "y", "z"]).collect()}
    assert min(nz[i] for i in range(64)) > 0.99 and max(nz[i] for i in range(64, 128)) < 0.01


def test_percentiles_of_many_values_beside_outliers(spark):
    rng = np.random.default_rng(5)
    values = {1: np.append(rng.normal(size=30_000), [1e18, -1e12]), 2: np.full(25_000, 7.5), 3: np.repeat(rng.normal(size=5), 6_000), 4: np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "k int, v double")
    for r in exact_percentiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.953}).collect():
        assert np.allclose([r.a, r.b, r.c], np.percentile(values[r.k], [5, 50, 95.3]), rtol=1e-9, atol=1e-9), r.k


def test_footprint_of_a_round_cluster_is_split(spark):
    n = 500_000
    ring = spark.range(n).select(
        F.lit(1).cast("long").alias("mission_id"), F.lit(0).cast("long").alias("cluster_id"),
        (50 * F.cos(F.col("id") * 2 * np.pi / n)).alias("x"), (50 * F.sin(F.col("id") * 2 * np.pi / n)).alias("y"),
    )
    rng = np.random.default_rng(21)
    blob = rng.normal(0, 5, (3000, 2)).round(2)
    rows = [(1, 7, float(a), float(b)) for a, b in blob] + [(2, 0, float(i), 2.0) for i in range(5000)] + [(2, 1, 1.0, 1.0)] * 9
    df = ring.unionByName(spark.createDataFrame(rows, ring.schema))
    got = {(r.mission_id, r.cluster_id): r.footprint_area_m2 for r in sp.footprint_area(df, 1000).collect()}
    want = n / 2 * 50**2 * np.sin(2 * np.pi / n)
    corners = sp._hull(np.unique(blob, axis=0))
    assert abs(got[1, 0] - want) < 1e-6 and abs(got[1, 7] - sp._polygon_area(corners[:, 0], corners[:, 1])) < 1e-6
    assert got[2, 0] == 4999 * 0.5 and got[2, 1] == 1.0 and len(got) == 4
    assert sp.footprint_area(df.limit(0)).count() == 0
