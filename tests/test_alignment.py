import numpy as np
from pyspark.sql import functions as F

from skymill.operators import accuracy as ac
from skymill.operators import alignment as al

PAIR = "session_id long, seq long, sx double, sy double, sz double, dx double, dy double, dz double"


def planted(n=40, outliers=0, seed=5):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    r = q if np.linalg.det(q) > 0 else -q
    src = rng.normal(0, 10, (n, 3))
    dst = 2.5 * src @ r.T + np.array([100.0, -50.0, 7.0])
    dst[:outliers] += 500.0
    return src, dst, r


def rows(spark, src, dst):
    return spark.createDataFrame([(1, i, *map(float, s), *map(float, d)) for i, (s, d) in enumerate(zip(src, dst))], PAIR)


def test_similarity_is_recovered(spark):
    src, dst, r = planted()
    t = al.umeyama(rows(spark, src, dst)).first()
    assert abs(t.s - 2.5) < 1e-9 and np.allclose([[t[f"r{i}{j}"] for j in range(3)] for i in range(3)], r, atol=1e-9)
    assert np.allclose([t.t0, t.t1, t.t2], [100, -50, 7], atol=1e-7)


def test_outliers_are_rejected(spark):
    src, dst, _ = planted(40, 8)
    df = rows(spark, src, dst).withColumn("inlier_threshold_m", F.lit(3.0))
    t = al.ransac_similarity(df, ["seq"], trials=60, chunk=16.0).first()
    assert abs(t.s - 2.5) < 1e-6 and t.n_inliers == 32 and t.mean_residual_m < 1e-6


def test_triples_are_distinct_and_in_range(spark):
    sizes = spark.createDataFrame([(1, 4), (2, 9)], "session_id long, n_pairs long")
    got = al.sample_triples(sizes, 50, 42).groupBy("session_id", "trial").agg(F.collect_set("idx").alias("s"), F.max("idx").alias("m")).collect()
    assert len(got) == 100 and all(len(r.s) == 3 and r.m < (4 if r.session_id == 1 else 9) for r in got)


def test_errors_and_aligned_trajectory(spark):
    src, dst, _ = planted(12)
    names = ["session_id", "seq", "est_e", "est_n", "est_u", "gt_e", "gt_n", "gt_u"]
    df = rows(spark, src, dst).toDF(*names)
    assert ac.absolute_trajectory_error(df).first().ate_rmse_m < 1e-6
    off = df.select("session_id", "seq", *[F.col(c).alias(c) for c in names[5:]], (F.col("gt_e") + 1).alias("est_e"), F.col("gt_n").alias("est_n"), (F.col("gt_u") - 2).alias("est_u"))
    r = ac.georeference_accuracy(off).first()
    assert np.allclose([r.horizontal_rmse_m, r.vertical_rmse_m, r.position_3d_rmse_m], [1, 2, 5**0.5])


def test_refined_centre_returns_to_truth(spark):
    rng = np.random.default_rng(7)
    pts = np.column_stack([rng.uniform(-20, 20, 60), rng.uniform(-20, 20, 60), rng.uniform(0, 5, 60)])
    true = np.array([1.0, -2.0, 50.0])
    rot = np.diag([1.0, -1.0, -1.0])
    cam = (pts - true) @ rot.T
    uv = 100 * cam[:, :2] / cam[:, 2:] + 50
    obs = spark.createDataFrame([(1, *map(float, u), *map(float, p)) for u, p in zip(uv, pts)], "image_id long, u double, v double, x double, y double, z double")
    m = {f"r{i}{j}": float(rot[i, j]) for i in range(3) for j in range(3)}
    one = spark.range(1).select(F.lit(1).cast("long").alias("image_id"), *[F.lit(v).alias(k) for k, v in m.items()], F.lit(100.0).alias("fx"), F.lit(100.0).alias("fy"), F.lit(50.0).alias("cx"), F.lit(50.0).alias("cy"),
                                F.lit(3.0).alias("c0"), F.lit(0.0).alias("c1"), F.lit(47.0).alias("c2"), *[F.lit(None).cast("double").alias(f"g{i}") for i in range(3)])
    r = al.refine_centers(obs, one).first()
    assert r.converged and np.allclose([r.c0, r.c1, r.c2], true, atol=1e-6)
