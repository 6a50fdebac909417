import numpy as np
from pyspark.sql import functions as F

from skymill.operators import frames as fr
from skymill.operators import trajectory as tj
from skymill.sources import sparse_model as sm


def test_duplicates_are_greedy_in_order(spark):
    rng = np.random.default_rng(9)
    h = rng.integers(0, 2**10, 120)
    df = spark.createDataFrame([(1, i, int(x)) for i, x in enumerate(h)], "session_id long, frame_idx long, phash long")
    kept, want = [], {}
    for i, x in enumerate(h):
        want[i] = next((f for k, f in kept if bin(int(k) ^ int(x)).count("1") <= 2), None)
        if want[i] is None:
            kept.append((x, i))
    got = fr.drop_near_duplicates(df, 2, 10).collect()
    assert {r.frame_idx: r.duplicate_of for r in got} == want and all(r.kept == (want[r.frame_idx] is None) for r in got)


def greedy_duplicates(rows, threshold):
    """{(session, frame): frame it repeats, or None}, frame by frame."""
    want, kept = {}, {}
    for s, i, h in sorted(rows, key=lambda r: r[:2]):
        near = [f for k, f in kept.get(s, []) if h is not None and ((k ^ h) & (2**64 - 1)).bit_count() <= threshold]
        want[s, i] = near[0] if near else None
        if h is not None and not near:
            kept.setdefault(s, []).append((h, i))
    return want


def test_chains_of_close_frames_take_no_more_rounds_than_slices(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows, h = [], 0
    for i in range(200):  # each frame is close to the one before it and to no other, but for repeats
        rows.append((1, i, h - 2**64 if h >= 2**63 else h))
        for b in rng.choice(64, 5, replace=False):
            h ^= 1 << int(b)
    seeds = rng.integers(-(2**63), 2**63 - 1, 6)
    rows += [(2, i, int(seeds[i % 6]) ^ (1 << int(rng.integers(0, 40)))) for i in range(60)]
    rows += [(3, 0, 7), (3, 1, None), (3, 2, 7), (3, 3, None)]
    df = spark.createDataFrame(rows, "session_id long, frame_idx long, phash long").repartition(3)
    want = greedy_duplicates(rows, 5)
    walks, walk = [], fr._settled
    monkeypatch.setattr(fr, "_settled", lambda *a: walks.append(1) or walk(*a))
    for size, slices in ((33, 7), (2000, 1)):
        walks.clear()
        got = fr.drop_near_duplicates(df, 5, slice_frames=size).collect()
        assert {(r.session_id, r.frame_idx): r.duplicate_of for r in got} == want and len(got) == len(rows)
        assert all(r.kept == (r.duplicate_of is None) for r in got) and len(walks) <= slices
    assert fr.drop_near_duplicates(df.limit(0)).count() == 0


def test_hot_hash_blocks_lose_no_pair(spark):
    rng = np.random.default_rng(10)
    h = sorted({int(x) for x in rng.integers(0, 2**12, 150)})
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(h)], "session_id long, frame_idx long, phash long")
    want = {(i, j) for i in range(len(h)) for j in range(i + 1, len(h)) if bin(h[i] ^ h[j]).count("1") <= 3}
    for hot in (2, 5000):
        assert {(r.a, r.b) for r in fr.hash_pairs(df, 3, 12, hot=hot).collect()} == want


def test_keyframes_do_not_depend_on_slicing(spark):
    rng = np.random.default_rng(11)
    m = [(1, i, i * 0.5, float(rng.uniform(30, 400)), float(rng.uniform(0.3, 1)), 0.5, None if i % 7 else float(i), 0.0, 0.0) for i in range(60)]
    metrics = spark.createDataFrame(m, "session_id long, frame_idx long, timestamp_s double, sharpness double, exposure double, feature_quality double, e double, n double, u double")
    p = [(1, j, i, float(rng.uniform(0.5, 1)), 0.4, float(rng.uniform(0, 40))) for i in range(60) for j in range(max(0, i - 6), i)]
    pairs = spark.createDataFrame(p, "session_id long, prev_idx long, frame_idx long, overlap double, parallax double, motion_px double")
    runs = [[tuple(r) for r in fr.select_keyframes(metrics, pairs, n).orderBy("frame_idx").collect()] for n in (7, 1000)]
    assert runs[0] == runs[1] and any(r[6] for r in runs[0]) and any(r[7] == "redundant_overlap" for r in runs[0])


def test_trajectory_does_not_depend_on_slicing(spark):
    rng = np.random.default_rng(12)
    imu = spark.createDataFrame([(1, i, i * 0.1, *map(float, rng.normal(0, 0.3, 2)), 9.8, *map(float, rng.normal(0, 0.05, 3))) for i in range(80)],
                                "session_id long, seq long, timestamp_s double, ax double, ay double, az double, gx double, gy double, gz double")
    fr_rows = [(1, i, 0.35 + i * 0.5, float(i), float(-i), 2.0, 12.0 + 0.1 * i, 10.0) for i in range(14)] + [(2, 0, 1.0, None, None, None, None, None)]
    frames = spark.createDataFrame(fr_rows, "session_id long, frame_idx long, timestamp_s double, e double, n double, u double, altitude_m double, origin_alt double")
    a, b = (tj.estimate_trajectory(imu, frames, c).orderBy("session_id", "frame_idx").toPandas() for c in (0.7, 1000.0))
    assert np.allclose(a.to_numpy(float), b.to_numpy(float), atol=1e-9) and len(a) == 15
    still = a[a.session_id == 2].iloc[0]
    assert (still.e, still.ve, still.r00, still.var_e) == (0.0, 0.0, 1.0, 1.0)


def test_empty_second_line_keeps_pairs_aligned(spark, tmp_path):
    (tmp_path / "images.txt").write_text("# header\n1 1 0 0 0 1 2 3 1 a.jpg\n\n2 1 0 0 0 4 5 6 1 b.jpg\n1.5 2.5 7 3.5 4.5 -1\n")
    poses, obs = sm.read_images(spark, str(tmp_path / "images.txt"))
    assert {r.image_id: r.name for r in poses.collect()} == {1: "a.jpg", 2: "b.jpg"}
    assert [(r.image_id, r.u, r.v, r.point_id) for r in obs.collect()] == [(2, 1.5, 2.5, 7)]
    assert poses.where(F.col("image_id") == 2).first().tx == 4.0
