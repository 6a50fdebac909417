import os

import numpy as np

from pyspark.sql import functions as F

from skymill.operators import reports, visibility
from skymill.runtime import cut, release
from skymill.sources import logs


def test_header_that_looks_like_a_generated_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("imgid,_count,lat,\n1,7,47.5,\n2, 8 ,,\n,,,\n")
    df = logs.tolerant_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["imgid", "_count", "lat"]
    assert [tuple(r) for r in df.orderBy("imgid").collect()] == [("1", "7", "47.5"), ("2", "8", None)]


def test_catalog_leaves_no_mission_out(spark):
    missions = spark.createDataFrame(
        [(1, "benchmarks_2027", None, None, 5, None), (2, "video_run_3", "own", None, 6, "DRAFT"), (3, "demo_a", None, None, 7, None)],
        "mission_id long, folder string, name string, is_demo boolean, modified_time long, status string",
    )
    done = spark.createDataFrame([(2, 10)], "mission_id long, total_frames long")
    built = spark.createDataFrame([(1, 3)], "mission_id long, building_count long")
    rows = reports.mission_catalog(missions, done, built).collect()
    assert [r.mission_id for r in rows] == [2, 1, 3] and not any(r.is_scratch for r in rows)
    marked = reports.mission_catalog(missions, done, built, ("Benchmarks",)).collect()
    assert {r.mission_id: r.is_scratch for r in marked} == {1: True, 2: False, 3: False}


def test_missions_do_not_see_each_other(spark):
    points = spark.createDataFrame([(m, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for m in (1, 2, 3)], "mission_id long, point_id long, x double, y double, z double, nx double, ny double, nz double")
    cameras = spark.createDataFrame([(1, 9, 0.0, 0.0, 20.0, 0.0, 0.0, -1.0), (3, 9, 0.0, 0.0, 20.0, 0.0, 0.0, -1.0)], "mission_id long, cam_id long, cx double, cy double, cz double, dx double, dy double, dz double")
    boxes = spark.createDataFrame([(3, 1, -5.0, 5.0, -5.0, 5.0, 8.0, 9.0), (2, 1, -5.0, 5.0, -5.0, 5.0, 8.0, 9.0)], "mission_id long, box_id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    seen = visibility.visible_points(points, cameras, boxes, 40.0, 60.0).collect()
    assert {r.mission_id: r.visible for r in seen} == {1: True, 2: False, 3: False}


def test_crossed_cells_hold_the_whole_segment(spark):
    rng = np.random.default_rng(1)
    lines = [(i, *map(float, rng.uniform(-40, 40, 4))) for i in range(40)] + [(40, 1.0, -9.0, 1.0, 30.0), (41, -9.0, 2.0, 30.0, 2.0), (42, 3.0, 3.0, 3.0, 3.0)]
    df = spark.createDataFrame(lines, "id long, ax double, ay double, bx double, by double")
    got = {}
    for r in visibility._crossed(df, ("ax", "ay"), (F.col("bx"), F.col("by")), 10.0).collect():
        got.setdefault(r.id, set()).add((r._gx, r._gy))
    for i, ax, ay, bx, by in lines:
        t = np.linspace(0, 1, 5000)
        met = set(zip(np.floor((ax + t * (bx - ax)) / 10).astype(int).tolist(), np.floor((ay + t * (by - ay)) / 10).astype(int).tolist()))
        assert met <= got[i] and len(got[i]) <= len(met) + 8


def test_last_line_of_a_repeated_gyro_time_counts(spark, tmp_path):
    files = {
        "OnboardGPS": "Timpstemp, imgid, lat, lon, alt\n1000000,1,47.0,8.0,1\n2000000,2,47.1,8.1,2\n3000000,1,47.5,8.5,3\n",
        "RawAccel": "Timpstemp,x,y,z\n1500000,1,2,3\n1500000,4,5,6\n",
        "RawGyro": "Timpstemp,x,y,z\n1000000,0,0,0\n1500000,9,9,9\n1500000,1,1,1\n2000000,0,0,0\n",
        "BarometricPressure": "Timpstemp,Pressure,Altitude\n1,2,3\n",
        "GroundTruthAGL": "imgid,x_gt,y_gt,z_gt\n1,1,2,3\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    images = spark.createDataFrame([("00001.jpg",), ("00002.jpg",)], "image_filename string")
    rec = logs.multi_log_session(spark, str(tmp_path), images, "s")
    assert sorted((r.seq, r.lat) for r in rec["gps_fixes"].collect()) == [(1, 47.1), (2, 47.5)]
    assert sorted((r.seq, r.ax, r.gx) for r in rec["imu"].collect()) == [(0, 1.0, 1.0), (1, 4.0, 1.0)]
    (tmp_path / "imu.txt").write_text("# head\n3 1 1 1 1 1 1\n\n2 1 1 1 1 1 1\n")
    assert sorted((r.seq, r.timestamp_s) for r in logs.imu_list(spark, str(tmp_path / "imu.txt")).collect()) == [(0, 3.0), (1, 2.0)]


def test_release_deletes_written_steps(spark):
    df = cut(spark.range(5).toDF("x"))
    path = df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0].replace("///", "/")
    assert os.path.isdir(path) and release(spark) >= 1 and not os.path.exists(path)
