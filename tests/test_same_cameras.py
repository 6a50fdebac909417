"""Cameras that agree in everything but their id: one of them does the work, the lowest id gets the face."""

from pyspark.sql import functions as F

from skymill.functions.camera import R_NAMES
from skymill.operators import visibility as vs


def _counting(monkeypatch, name):
    seen, plain = [], getattr(vs, name)

    def counted(df, *rest):
        seen.append(df.count())
        return plain(df, *rest)

    monkeypatch.setattr(vs, name, counted)
    return seen


def test_best_camera_works_once_for_equal_cameras(spark, monkeypatch):
    seen = _counting(monkeypatch, "with_footprint")
    turn = dict(zip(R_NAMES, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0)))
    fixed = {**turn, "ty": 0.0, "tz": 60.0, "fx": 100.0, "fy": 100.0, "cx": 50.0, "cy": 50.0, "width": 100, "height": 100}
    cams = spark.range(7, 207).select(F.lit(1).alias("session_id"), F.col("id").alias("image_id"), (F.col("id") % 2 * -5.0).alias("tx"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "vertex_id long, x double, y double, z double")
    faces = spark.createDataFrame([(1, 5, 0, 1, 2)], "session_id int, face_id long, v0 long, v1 long, v2 long")
    best = vs.best_camera_per_face(faces, vertices, cams).first()
    assert seen == [2]
    assert best["image_id"] == 8  # the even ids stand at x = 0, the odd ones at 5


def test_visibility_works_once_for_equal_cameras(spark, monkeypatch):
    seen = _counting(monkeypatch, "_crossed")
    cams = spark.range(100).select(F.lit(1).alias("mission_id"), F.col("id").alias("cam_id"), *[F.lit(v).alias(k) for k, v in {"cx": 0.0, "cy": 0.0, "cz": 10.0, "dx": 0.0, "dy": 0.0, "dz": -1.0}.items()])
    points = spark.createDataFrame([(1, 1, 0.5, 0.5, 0.0), (1, 2, 2.5, 0.5, 0.0)], "mission_id int, point_id long, x double, y double, z double")
    points = points.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})
    boxes = spark.createDataFrame([(1, 1, 1.0, 0.0, 1.0, 2.0, 3.0, 8.0)], "mission_id int, box_id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    got = {r["point_id"]: r["visible"] for r in vs.visible_points(points, cams, boxes, 60.0, 30.0).collect()}
    assert seen == [2]
    assert got == {1: True, 2: False}
