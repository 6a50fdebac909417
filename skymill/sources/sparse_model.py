"""Sparse reconstruction in text form: cameras, points and images with their observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skymill.functions.camera import intrinsics, quaternion_rotation
from skymill.sources.lines import data_lines, numbered, ordered_lines


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Id, model, size and the parameter array, with intrinsics resolved."""
    p = F.col("parts")
    params = F.transform(F.slice(p, F.lit(5), F.size(p)), lambda v: v.cast("double"))
    df = data_lines(spark, path).select(
        p[0].cast("long").alias("camera_id"), p[1].alias("model"), p[2].cast("int").alias("width"), p[3].cast("int").alias("height"), params.alias("params")
    )
    return intrinsics(df)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Id, position, colour, error and track length."""
    p = F.col("parts")
    return data_lines(spark, path).select(
        p[0].cast("long").alias("point_id"),
        *[p[1 + i].cast("double").alias(c) for i, c in enumerate("xyz")],
        *[p[4 + i].cast("int").alias(c) for i, c in enumerate("rgb")],
        p[7].cast("double").alias("reproj_err"),
        F.floor((F.size(p) - 8) / 2).cast("double").alias("track_len"),
    )


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Poses and observations from strict pairs of lines; the second line of a pair may be empty.

    Only comment lines are dropped before counting, so an empty observation line keeps its place. Lines are numbered
    across file splits, so a model file may be larger than any task. Unmatched observations (-1) are dropped.
    """
    lines = numbered(ordered_lines(spark, path).where(~F.col("value").startswith("#")))
    pairs = lines.groupBy("_path", F.floor(F.col("line_no") / 2).alias("_pair")).agg(
        F.max(F.when(F.col("line_no") % 2 == 0, F.col("value"))).alias("_head"), F.max(F.when(F.col("line_no") % 2 == 1, F.col("value"))).alias("_tail")
    )
    pairs = pairs.where(F.trim("_head") != "").withColumn("_h", F.split(F.trim("_head"), r"\s+"))
    h = F.col("_h")
    pairs = pairs.withColumn("image_id", h[0].cast("long"))
    poses = pairs.select(
        "image_id", *[h[1 + i].cast("double").alias(q) for i, q in enumerate(("qw", "qx", "qy", "qz"))],
        *[h[5 + i].cast("double").alias(t) for i, t in enumerate(("tx", "ty", "tz"))], h[8].cast("long").alias("camera_id"), h[9].alias("name"),
    )
    tail = F.split(F.trim("_tail"), r"\s+")
    triples = pairs.where(F.trim("_tail") != "").select("image_id", tail.alias("_t"))
    obs = triples.select("image_id", "_t", F.explode(F.sequence(F.lit(0), F.floor(F.size("_t") / 3).cast("int") - 1)).alias("obs_idx"))

    def item(k: int):
        return F.get(F.col("_t"), F.col("obs_idx") * 3 + k)

    obs = obs.select("image_id", F.col("obs_idx").cast("long").alias("obs_idx"), item(0).cast("double").alias("u"), item(1).cast("double").alias("v"), item(2).cast("long").alias("point_id"))
    return quaternion_rotation(poses), obs.where(F.col("point_id") != -1)


def read_model(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All three files; poses carry their camera's intrinsics, observations only known points."""
    cameras = read_cameras(spark, f"{folder}/cameras.txt")
    points = read_points(spark, f"{folder}/points3D.txt")
    poses, obs = read_images(spark, f"{folder}/images.txt")
    return {
        "cameras": cameras,
        "points": points,
        "poses": poses.join(cameras.drop("model", "params"), "camera_id"),
        "observations": obs.join(points.select("point_id"), "point_id", "left_semi"),
    }
