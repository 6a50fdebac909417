"""Written documents are read back whole and take little more space than their values."""

import os

from pyspark.sql import functions as F

from skymill.sources import sinks


def test_documents_are_compressed_and_whole(spark, tmp_path):
    points = spark.range(5000).select(
        (F.col("id") % 3).alias("mission_id"), F.col("id").alias("point_id"), F.rand(1).alias("x"), F.rand(2).alias("y"), F.rand(3).alias("z"),
        (F.col("id") % 8).cast("int").alias("class_id"), F.lit(5.0).alias("track_len"), F.lit(0.5).alias("reproj_err"))
    origins = spark.range(3).select(F.col("id").alias("mission_id"), F.lit(47.38).alias("origin_lat"), F.lit(8.54).alias("origin_lon"), F.lit(460.0).alias("origin_alt"))
    made, path = sinks.viewer_points(points, origins), str(tmp_path / "viewer")
    sinks.write_documents(made, path)
    back = spark.read.schema(made.schema).json(path)
    assert back.exceptAll(made).isEmpty() and back.count() == 5000
    assert sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-")) < 5000 * 80
