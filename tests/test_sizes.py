"""Tables that few rows expand into: dealt over tasks, and of a size that the planner knows."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skymill.plans.fixtures import load


def _suppliers(path, n):
    pq.write_table(pa.table({"s_suppkey": list(range(n)), "s_acctbal": [1.0] * n}), f"{path}/supplier.parquet")
    return str(path)


@pytest.mark.parametrize("name, per_image", [("depth_maps", 32 * 32), ("gray_pixels", 64 * 64), ("mask_pixels", 100 * 100)])
def test_pixels_of_few_images_are_dealt_out_and_never_broadcast(spark, tmp_path, name, per_image):
    px = load(spark, _suppliers(tmp_path, 40), name)
    assert px.count() == 40 * per_image
    assert px.select("image_id", "row", "col").distinct().count() == 40 * per_image
    assert px.select(F.spark_partition_id()).distinct().count() > 1
    # as planned beside a table of a known size, far above the limit for broadcasts
    other = spark.range(2_000_000).select(F.col("id").alias("image_id"))
    plan = px.join(other, "image_id")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
