"""Text lines with their place in the file, for formats whose line order carries meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["_path", "_block"]


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, _path, _block, _row``: a file of any size is read in splits, and ``(_block, _row)`` orders its lines."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def numbered(lines: DataFrame, out: str = "line_no", per_file: bool = True) -> DataFrame:
    """0-based line numbers per file, or over all files in order of their paths, counted over splits: no file has to fit
    one task; only one row per split is summed up."""
    local = lines.withColumn("_rn", F.row_number().over(Window.partitionBy(*SPLIT).orderBy("_row")))
    sizes = lines.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("_n"))
    files = Window.partitionBy("_path").orderBy("_block") if per_file else Window.orderBy("_path", "_block")
    before = files.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*SPLIT, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return local.join(offsets, SPLIT).withColumn(out, F.col("_off") + F.col("_rn") - 1).drop("_off", "_rn", "_row", "_block")


def data_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor ``#`` comments, trimmed and split on blanks as ``parts``."""
    text = F.trim(F.col("value"))
    lines = ordered_lines(spark, path).withColumn("value", text).where((text != "") & ~text.startswith("#"))
    return lines.withColumn("parts", F.split("value", r"\s+")).drop("value")
