"""Result tables in the shape their consumers read; every sink is a distributed write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymill.functions.geodesy import utm_epsg, with_wgs84_from_enu
from skymill.functions.taxonomy import asprs_code, class_name
from skymill.operators.confidence import confidence_tier, tier_name

MISSION = ["mission_id"]


def classified_points(points: DataFrame, scale: float = 0.001) -> DataFrame:
    """Point-record fields: integer coordinates from the mission's minimum, ASPRS class, 16-bit colour, intensity
    from track length."""
    ends = points.groupBy(*MISSION).agg(
        *[F.min(c).alias(f"_off_{c}") for c in "xyz"], F.min("track_len").alias("_lo"), F.max("track_len").alias("_hi")
    )
    df = points.join(ends, MISSION)
    share = (F.col("track_len") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return df.select(
        *MISSION,
        "point_id",
        *[F.rint((F.col(c) - F.col(f"_off_{c}")) / scale).cast("long").alias(f"i{c}") for c in "xyz"],
        *[F.shiftleft(c, 8).bitwiseOR(F.col(c)).alias(n) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))],
        asprs_code(F.col("class_id")).alias("classification"),
        F.when(F.col("_hi") > F.col("_lo"), F.floor(share * 65535).cast("int")).otherwise(32768).alias("intensity"),
    )


def write_classified_points(points: DataFrame, path: str, scale: float = 0.001) -> None:
    classified_points(points, scale).write.partitionBy(*MISSION, "classification").parquet(path)


def raster_header(bounds: DataFrame, origins: DataFrame, cell: float) -> DataFrame:
    """One row of georeference per raster: corner, cell size, grid shape, zone."""
    return bounds.join(origins, MISSION).select(
        *MISSION, "x_min", "y_max", F.lit(cell).alias("cell_size_m"), "n_rows", "n_cols", utm_epsg(F.col("origin_lon"), F.col("origin_lat")).alias("epsg")
    )


def write_raster(cells: DataFrame, header: DataFrame, path: str) -> None:
    cells.write.partitionBy(*MISSION).parquet(f"{path}/cells")
    header.write.parquet(f"{path}/header")


def viewer_points(points: DataFrame, origins: DataFrame) -> DataFrame:
    """Latitude, longitude, height, class and tier of every point of a georeferenced mission."""
    df = with_wgs84_from_enu(points.join(origins, MISSION), ("x", "y", "z"), out=("lat", "lon", "alt"))
    return df.select(*MISSION, "point_id", "lat", "lon", "alt", class_name(F.col("class_id")).alias("class"), tier_name(confidence_tier()).alias("confidence"))


def viewer_header(points: DataFrame, origins: DataFrame) -> DataFrame:
    return points.groupBy(*MISSION).agg(
        F.count(F.lit(1)).alias("n_points"), F.sort_array(F.collect_set(class_name(F.col("class_id")))).alias("classes")
    ).join(origins, MISSION)


def trajectory_points(centers: DataFrame, origins: DataFrame) -> DataFrame:
    """Latitude, longitude, height of every registered frame."""
    df = with_wgs84_from_enu(centers.join(origins, "session_id"), ("c0", "c1", "c2"), out=("lat", "lon", "alt"))
    return df.select("session_id", "image_id", F.col("name").alias("frame"), "lat", "lon", "alt")


def building_documents(instances: DataFrame) -> DataFrame:
    """One document per mission with its count and list of structures (a list a viewer loads whole)."""
    fields = [c for c in instances.columns if c not in MISSION and c != "instance_id"]
    return instances.groupBy(*MISSION).agg(
        F.count(F.lit(1)).alias("total_buildings"), F.array_sort(F.collect_list(F.struct("instance_id", *fields))).alias("buildings")
    )


def comparison_rows(metrics: DataFrame) -> DataFrame:
    """One formatted table line per configuration, beside the numbers."""
    line = F.format_string("| **%s** | %.2f m | %.2f m | %.2f m |", "config", "horizontal_rmse_m", "vertical_rmse_m", "position_3d_rmse_m")
    return metrics.withColumn("markdown", line)


def write_documents(df: DataFrame, path: str) -> None:
    """JSON lines, compressed: their field names repeat in every row."""
    df.write.json(path, compression="gzip")


def write_comparison(metrics: DataFrame, path: str) -> None:
    """The same metrics as JSON, CSV and table lines."""
    rows = comparison_rows(metrics)
    rows.drop("markdown").write.json(f"{path}/json")
    rows.drop("markdown").write.csv(f"{path}/csv", header=True)
    rows.select("markdown").write.text(f"{path}/markdown")
