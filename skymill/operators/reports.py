"""Mission-level reports and the catalog built from result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymill.functions.taxonomy import display_name
from skymill.operators.confidence import class_breakdown, confidence_tier, share
from skymill.operators.raster import elevation_stats, surface_and_terrain, volumetrics

MISSION = ["mission_id"]

def registration_summary(points: DataFrame, images: DataFrame) -> DataFrame:
    """Registration rate, mean reprojection error, high-confidence share. ``images``: n_input, n_registered."""
    stats = points.groupBy(*MISSION).agg(
        F.count(F.lit(1)).alias("sparse_points"), F.avg("reproj_err").alias("mean_reprojection_error_px"), share(confidence_tier() == 2).alias("high_confidence_points_pct")
    )
    rate = F.try_divide(F.col("n_registered") * 100.0, F.col("n_input"))
    return images.select(*MISSION, "n_input", "n_registered", rate.alias("registration_rate_pct")).join(stats, MISSION, "left")


def mission_report(points: DataFrame, cell: float = 1.0) -> DataFrame:
    """Per mission and class, how many points and how trustworthy, beside the mission's volumes and grid facts.

    Volumes and grid statistics share one gridding of the cloud: the cell table is small next to the points.
    """
    surfaces = surface_and_terrain(points, cell)
    return class_breakdown(points).join(volumetrics(surfaces, cell), MISSION).join(elevation_stats(surfaces), MISSION)


def nested_report(report: DataFrame) -> DataFrame:
    """The report as one nested row per mission (at most one entry per class)."""
    per_class = F.struct("class_name", "n_points", "pct_high", "pct_medium", "pct_low", "mean_track_len", "mean_reprojection_error_px")
    volume = F.struct("total_above_ground_volume_m3", "elevated_surface_area_m2", "mean_elevated_height_m", "max_height_m")
    return report.groupBy(*MISSION).agg(
        F.sum("n_points").alias("sparse_points"), F.array_sort(F.collect_list(per_class)).alias("class_breakdown"), F.first(volume).alias("volumetric_metrics")
    )


def quality_report(scale: DataFrame, geo: DataFrame, ate: DataFrame, coverage: DataFrame, registration: DataFrame) -> DataFrame:
    """R2: accuracy, coverage and registration of each mission on one row, with its fixed-format lines."""
    df = scale.join(geo, MISSION).join(ate, MISSION).join(coverage, MISSION).join(registration, MISSION)
    # --- fixed values: layout of the summary lines ---
    lines = F.array(
        F.format_string("Scale Error:                     %.2f%%", "scale_error_pct"),
        F.format_string("Scale Precision:                 %.2f%%", "scale_precision_pct"),
        F.format_string("Horizontal Geolocation (XY):     %.2f m", "horizontal_rmse_m"),
        F.format_string("Vertical Geolocation (Z):       %.2f m", "vertical_rmse_m"),
        F.format_string("Absolute Trajectory (ATE RMSE):  %.2f m", "ate_rmse_m"),
        F.format_string("Mean Reprojection Error:         %.3f px", "mean_reprojection_error_px"),
        F.format_string("Registered Keyframes:            %.1f%%", "registration_rate_pct"),
        F.format_string("High-Confidence Points:          %.1f%%", "high_confidence_points_pct"),
        F.format_string("  Observed Surface:              %.1f%%", "overall_coverage_pct"),
    )
    # --- end of fixed values ---
    return df.withColumn("summary_lines", lines)


def is_scratch(folder: Column, prefixes: Sequence[str]) -> Column:
    """Whether a folder's name starts with one of the prefixes, whatever its case."""
    test = F.lit(False)
    for p in prefixes:
        test = test | F.lower(folder).startswith(p.lower())
    return test


def mission_catalog(missions: DataFrame, reports: DataFrame, buildings: DataFrame, scratch_prefixes: Sequence[str] = ()) -> DataFrame:
    """Every mission with category, status, report fields and building count, own missions first, newest first.

    No mission is left out: ``is_scratch`` marks those whose folder starts with one of the caller's ``scratch_prefixes``.
    """
    df = missions.withColumn("is_scratch", is_scratch(F.col("folder"), scratch_prefixes))
    demo = F.coalesce("is_demo", F.lit(False)) | F.lower("folder").contains("demo")
    df = df.withColumns(
        {
            "is_demo": demo,
            "category": F.when(demo, "DEMO_MISSIONS").otherwise("MY_MISSIONS"),
            "name": F.coalesce("name", display_name(F.col("folder"))),
        }
    )
    df = df.join(reports.withColumn("_done", F.lit(True)), MISSION, "left").join(buildings, MISSION, "left")
    status = F.when(F.col("_done"), "COMPLETED").otherwise(F.coalesce("status", F.lit("IN_PROGRESS")))
    df = df.withColumns({"status": status, "building_count": F.coalesce("building_count", F.lit(0))}).drop("_done")
    return df.orderBy(F.col("category") != "MY_MISSIONS", F.col("modified_time").desc(), "mission_id")


def search_missions(catalog: DataFrame, text: str, page: int, page_size: int) -> DataFrame:
    """Q5: name filter and one page of the result."""
    hits = catalog.where(F.lower("name").contains(text.lower()))
    return hits.orderBy("name", "mission_id").offset(page * page_size).limit(page_size)


def mission_detail(catalog: DataFrame, mission_id: int, table: DataFrame) -> DataFrame:
    """Rows of one mission in a result table; an unknown mission gives none."""
    return table.join(catalog.where(F.col("mission_id") == mission_id).select(*MISSION), MISSION, "left_semi")


def deliverables(missions: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows that each result table holds per mission; every mission and table is listed."""
    listed = missions.select(*MISSION, F.explode(F.array(*[F.lit(t) for t in tables])).alias("deliverable"))
    counts = None
    for name, df in tables.items():
        c = df.groupBy(*MISSION).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("deliverable", F.lit(name))
        counts = c if counts is None else counts.unionByName(c)
    return listed.join(counts, [*MISSION, "deliverable"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def scene_summary(points: DataFrame, poses: DataFrame, instances: DataFrame) -> DataFrame:
    """Sizes and flags per mission."""
    n = points.groupBy(*MISSION).agg(F.count(F.lit(1)).alias("num_points"), (F.count("class_id") > 0).alias("has_semantics"))
    cams = poses.groupBy(*MISSION).agg(F.count(F.lit(1)).alias("num_cameras"))
    b = instances.groupBy(*MISSION).agg(F.count(F.lit(1)).alias("num_buildings"))
    out = n.join(cams, MISSION, "left").join(b, MISSION, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("num_cameras", "num_buildings")})


def readiness(inputs: DataFrame) -> DataFrame:
    """Score, verdict and warnings of an uploaded mission.

    ``inputs``: has_video, width, height, motion_blur_pct, gps_fixes, log_name.
    """
    video, gps = F.col("has_video"), F.col("gps_fixes") > 0
    is_4k = (F.col("width") >= 3840) | (F.col("height") >= 2160)
    is_hd = (F.col("width") >= 1920) | (F.col("height") >= 1080)
    imu = F.lower("log_name").contains("imu") | (F.col("gps_fixes") > 50)
    score = F.when(video, 45 + F.when(is_4k, 10).when(is_hd, 5).otherwise(0)).otherwise(0) + F.when(
        gps, 35 + F.when(imu, 10).otherwise(0)
    ).otherwise(0)
    warnings = F.array_compact(
        F.array(
            F.when(video & (F.col("motion_blur_pct") > 15), "motion_blur"), F.when(~video, "no_video"), F.when(~gps, "no_gps")
        )
    )
    pct = F.least(F.lit(100), score)
    return inputs.select(
        *MISSION, pct.alias("readiness_score"), F.coalesce(pct >= 40, F.lit(False)).alias("ready_to_reconstruct"), warnings.alias("warnings")
    )
