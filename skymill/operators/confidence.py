"""Per-point confidence and the reports built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymill.functions.taxonomy import COVERAGE_CATEGORIES, class_name, coverage_category

MISSION = ["mission_id"]
TIER_SCORE = {0: 0.3, 1: 0.6, 2: 0.9}


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))


def confidence_tier(track: str = "track_len", err: str = "reproj_err") -> Column:
    """2 = high, 1 = medium, 0 = low."""
    t, e = F.col(track), F.col(err)
    return F.when((t >= 5) & (e <= 1.0), 2).when((t >= 3) & (e <= 2.0), 1).otherwise(0)


def tier_name(tier: Column) -> Column:
    return F.when(tier == 2, "high").when(tier == 1, "medium").otherwise("low")


def tier_score(tier: Column) -> Column:
    return F.when(tier == 2, F.lit(0.9)).when(tier == 1, F.lit(0.6)).otherwise(F.lit(0.3))


def share(flag: Column) -> Column:
    return F.avg(F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0))) * 100.0


def tier_summary(points: DataFrame) -> DataFrame:
    """A2: counts and percentages per tier and mission."""
    t = confidence_tier()
    return points.groupBy(*MISSION).agg(
        F.count(F.lit(1)).alias("n_points"),
        share(t == 2).alias("pct_high"),
        share(t == 1).alias("pct_medium"),
        share(t == 0).alias("pct_low"),
    )


def class_breakdown(points: DataFrame) -> DataFrame:
    """A3: the same per class, with mean track length and reprojection error."""
    t = confidence_tier()
    return points.groupBy(*MISSION, class_name(F.col("class_id")).alias("class_name")).agg(
        F.count(F.lit(1)).alias("n_points"),
        share(t == 2).alias("pct_high"),
        share(t == 1).alias("pct_medium"),
        share(t == 0).alias("pct_low"),
        F.avg("track_len").alias("mean_track_len"),
        F.avg("reproj_err").alias("mean_reprojection_error_px"),
    )


def score_uncertainty(
    points: DataFrame,
    weights: tuple[float, float, float, float, float] = (0.30, 0.25, 0.25, 0.20, 0.15),
    digits: int = 4,
) -> DataFrame:
    """P10: weighted factors renormalised over those measured on the row."""
    factors = {
        "reprojection_score": clip(1.0 - F.col("reproj_err") / 2.0, 0.0, 1.0),
        "track_length_score": clip((F.col("track_len") - 2.0) / 4.0, 0.0, 1.0),
        "depth_consistency_score": F.when(F.col("depth_c").isNotNull(), clip(F.col("depth_c"), 0.0, 1.0)),
        "sensor_agreement_score": F.when(
            F.col("sensor_res_m").isNotNull(), clip(1.0 - F.col("sensor_res_m") / 3.0, 0.0, 1.0)
        ),
        "semantic_confidence_score": F.when(F.col("semantic_c").isNotNull(), clip(F.col("semantic_c"), 0.0, 1.0)),
    }
    df = points.withColumns({f"_{k}": v for k, v in factors.items()})
    total, weight = F.lit(0.0), F.lit(0.0)
    for w, k in zip(weights, factors):
        present = F.col(f"_{k}").isNotNull()
        total = total + F.when(present, F.lit(w) * F.col(f"_{k}")).otherwise(F.lit(0.0))
        weight = weight + F.when(present, F.lit(w)).otherwise(F.lit(0.0))
    df = df.withColumn("_c", clip(total / F.greatest(weight, F.lit(1e-6)), 0.0, 1.0))
    c = F.col("_c")
    tier = F.when(c >= 0.70, "HIGH").when(c >= 0.40, "MEDIUM").when(c >= 0.10, "LOW").otherwise("UNOBSERVED")
    return df.withColumns(
        {"total_confidence": F.bround(c, digits), "tier": tier, **{k: F.bround(F.col(f"_{k}"), digits) for k in factors}}
    ).drop("_c", *[f"_{k}" for k in factors])


def categorical_coverage(points: DataFrame, facade_offset_m: float = 2.0) -> DataFrame:
    """A7, per category: elements, observed elements and their share; empty categories are listed too.

    The mean height per mission is one aggregated row per mission joined back, not a mission-wide window.
    """
    means = points.groupBy(*MISSION).agg(
        F.avg("z").alias("_mz"), F.count_if(F.col("confidence") > 0.10).alias("_observed")
    )
    name = class_name(F.col("class_id"))
    off = F.abs(F.col("z") - F.col("_mz")) > facade_offset_m
    category = F.when(name == "Building", F.when(off, "Facades").otherwise("Roofs")).otherwise(coverage_category(name))
    counted = (
        points.join(means, MISSION)
        .groupBy(*MISSION, category.alias("category"))
        .agg(F.count(F.lit(1)).alias("total_elements"), F.count_if(F.col("confidence") > 0.10).alias("observed_elements"))
    )
    grid = means.select(*MISSION, "_observed", F.explode(F.array(*[F.lit(c) for c in COVERAGE_CATEGORIES])).alias("category"))
    out = grid.join(counted, [*MISSION, "category"], "left")
    total = F.coalesce("total_elements", F.lit(0))
    seen = F.coalesce("observed_elements", F.lit(0))
    ratio = F.when(total > 0, seen / total * 100.0).when(F.col("_observed") > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    return out.select(
        *MISSION, "category", total.alias("total_elements"), seen.alias("observed_elements"), ratio.alias("coverage_ratio_pct")
    )


def coverage_summary(
    points: DataFrame, outside_fov: Column | None = None, occluded: Column | None = None, outside_share: float = 0.4
) -> DataFrame:
    """A7, per mission. Without masks the unobserved part is split by an assumed share, and flagged so."""
    none = F.lit(None).cast("boolean")
    agg = points.groupBy(*MISSION).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("confidence") > 0.10).alias("_obs"),
        F.count_if(F.col("confidence") >= 0.70).alias("_high"),
        F.count_if(F.coalesce(none if outside_fov is None else outside_fov, F.lit(False))).alias("_out"),
        F.count_if(F.coalesce(none if occluded is None else occluded, F.lit(False))).alias("_occ"),
    )
    n, obs = F.col("_n"), F.col("_obs")
    outside = F.col("_out") if outside_fov is not None else F.floor((n - obs) * F.lit(outside_share))
    hidden = F.col("_occ") if occluded is not None else F.greatest(F.lit(0), n - obs - outside)
    return agg.select(
        *MISSION,
        (obs / n * 100.0).alias("overall_coverage_pct"),
        (F.col("_high") / n * 100.0).alias("high_confidence_observed_pct"),
        ((obs - F.col("_high")) / n * 100.0).alias("low_confidence_observed_pct"),
        (hidden / n * 100.0).alias("unobserved_occluded_pct"),
        (outside / n * 100.0).alias("unobserved_outside_fov_pct"),
        F.lit(outside_fov is None or occluded is None).alias("is_assumed"),
    )


def scene_state(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.80, "OBSERVED_HIGH").when(confidence >= 0.50, "OBSERVED_UNCERTAIN").otherwise("OBSERVED_LOW")
    )


def scene_state_report(points: DataFrame, unobserved_ratio: float = 0.12) -> DataFrame:
    """State shares scaled to the observed part of the scene."""
    # compared in single precision, like the scores this report is defined on
    c = F.col("confidence").cast("float")
    high, mid = c >= F.lit(0.80).cast("float"), (c >= F.lit(0.50)) & (c < F.lit(0.80).cast("float"))
    left = 1.0 - unobserved_ratio
    return points.groupBy(*MISSION).agg(
        F.count(F.lit(1)).alias("total_elements"),
        F.bround(share(high) * left, 2).alias("observed_high_pct"),
        F.bround(share(mid) * left, 2).alias("observed_uncertain_pct"),
        F.bround(share(c < 0.50) * left, 2).alias("observed_low_pct"),
        F.lit(round(unobserved_ratio * 100, 2)).alias("unobserved_pct"),
    )


def semantic_quality(
    points: DataFrame,
    instances: DataFrame,
    low_threshold: float = 0.3,
    mean_warn: float = 0.4,
    max_footprint_m2: float = 2000.0,
) -> DataFrame:
    """Per mission, from per-point ``semantic_c`` and instance footprints."""
    conf = points.groupBy(*MISSION).agg(
        F.count("semantic_c").alias("n_points"),
        F.avg("semantic_c").alias("_mean"),
        share(F.col("semantic_c") < low_threshold).alias("_low_all"),
        (F.count_if(F.col("semantic_c") < low_threshold) / F.count("semantic_c") * 100.0).alias("_low"),
    )
    big = (
        instances.where(F.col("footprint_area_m2") > max_footprint_m2)
        .groupBy(*MISSION)
        .agg(F.array_sort(F.collect_list("instance_id")).alias("oversized_instance_ids"))
    )
    empty = F.array().cast("array<bigint>")
    df = conf.join(big, MISSION, "full").withColumn(
        "oversized_instance_ids", F.coalesce(F.col("oversized_instance_ids").cast("array<bigint>"), empty)
    )
    over, mean = F.size("oversized_instance_ids") > 0, F.col("_mean")
    tier = (
        F.when(over & (mean.isNull() | (mean >= mean_warn)), "REVIEW_RECOMMENDED")
        .when(mean < mean_warn, "LOW_CONFIDENCE")
        .when(mean.isNull(), "UNKNOWN")
        .otherwise("TRUSTED")
    )
    return df.select(
        *MISSION,
        F.coalesce("n_points", F.lit(0)).alias("n_points"),
        F.bround(mean, 4).alias("mean_semantic_confidence"),
        F.bround("_low", 2).alias("low_confidence_point_pct"),
        "oversized_instance_ids",
        F.size("oversized_instance_ids").alias("oversized_instance_count"),
        tier.alias("quality_tier"),
    )


def high_confidence_share(points: DataFrame) -> DataFrame:
    """Q8."""
    return points.groupBy(*MISSION).agg(share(confidence_tier() == 2).alias("high_confidence_pct"))


