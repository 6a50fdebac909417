"""Accuracy of trajectories, positions, scale and distances against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymill.functions.geodesy import with_enu, with_wgs84_from_utm
from skymill.operators.alignment import umeyama, with_residuals
from skymill.operators.quantiles import exact_percentiles

SESSION = ["session_id"]


def _sq(a: str, b: str) -> Column:
    return (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))


def with_errors(pairs: DataFrame) -> DataFrame:
    """Adds horizontal, vertical and 3D error of ``est_*`` against ``gt_*``."""
    h2 = _sq("est_e", "gt_e") + _sq("est_n", "gt_n")
    return pairs.withColumns(
        {
            "horizontal_error_m": F.sqrt(h2),
            "vertical_error_m": F.abs(F.col("est_u") - F.col("gt_u")),
            "position_error_m": F.sqrt(h2 + _sq("est_u", "gt_u")),
        }
    )


def _rms(c: str) -> Column:
    return F.coalesce(F.sqrt(F.avg(F.col(c) * F.col(c))), F.lit(0.0))


def georeference_accuracy(pairs: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """A4."""
    return with_errors(pairs).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        _rms("horizontal_error_m").alias("horizontal_rmse_m"),
        _rms("vertical_error_m").alias("vertical_rmse_m"),
        _rms("position_error_m").alias("position_3d_rmse_m"),
        F.coalesce(F.max("horizontal_error_m"), F.lit(0.0)).alias("max_horizontal_error_m"),
        F.coalesce(F.max("vertical_error_m"), F.lit(0.0)).alias("max_vertical_error_m"),
    )


def as_alignment_pairs(pairs: DataFrame) -> DataFrame:
    names = {"est_e": "sx", "est_n": "sy", "est_u": "sz", "gt_e": "dx", "gt_n": "dy", "gt_u": "dz"}
    return pairs.withColumnsRenamed(names)


def absolute_trajectory_error(pairs: DataFrame, align: bool = True, keys: list[str] = SESSION) -> DataFrame:
    """A5: RMSE, mean and largest residual; fewer than three poses give zeros."""
    sizes = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_poses"))
    if align:
        p = as_alignment_pairs(pairs)
        scored = with_residuals(p, umeyama(p, keys), keys)
    else:
        scored = with_errors(pairs).withColumn("residual_m", F.col("position_error_m"))
    stats = scored.groupBy(*keys).agg(
        _rms("residual_m").alias("_r"), F.avg("residual_m").alias("_m"), F.max("residual_m").alias("_x")
    )
    enough = F.col("n_poses") >= 3

    def gated(c: str, name: str) -> Column:
        return F.when(enough, F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0)).alias(name)

    return sizes.join(stats, keys, "left").select(
        *keys, "n_poses", gated("_r", "ate_rmse_m"), gated("_m", "ate_mean_m"), gated("_x", "ate_max_m")
    )


def relative_pose_error(pairs: DataFrame, step: int = 1) -> DataFrame:
    """RMSE of displacement differences at lag ``step``; ``seq`` is dense, so the lag is an equi-join on
    ``(session, seq)`` that spreads one long session over every task."""
    names = [f"{w}_{a}" for w in ("est", "gt") for a in "enu"]
    before = pairs.select(*SESSION, (F.col("seq") + step).alias("seq"), *[F.col(n).alias(f"_b_{n}") for n in names])
    moved = pairs.join(before, [*SESSION, "seq"])
    d2 = F.lit(0.0)
    for a in "enu":
        d = (F.col(f"est_{a}") - F.col(f"_b_est_{a}")) - (F.col(f"gt_{a}") - F.col(f"_b_gt_{a}"))
        d2 = d2 + d * d
    rpe = moved.groupBy(*SESSION).agg(F.sqrt(F.avg(d2)).alias("rpe_rmse_m"))
    return pairs.select(*SESSION).distinct().join(rpe, SESSION, "left").select(
        *SESSION, F.coalesce("rpe_rmse_m", F.lit(0.0)).alias("rpe_rmse_m")
    )


def distance_check(pairs: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """Measured distances between point pairs ``a*``, ``b*`` against a known ``distance_m``."""
    got = F.sqrt(sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"), F.lit(0.0)))
    off = F.abs(got - F.col("distance_m"))
    return pairs.groupBy(*keys).agg(F.avg(off).alias("mean_abs_error_m"), F.max(off).alias("max_abs_error_m"))


def scale_error_pct(estimated: Column, true: Column) -> Column:
    """NULL where the true scale is not positive."""
    return F.when(true > 0, F.abs(estimated - true) / true * 100.0)


def scale_precision_pct(error_pct: Column) -> Column:
    return F.when(error_pct.isNotNull(), F.greatest(F.lit(0.0), 100.0 - error_pct))


def scale_trials(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and interpolated 90th percentile of absolute scale error per configuration."""
    means = trials.groupBy(*keys).agg(F.avg("error_pct").alias("mean_abs_scale_error_pct"), F.count(F.lit(1)).alias("n_trials"))
    return means.join(exact_percentiles(trials, keys, "error_pct", {"p90_scale_error_pct": 0.9}), keys)


def checkpoint_pairs(estimates: DataFrame, checkpoints: DataFrame, origins: DataFrame) -> DataFrame:
    """Estimated ENU positions beside surveyed UTM checkpoints taken into the same origin's ENU."""
    geo = with_wgs84_from_utm(checkpoints, "utm_x", "utm_y", "epsg", ("lat", "lon"))
    gt = with_enu(geo.join(origins, SESSION), alt="utm_z", out=("gt_e", "gt_n", "gt_u"))
    return estimates.select(*SESSION, "image_filename", "est_e", "est_n", "est_u").join(
        gt.select(*SESSION, "image_filename", "gt_e", "gt_n", "gt_u"), [*SESSION, "image_filename"]
    )


def checkpoint_report(pairs: DataFrame) -> DataFrame:
    """Accuracy per session plus one nested entry per checkpoint (surveys are sparse: a handful per session)."""
    nested = with_errors(pairs).groupBy(*SESSION).agg(
        F.array_sort(F.collect_list(F.struct("image_filename", "horizontal_error_m", "vertical_error_m"))).alias("per_checkpoint")
    )
    return georeference_accuracy(pairs).join(nested, SESSION)


def compare_configurations(runs: DataFrame) -> DataFrame:
    """Every configuration scored by the same measures over all its sessions; ``runs`` carries ``config``."""
    keys = ["config"]
    geo = georeference_accuracy(runs, keys)
    ate = absolute_trajectory_error(runs, True, keys).select("config", "ate_rmse_m")
    scale = umeyama(as_alignment_pairs(runs), keys).select(
        "config", scale_error_pct(F.lit(1.0) / F.col("s"), F.lit(1.0)).alias("scale_error_pct")
    )
    return geo.join(ate, keys).join(scale, keys, "left")
