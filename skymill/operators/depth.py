"""Depth maps: metric fit, agreement between views, blending and unprojection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skymill.functions.camera import R_NAMES, cols, matvec, rot, unproject
from skymill.operators.confidence import clip

IMAGE = ["image_id"]
PIXEL = ["image_id", "row", "col"]
CAMERA = [*R_NAMES, "tx", "ty", "tz", "fx", "fy", "cx", "cy", "width", "height"]


def fit_depth(pairs: DataFrame, min_pairs: int = 6) -> DataFrame:
    """Least squares ``metric = a * rel + b`` per image with its RMS residual; too few pairs, no row.

    The residual follows from the same centred moments as the slope, so one pass is enough.
    """
    m, r = F.col("metric"), F.col("rel")
    fit = pairs.groupBy(*IMAGE).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.regr_slope(m, r).alias("scale_a"),
        F.regr_intercept(m, r).alias("shift_b"),
        F.var_pop(m).alias("_vm"),
        F.var_pop(r).alias("_vr"),
        F.covar_pop(m, r).alias("_c"),
    )
    left = F.col("_vm") - F.try_divide(F.col("_c") * F.col("_c"), F.col("_vr"))
    return fit.where(F.col("n_pairs") >= min_pairs).select(
        *IMAGE, "n_pairs", "scale_a", "shift_b", F.sqrt(F.greatest(left, F.lit(0.0))).alias("fit_residual")
    )


def depth_pairs(observations: DataFrame, points: DataFrame, poses: DataFrame, relative: DataFrame, min_z: float = 0.1) -> DataFrame:
    """Inputs of G7: relative depth at each observation beside the camera-frame depth of its point."""
    seen = observations.join(points.select("point_id", "x", "y", "z"), "point_id").join(poses.select(*IMAGE, *R_NAMES, "tx", "ty", "tz"), "image_id")
    z = matvec(rot(), cols("x", "y", "z"))[2] + F.col("tz")
    seen = seen.withColumn("metric", z).where(F.col("metric") > min_z)
    at = seen.select(*IMAGE, "metric", F.rint("v").cast("long").alias("row"), F.rint("u").cast("long").alias("col"))
    return at.join(relative, PIXEL).select(*IMAGE, "rel", "metric")


def metric_depth(relative: DataFrame, fits: DataFrame, min_depth: float = 0.1) -> DataFrame:
    """D-1: ``a * rel + b`` per pixel, NULL at or below ``min_depth``."""
    d = F.col("scale_a") * F.col("rel") + F.col("shift_b")
    return relative.join(fits.select(*IMAGE, "scale_a", "shift_b", "fit_residual"), "image_id").select(
        *PIXEL, F.when(d > min_depth, d).alias("depth"), "fit_residual"
    )


def _quads(depths: DataFrame) -> DataFrame:
    """Each pixel with its right, lower and lower-right neighbours: the four corners of a bilinear sample.

    Built by sending every depth to the quads it belongs to; one shuffle by pixel, no self-joins.
    """
    spots = F.array(*[F.struct(F.lit(r).cast("long").alias("r"), F.lit(c).cast("long").alias("c"), F.lit(f"d{r}{c}").alias("k")) for r in (0, 1) for c in (0, 1)])
    sent = depths.select(*PIXEL, "depth", F.explode(spots).alias("_s")).select(
        "image_id", (F.col("row") - F.col("_s.r")).alias("row"), (F.col("col") - F.col("_s.c")).alias("col"), "_s.k", "depth"
    )
    return sent.groupBy(*PIXEL).agg(*[F.max(F.when(F.col("k") == k, F.col("depth"))).alias(k) for k in ("d00", "d01", "d10", "d11")])


def pair_consistency(depths: DataFrame, cameras: DataFrame, neighbours: DataFrame, max_rel_error: float = 0.05) -> DataFrame:
    """D-2: every pixel of image A seen from neighbour B: relative depth error (1.0 where B has no answer) and verdict.

    ``neighbours`` lists (image_id, other_id): a short list per image, as multi-view pipelines choose them.
    """
    own = cameras.select("image_id", *CAMERA)
    px = depths.join(own, "image_id")
    world = unproject(px, "col", "row", "depth", ("_x", "_y", "_z")).select(*PIXEL, "_x", "_y", "_z")
    other = own.withColumnRenamed("image_id", "other_id")
    moved = world.join(neighbours.join(other, "other_id"), "image_id")
    p = matvec(rot(), cols("_x", "_y", "_z"))
    moved = moved.withColumns({f"_p{i}": p[i] + F.col(t) for i, t in enumerate(("tx", "ty", "tz"))})
    ahead = F.col("_p2") > 1e-3
    moved = moved.withColumns(
        {
            "_u": F.when(ahead, F.col("fx") * F.col("_p0") / F.col("_p2") + F.col("cx")),
            "_v": F.when(ahead, F.col("fy") * F.col("_p1") / F.col("_p2") + F.col("cy")),
        }
    )
    inside = (F.col("_u") >= 0) & (F.col("_u") < F.col("width") - 1) & (F.col("_v") >= 0) & (F.col("_v") < F.col("height") - 1)
    moved = moved.select(
        *PIXEL,
        "other_id",
        "_p2",
        F.when(inside, F.floor("_v")).cast("long").alias("_r"),
        F.when(inside, F.floor("_u")).cast("long").alias("_c"),
        (F.col("_u") - F.floor("_u")).alias("_fu"),
        (F.col("_v") - F.floor("_v")).alias("_fv"),
    )
    quads = _quads(depths).select(F.col("image_id").alias("other_id"), F.col("row").alias("_r"), F.col("col").alias("_c"), "d00", "d01", "d10", "d11")
    met = moved.join(quads, ["other_id", "_r", "_c"], "left")
    fu, fv = F.col("_fu"), F.col("_fv")
    sample = (F.col("d00") * (1 - fu) + F.col("d01") * fu) * (1 - fv) + (F.col("d10") * (1 - fu) + F.col("d11") * fu) * fv
    met = met.withColumn("_s", sample)
    valid = F.coalesce(F.col("_s") > 1e-3, F.lit(False))
    err = F.when(valid, F.abs(F.col("_p2") - F.col("_s")) / F.col("_s")).otherwise(F.lit(1.0))
    return met.select(*PIXEL, "other_id", err.alias("rel_error"), (valid & (err <= max_rel_error)).alias("is_consistent"))


def view_confidence(pairwise: DataFrame, neighbours: DataFrame, min_views: int = 1, sigma: float = 0.03) -> DataFrame:
    """D-3: consensus of the neighbours and a weight in [0, 1] per pixel."""
    n = neighbours.groupBy("image_id").agg(F.count(F.lit(1)).alias("_k"))
    score = F.when(F.col("is_consistent"), F.exp(-(F.col("rel_error") * F.col("rel_error")) / (2.0 * sigma * sigma))).otherwise(0.0)
    agg = pairwise.groupBy(*PIXEL).agg(F.count_if("is_consistent").alias("n_consistent"), F.sum(score).alias("_s"))
    return agg.join(n, "image_id").select(
        *PIXEL, "n_consistent", (F.col("n_consistent") >= min_views).alias("is_consistent"), clip(F.col("_s") / F.col("_k"), 0.0, 1.0).alias("weight")
    )


def blend_depths(mvs: DataFrame, ai: DataFrame, min_weight: float = 0.3) -> DataFrame:
    """D-4: ``mvs``: depth ``mvs_depth``, ``mvs_conf``; ``ai``: ``ai_depth``, ``ai_weight``.

    Images without any stereo take the predicted depth where its weight exceeds ``min_weight``.
    """
    has = mvs.select("image_id").distinct().withColumn("_has", F.lit(True))
    both = mvs.join(ai, PIXEL, "full").join(has, "image_id", "left")
    wm = clip(F.coalesce("mvs_conf", F.lit(0.0)), 0.0, 1.0)
    both = both.withColumn("_wm", wm)
    wa = clip(F.coalesce("ai_weight", F.lit(0.0)) * (1.0 - F.col("_wm")), 0.0, 1.0)
    both = both.withColumn("_wa", wa)
    total = F.col("_wm") + F.col("_wa")
    mixed = (F.col("_wm") * F.coalesce("mvs_depth", F.lit(0.0)) + F.col("_wa") * F.coalesce("ai_depth", F.lit(0.0))) / total
    fused = F.when(F.col("_has"), F.when(total > 1e-4, mixed)).otherwise(F.when(F.col("ai_weight") > min_weight, F.col("ai_depth")))
    return both.select(*PIXEL, fused.alias("depth"))


def sample_rank() -> Column:
    """Arithmetic shuffle key of a pixel that any engine can compute."""
    return F.pmod(F.col("row") * 7919 + F.col("col") * 104729 + F.col("image_id") * 1299709, F.lit(1000003))


def sample_pixels(pixels: DataFrame, limit: int) -> DataFrame:
    """Q4: at most ``limit`` pixels per image in seeded order; a row-number filter, so each task trims before the shuffle."""
    w = Window.partitionBy(*IMAGE).orderBy(sample_rank(), "row", "col")
    return pixels.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def single_view_weight(residual: Column) -> Column:
    return clip(1.0 / (1.0 + residual), 0.3, 0.95)


def dense_points(
    depths: DataFrame, weights: DataFrame | None, dynamic: DataFrame | None, cameras: DataFrame
) -> DataFrame:
    """D-5: world points of all accepted pixels of every image, with confidence and source; thin out with ``sample_pixels``.

    ``weights`` comes from D-3; without it all valid pixels count, at a confidence taken from the depth fit.
    """
    px = depths.where(F.col("depth").isNotNull())
    if weights is not None:
        px = px.join(weights.where("is_consistent").select(*PIXEL, F.col("weight").alias("confidence")), PIXEL)
    else:
        px = px.withColumn("confidence", single_view_weight(F.col("fit_residual")))
    if dynamic is not None:
        px = px.join(dynamic.select(*PIXEL), PIXEL, "left_anti")
    kept = px.join(cameras.select("image_id", *CAMERA), "image_id")
    return unproject(kept, "col", "row", "depth").select(
        *PIXEL, "x", "y", "z", "confidence", F.when(F.col("confidence") >= 0.8, "AI+MVS").otherwise("AI").alias("source")
    )


def rejected_counts(depths: DataFrame, weights: DataFrame | None, dynamic: DataFrame | None) -> DataFrame:
    """Pixels of each image that D-5 did not accept."""
    ok = depths.select(*PIXEL, F.col("depth").isNotNull().alias("_ok"))
    if weights is not None:
        ok = ok.drop("_ok").join(weights.select(*PIXEL, F.col("is_consistent").alias("_ok")), PIXEL, "left")
    if dynamic is not None:
        ok = ok.join(dynamic.select(*PIXEL, F.lit(True).alias("_dyn")), PIXEL, "left").withColumn("_ok", F.col("_ok") & F.col("_dyn").isNull())
    return ok.groupBy(*IMAGE).agg(F.count_if(~F.coalesce("_ok", F.lit(False))).alias("n_rejected"))


def fuse_sequence(relative: DataFrame, pairs: DataFrame, cameras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D-6/U2: dense points of all frames and the fit of each frame, in one job over all images."""
    fits = fit_depth(pairs, 8)
    depth = metric_depth(relative, fits, 0.0)
    px = depth.where(F.col("depth").isNotNull()).join(cameras.select("image_id", *CAMERA), "image_id")
    return unproject(px, "col", "row", "depth").select(*PIXEL, "x", "y", "z"), fits
