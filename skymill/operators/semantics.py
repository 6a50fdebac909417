"""Class labels of points, frames and objects from mask pixels and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymill.functions.taxonomy import BACKGROUND_ID, CAR_PLACEHOLDER, CLASS_NAMES, DYNAMIC_CLASS_IDS
from skymill.operators.confidence import clip
from skymill.operators.pixels import pixel_runs
from skymill.runtime import shuffled

N_CLASSES = len(CLASS_NAMES)


def invert_tracks(observations: DataFrame, retained: DataFrame) -> DataFrame:
    """Observations of retained points; a long table needs no regrouping, only the semi-join."""
    return observations.join(retained.select("point_id"), "point_id", "left_semi")


def observed_classes(observations: DataFrame, mask_pixels: DataFrame) -> DataFrame:
    """Class under each observation; half-even pixel rounding, missing masks and outside pixels fall away.

    Masks have far more pixels than observations: they come as runs of a pixel row, and an observation takes its place in one.
    """
    at = observations.withColumns({"row": F.rint("v").cast("long"), "col": F.rint("u").cast("long")})
    met = at.join(shuffled(pixel_runs(mask_pixels, "class_id")), ["image_id", "row"])
    met = met.where((F.col("col") >= F.col("lo")) & (F.col("col") < F.col("lo") + F.size("run")))
    place = F.get("run", (F.col("col") - F.col("lo")).cast("int"))
    return met.select("image_id", "row", "col", *[c for c in observations.columns if c != "image_id"], place.alias("class_id"))


def tag_first_seen(points: DataFrame, labelled: DataFrame) -> DataFrame:
    """Class in the first observing image with a mask, Background where there is none."""
    first = labelled.groupBy("point_id").agg(F.min_by("class_id", F.struct("image_id", "obs_idx")).alias("class_id"))
    return points.select("mission_id", "point_id").join(first, "point_id", "left").select(
        "mission_id", "point_id", F.coalesce("class_id", F.lit(BACKGROUND_ID)).alias("class_id")
    )


def mask_shapes(mask_pixels: DataFrame) -> DataFrame:
    return mask_pixels.groupBy("image_id").agg(
        (F.max("col") + 1).cast("double").alias("mask_w"), (F.max("row") + 1).cast("double").alias("mask_h")
    )


def _vote_array(labelled: DataFrame, shapes: DataFrame) -> DataFrame:
    half_w, half_h = F.col("mask_w") / 2.0, F.col("mask_h") / 2.0
    off = F.hypot((F.col("col") - half_w) / half_w, (F.col("row") - half_h) / half_h) / F.sqrt(F.lit(2.0))
    weighted = labelled.where(F.col("class_id").between(0, N_CLASSES - 1)).join(shapes, "image_id")
    weighted = weighted.withColumn("_w", clip(1.0 - 0.3 * off, 0.5, 1.0))
    # one conditional sum per class: a single map-side-combined aggregation, no ranking window afterwards;
    # rounded so that the order of summation never decides a tie
    sums = [F.round(F.coalesce(F.sum(F.when(F.col("class_id") == c, F.col("_w"))), F.lit(0.0)), 9) for c in range(N_CLASSES)]
    return weighted.groupBy("point_id").agg(F.array(*sums).alias("votes"), F.count(F.lit(1)).alias("n_obs"))


def vote_points(points: DataFrame, labelled: DataFrame, shapes: DataFrame) -> DataFrame:
    """Centre-weighted vote; lowest class id wins ties; no usable observation means Background at confidence 0."""
    votes = _vote_array(labelled, shapes)
    total = F.aggregate("votes", F.lit(0.0), lambda a, x: a + x)
    votes = votes.withColumn("probabilities", F.transform("votes", lambda v: v / F.greatest(total, F.lit(1e-6))))
    ranked = F.sort_array("probabilities", asc=False)
    votes = votes.select(
        "point_id",
        "n_obs",
        "probabilities",
        (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int").alias("class_id"),
        clip(F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1)) + 0.1 * F.least("n_obs", F.lit(5)), 0.0, 1.0).alias("confidence"),
    )
    unseen = F.array(*[F.lit(1.0 if c == BACKGROUND_ID else 0.0) for c in range(N_CLASSES)])
    return points.select("mission_id", "point_id").join(votes, "point_id", "left").select(
        "mission_id",
        "point_id",
        F.coalesce("class_id", F.lit(BACKGROUND_ID)).alias("class_id"),
        F.coalesce("confidence", F.lit(0.0)).alias("semantic_confidence"),
        F.coalesce("n_obs", F.lit(0)).alias("n_obs"),
        F.coalesce("probabilities", unseen).alias("probabilities"),
    )


def top_two(labelled: DataFrame, shapes: DataFrame) -> DataFrame:
    """Q3: the two strongest classes of each point and the margin between them."""
    votes = _vote_array(labelled, shapes)
    pairs = F.transform("votes", lambda v, i: F.struct((-v).alias("neg"), i.alias("cls")))
    best = F.array_sort(pairs)
    a, b = F.get(best, F.lit(0)), F.get(best, F.lit(1))
    return votes.select(
        "point_id", a["cls"].alias("first_class"), b["cls"].alias("second_class"), (b["neg"] - a["neg"]).alias("margin")
    )


def label_points(voted: DataFrame, tagged: DataFrame) -> DataFrame:
    """A mission whose vote is Background throughout falls back to first-seen tags with NULL confidence."""
    useful = voted.groupBy("mission_id").agg(F.bool_or(F.col("class_id") != BACKGROUND_ID).alias("_useful"))
    return (
        voted.join(useful, "mission_id")
        .join(tagged.select("point_id", F.col("class_id").alias("_tag")), "point_id", "left")
        .select(
            "mission_id",
            "point_id",
            F.when(F.col("_useful"), F.col("class_id")).otherwise(F.coalesce("_tag", F.lit(BACKGROUND_ID))).alias("class_id"),
            F.when(F.col("_useful"), F.col("semantic_confidence")).alias("semantic_confidence"),
        )
    )


def class_fractions(mask_pixels: DataFrame) -> DataFrame:
    """Share of every class in every frame, zeros included."""
    counted = mask_pixels.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("class_id") == c).alias(f"_c{c}") for c in CLASS_NAMES]
    )
    rows = F.array(*[F.struct(F.lit(n).alias("class_name"), (F.col(f"_c{c}") / F.col("_n")).alias("fraction")) for c, n in CLASS_NAMES.items()])
    return counted.select("image_id", F.inline(rows))


def reconstruction_mask(mask_pixels: DataFrame) -> DataFrame:
    """0 on dynamic classes, 255 elsewhere."""
    return mask_pixels.select(
        "image_id", "row", "col", F.when(F.col("class_id").isin(*DYNAMIC_CLASS_IDS), 0).otherwise(255).alias("keep")
    )


def semantic_stability(mask_pixels: DataFrame) -> DataFrame:
    """One minus the dynamic share."""
    dynamic = F.col("class_id").isin(*DYNAMIC_CLASS_IDS)
    return mask_pixels.groupBy("image_id").agg(
        F.greatest(F.lit(0.0), 1.0 - F.count_if(dynamic) / F.count(F.lit(1))).alias("semantic_stability")
    )


def resolve_car_motion(components: DataFrame, shift_px: float = 8.0) -> DataFrame:
    """A car blob within ``shift_px`` of any blob of the previous frame is static, else moving.

    Blobs meet through grid cells of four times that size, so a frame full of cars does not meet the whole frame before it. An
    earlier blob enters the cells that its reach touches, 2.25 on average; a blob looks in its own and is moved only once.
    """
    side, reach = 4 * shift_px, shift_px * (1 + 1e-9)
    cell = lambda v: F.floor(v / side).cast("long")
    touched = lambda c: F.explode(F.sequence(cell(F.col(c) - reach), cell(F.col(c) + reach)))
    now = components.select("session_id", "frame_seq", "component_id", "cx", "cy", cell(F.col("cx")).alias("_gx"), cell(F.col("cy")).alias("_gy"))
    before = components.where("cx IS NOT NULL AND cy IS NOT NULL").select("session_id", (F.col("frame_seq") + 1).alias("frame_seq"), F.col("cx").alias("_px"), F.col("cy").alias("_py"))
    before = before.withColumn("_gx", touched("_px")).withColumn("_gy", touched("_py"))
    met = [F.col(f"b.{c}") == F.col(f"c.{c}").outer() for c in ("session_id", "frame_seq", "_gx", "_gy")]
    close = F.hypot(F.col("c.cx").outer() - F.col("_px"), F.col("c.cy").outer() - F.col("_py")) <= shift_px
    still = before.alias("b").where(met[0] & met[1] & met[2] & met[3] & close).exists()
    return now.alias("c").select("session_id", "frame_seq", "component_id", F.when(still, "Static car").otherwise("Moving car").alias("class_name"))


def resolved_class(class_id: Column, is_moving: Column) -> Column:
    """The car placeholder becomes a moving or static car; everything else stays."""
    return F.when(class_id == CAR_PLACEHOLDER, F.when(is_moving, 4).otherwise(5)).otherwise(class_id)


def object_motion(
    flow_pixels: DataFrame, min_area: int = 40, moving_px: float = 3.5, uncertain_px: float = 1.5
) -> DataFrame:
    """Per component: dominant class, median flow, motion status, box and centroid."""
    c = F.col("class_id")
    counts = [F.struct(F.count_if(c == k).alias("n"), F.lit(-k).alias("neg")) for k in (4, 5, 6)]
    obj = flow_pixels.groupBy("image_id", "component_id").agg(
        F.count(F.lit(1)).alias("area"),
        F.greatest(*counts).alias("_dom"),
        F.percentile("flow_px", 0.5).alias("_flow"),
        F.min("col").alias("box_x"),
        F.min("row").alias("box_y"),
        (F.max("col") - F.min("col") + 1).alias("box_w"),
        (F.max("row") - F.min("row") + 1).alias("box_h"),
        F.avg("col").alias("_cx"),
        F.avg("row").alias("_cy"),
    )
    flow, human = F.col("_flow"), F.col("_dom.neg") == -6
    status = (
        F.when(human, F.when(flow >= uncertain_px, "MOVING").otherwise("UNCERTAIN"))
        .when(flow >= moving_px, "MOVING")
        .when(flow >= uncertain_px, "UNCERTAIN")
        .otherwise("STATIC")
    )
    return obj.where(F.col("area") >= min_area).select(
        "image_id",
        "component_id",
        F.when(human, "Human").otherwise("Vehicle").alias("class_name"),
        status.alias("motion_status"),
        F.bround(flow, 2).alias("displacement_px"),
        "box_x",
        "box_y",
        "box_w",
        "box_h",
        F.bround("_cx", 1).alias("centroid_x"),
        F.bround("_cy", 1).alias("centroid_y"),
    )


def feature_quality(keypoints: DataFrame, width: float, height: float, grid: int = 4) -> DataFrame:
    """Half abundance (400 saturates), half share of grid cells holding at least five keypoints."""

    def cell(c: str, size: float) -> Column:
        return F.least(F.floor(F.col(c) / (size / grid)), F.lit(grid - 1))

    per_cell = keypoints.groupBy("image_id", cell("v", height).alias("_r"), cell("u", width).alias("_c")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    abundance = F.least(F.lit(1.0), F.sum("_n") / 400.0)
    spread = F.count_if(F.col("_n") >= 5) / float(grid * grid)
    return per_cell.groupBy("image_id").agg((0.5 * abundance + 0.5 * spread).alias("feature_quality"))


def match_overlap(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Overlap, parallax and median motion of a frame pair; fewer than eight matches give zeros."""
    agg = matches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_matches"),
        F.percentile("disp_px", 0.5).alias("_d"),
        F.max(F.greatest("n_prev", "n_curr")).alias("_k"),
    )
    enough = F.col("n_matches") >= 8

    def gated(c: Column) -> Column:
        return F.when(enough, c).otherwise(F.lit(0.0))

    return agg.select(
        *keys,
        "n_matches",
        gated(clip(1.5 * F.col("n_matches") / F.col("_k"), 0.0, 1.0)).alias("overlap"),
        gated(clip(F.col("_d") / 60.0, 0.0, 1.0)).alias("parallax"),
        gated(F.col("_d")).alias("motion_px"),
    )


