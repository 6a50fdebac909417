"""Which camera sees what: range, facing, view cone, occlusion, best view per face."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymill.functions.camera import R_NAMES, camera_center, cols, dot, matvec, norm3, rot
from skymill.operators.raster import with_footprint


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))


def _crossed(lines: DataFrame, a: tuple[str, str], b: tuple[Column, Column], size: float) -> DataFrame:
    """One row per square ground cell ``_gx, _gy`` that the segment from ``a`` to ``b`` touches: column by column of cells,
    only the rows between the heights at which the segment enters and leaves that column."""
    dx, dy = b[0] - F.col(a[0]), b[1] - F.col(a[1])
    lines = lines.withColumns({"_dx": dx, "_dy": dy, "_ex": b[0], "_ey": b[1]})
    lines = lines.withColumn("_gx", F.explode(_cells(F.least(a[0], "_ex") - 1e-9, F.greatest(a[0], "_ex") + 1e-9, size)))
    at = [F.col(a[1]) + (x - F.col(a[0])) * F.try_divide(F.col("_dy"), F.col("_dx")) for x in (F.col("_gx") * size, (F.col("_gx") + 1) * size)]
    low, high = F.least(a[1], "_ey"), F.greatest(a[1], "_ey")
    steep = F.abs("_dx") < 1e-9
    y0 = F.when(steep, low).otherwise(F.greatest(low, F.least(high, F.least(*at))))
    y1 = F.when(steep, high).otherwise(F.least(high, F.greatest(low, F.greatest(*at))))
    return lines.withColumn("_gy", F.explode(_cells(y0 - 1e-9, y1 + 1e-9, size))).drop("_dx", "_dy", "_ex", "_ey")


def slab_entry(origin: list[Column], direction: list[Column], box: list[tuple[Column, Column]]) -> Column:
    """Distance at which a ray enters an axis-aligned box, NULL on a miss.

    A ray parallel to a slab is either inside it for good or never.
    """
    enters, leaves, blocked = [], [], F.lit(False)
    inf = F.lit(float("inf"))
    for o, d, (lo, hi) in zip(origin, direction, box):
        flat = d == 0
        a, b = (lo - o) / F.when(~flat, d), (hi - o) / F.when(~flat, d)
        enters.append(F.when(flat, -inf).otherwise(F.least(a, b)))
        leaves.append(F.when(flat, inf).otherwise(F.greatest(a, b)))
        blocked = blocked | (flat & ((o < lo) | (o > hi)))
    t_in, t_out = F.greatest(*enters), F.least(*leaves)
    return F.when(~blocked & (t_out >= t_in) & (t_out > 1e-6), t_in)


def visible_points(
    points: DataFrame,
    cameras: DataFrame,
    boxes: DataFrame,
    half_fov_deg: float,
    max_range_m: float,
    box_cell_m: float = 25.0,
) -> DataFrame:
    """Every point with ``visible``: some camera of its mission within range, in front, inside the cone and unobstructed.

    ``points``: mission_id, point_id, x, y, z, nx, ny, nz. ``cameras``: mission_id, cam_id, cx, cy, cz, dx, dy, dz. ``boxes``:
    mission_id, box_id, x0..z1. Local frames of different missions overlap, so nothing meets across missions.
    Points meet cameras through cells as wide as the range, sight lines meet boxes through ground cells they cross;
    both are equi-joins with the exact test as residual. Cameras of the same place and direction see the same, so one stands for
    all of them.
    """
    size = max_range_m
    views = cameras.groupBy("mission_id", "cx", "cy", "cz", "dx", "dy", "dz").agg(F.min("cam_id").alias("cam_id"))
    cam = views.withColumns(
        {"_gx": F.explode(_cells(F.col("cx") - size, F.col("cx") + size, size))}
    ).withColumn("_gy", F.explode(_cells(F.col("cy") - size, F.col("cy") + size, size)))
    at = points.withColumns(
        {"_gx": F.floor(F.col("x") / size).cast("long"), "_gy": F.floor(F.col("y") / size).cast("long")}
    )
    seen = at.join(cam, ["mission_id", "_gx", "_gy"]).drop("_gx", "_gy")
    to = [F.col("cx") - F.col("x"), F.col("cy") - F.col("y"), F.col("cz") - F.col("z")]
    seen = seen.withColumn("_len", F.greatest(norm3(to), F.lit(1e-9)))
    seen = seen.withColumns({f"_u{i}": to[i] / F.col("_len") for i in range(3)})
    unit = cols("_u0", "_u1", "_u2")
    seen = seen.where(
        (norm3(to) <= max_range_m)
        & (dot(cols("nx", "ny", "nz"), unit) > 0.05)
        & (-dot(cols("dx", "dy", "dz"), unit) >= math.cos(math.radians(half_fov_deg)))
    )
    eps = 1e-3
    seen = seen.select(
        "mission_id",
        "point_id",
        "cam_id",
        *[(F.col(c) + F.col(f"n{c}") * eps).alias(f"_o{i}") for i, c in enumerate("xyz")],
        "_u0",
        "_u1",
        "_u2",
        (F.col("_len") - eps).alias("_seg"),
    )
    ends = [F.col(f"_o{i}") + F.col(f"_u{i}") * F.col("_seg") for i in range(2)]
    lines = _crossed(seen, ("_o0", "_o1"), (ends[0], ends[1]), box_cell_m)
    solid = boxes.withColumn("_gx", F.explode(_cells(F.col("x0"), F.col("x1"), box_cell_m))).withColumn(
        "_gy", F.explode(_cells(F.col("y0"), F.col("y1"), box_cell_m))
    )
    hit = slab_entry(cols("_o0", "_o1", "_o2"), cols("_u0", "_u1", "_u2"), [(F.col(f"{c}0"), F.col(f"{c}1")) for c in "xyz"])
    sight = ["mission_id", "point_id", "cam_id"]
    hidden = lines.join(solid, ["mission_id", "_gx", "_gy"]).where(hit < F.col("_seg") - 1e-2).select(*sight)
    clear = seen.select(*sight).join(hidden, sight, "left_anti")
    shown = clear.select("mission_id", "point_id").distinct().withColumn("_v", F.lit(True))
    return points.join(shown, ["mission_id", "point_id"], "left").withColumn("visible", F.coalesce("_v", F.lit(False))).drop("_v")


def coverage_by_label(visible: DataFrame, label: str = "label") -> DataFrame:
    """Visible share per label, and over all (label NULL)."""
    return visible.rollup(label).agg(
        (F.avg(F.when(F.col("visible"), 1.0).otherwise(0.0)) * 100.0).alias("coverage_pct"), F.count(F.lit(1)).alias("n_points")
    )


def face_geometry(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Corner coordinates, centroid ``fc*`` and unit normal ``n*`` of each triangle."""
    df = faces
    for i in range(3):
        named = vertices.select(F.col("vertex_id").alias(f"v{i}"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"])
        df = df.join(named, f"v{i}")
    e = {k: [F.col(f"{c}{k}") - F.col(f"{c}0") for c in "xyz"] for k in (1, 2)}
    a, b = e[1], e[2]
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    df = df.withColumns({f"_n{i}": cross[i] for i in range(3)})
    size = norm3(cols("_n0", "_n1", "_n2"))
    df = df.withColumn("_k", F.when(size == 0, F.lit(1e-6)).otherwise(size))
    return df.withColumns(
        {
            **{f"fc{c}": (F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")) / 3.0 for c in "xyz"},
            **{f"n{c}": F.col(f"_n{i}") / F.col("_k") for i, c in enumerate("xyz")},
        }
    ).drop("_n0", "_n1", "_n2", "_k")


def best_camera_per_face(
    faces: DataFrame, vertices: DataFrame, cameras: DataFrame, max_glancing_deg: float = 75.0, cell_m: float = 20.0
) -> DataFrame:
    """The camera with the best viewing score per face (lowest id on ties) and the texture coordinates of its corners.

    A camera can only serve faces inside its view pyramid, so each camera lists the ground cells its
    footprint covers between the session's lowest and highest vertex, and a face meets the cameras of its
    centroid's cell: an equi-join that leaves no candidate out. Of cameras that agree in everything but their id, only the
    lowest id can win, so the others take no part.
    """
    keep = ["session_id", *R_NAMES, "tx", "ty", "tz", "fx", "fy", "cx", "cy", "width", "height"]
    cameras = cameras.groupBy(*keep).agg(F.min("image_id").alias("image_id"))
    geo = face_geometry(faces, vertices)
    span = geo.groupBy("session_id").agg(
        *[F.min(F.least(*[F.col(f"{c}{i}") for i in range(3)])).alias(f"s_{c}0") for c in "xyz"],
        *[F.max(F.greatest(*[F.col(f"{c}{i}") for i in range(3)])).alias(f"s_{c}1") for c in "xyz"],
    )
    views = with_footprint(cameras.join(span, "session_id"), "s_z0", "s_z1", ("s_x0", "s_x1", "s_y0", "s_y1"))
    views = views.where((F.col("f_x0") <= F.col("f_x1")) & (F.col("f_y0") <= F.col("f_y1")))
    views = views.withColumn("_gx", F.explode(_cells(F.col("f_x0"), F.col("f_x1"), cell_m))).withColumn(
        "_gy", F.explode(_cells(F.col("f_y0"), F.col("f_y1"), cell_m))
    ).select(*keep, "image_id", "_gx", "_gy")
    at = geo.withColumns({"_gx": F.floor(F.col("fcx") / cell_m).cast("long"), "_gy": F.floor(F.col("fcy") / cell_m).cast("long")})
    # all cameras over a cell meet all its faces: a plain join, so that adaptive execution can split a busy cell
    cand = at.join(views, ["session_id", "_gx", "_gy"])
    c = camera_center(rot(), cols("tx", "ty", "tz"))
    cand = cand.withColumns({f"_v{i}": c[i] - F.col(f"fc{a}") for i, a in enumerate("xyz")})
    cand = cand.withColumn("_dist", norm3(cols("_v0", "_v1", "_v2")))
    cand = cand.withColumn("_dist", F.when(F.col("_dist") == 0, F.lit(1e-6)).otherwise(F.col("_dist")))
    cand = cand.withColumn("_cos", dot(cols("nx", "ny", "nz"), cols("_v0", "_v1", "_v2")) / F.col("_dist"))
    cand = cand.where(F.col("_cos") > math.cos(math.radians(max_glancing_deg)))
    for i in range(3):
        p = matvec(rot(), cols(f"x{i}", f"y{i}", f"z{i}"))
        cand = cand.withColumns({f"_q{k}": p[k] + F.col(f"t{a}") for k, a in enumerate("xyz")}).where(F.col("_q2") > 1e-3)
        cand = cand.withColumns(
            {
                f"pu{i}": F.col("fx") * F.col("_q0") / F.col("_q2") + F.col("cx"),
                f"pv{i}": F.col("fy") * F.col("_q1") / F.col("_q2") + F.col("cy"),
            }
        ).where(F.col(f"pu{i}").between(0.0, F.col("width")) & (F.col(f"pu{i}") < F.col("width")) & (F.col(f"pv{i}") >= 0) & (F.col(f"pv{i}") < F.col("height")))
    uv = [
        x
        for i in range(3)
        for x in ((F.col(f"pu{i}") / F.col("width")).alias(f"tu{i}"), (1.0 - F.col(f"pv{i}") / F.col("height")).alias(f"tv{i}"))
    ]
    # scores that agree to nine digits count as equal, so rounding in the last place cannot pick the camera
    score = F.round(F.col("_cos") / (1.0 + 0.05 * F.col("_dist")), 9)
    best = cand.groupBy("face_id").agg(
        F.max_by(F.struct("image_id", score.alias("score"), *uv), F.struct(score, -F.col("image_id"))).alias("_b")
    )
    return faces.select("session_id", "face_id").join(best, "face_id", "left").select(
        "session_id",
        "face_id",
        F.coalesce(F.col("_b.image_id"), F.lit(-1)).alias("image_id"),
        F.col("_b.score").alias("score"),
        *[F.coalesce(F.col(f"_b.t{a}{i}"), F.lit(0.0)).alias(f"t{a}{i}") for i in range(3) for a in "uv"],
    )


def dominant_camera(assigned: DataFrame) -> DataFrame:
    """The camera chosen by most faces of a session, lowest id on ties."""
    counts = assigned.where(F.col("image_id") >= 0).groupBy("session_id", "image_id").agg(F.count(F.lit(1)).alias("n_faces"))
    return counts.groupBy("session_id").agg(F.max(F.struct("n_faces", (-F.col("image_id")).alias("_neg"))).alias("_b")).select(
        "session_id", (-F.col("_b._neg")).alias("image_id"), F.col("_b.n_faces").alias("n_faces")
    )


def structure_evidence(instance_points: DataFrame, observations: DataFrame, poses: DataFrame) -> DataFrame:
    """Which frames observed which structure: frames, observations, best frame, mean angle off the camera axis."""
    seen = observations.join(instance_points.select("mission_id", "cluster_id", "point_id", "x", "y", "z"), "point_id").join(
        poses, "image_id"
    )
    p = matvec(rot(), cols("x", "y", "z"))
    seen = seen.withColumns({f"_q{k}": p[k] + F.col(f"t{a}") for k, a in enumerate("xyz")})
    angle = F.degrees(F.atan2(F.hypot("_q0", "_q1"), F.col("_q2")))
    per_frame = seen.groupBy("mission_id", "cluster_id", "image_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(angle).alias("_a")
    )
    return per_frame.groupBy("mission_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.sum("_n").alias("n_observations"),
        F.max_by("image_id", F.struct("_n", -F.col("image_id"))).alias("best_frame"),
        (F.sum("_a") / F.sum("_n")).alias("mean_view_angle_deg"),
    )
