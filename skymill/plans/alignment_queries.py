"""Registered queries on cameras, alignment and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from skymill.functions import camera as cam
from skymill.functions import geodesy
from skymill.operators import accuracy as ac
from skymill.operators import alignment as al
from skymill.operators import telemetry as tm
from skymill.plans.fixtures import check_sql, load
from skymill.plans.registry import query, rnd, rounded, settle
from skymill.plans.telemetry_queries import _FIX_ORIGIN, _ORIGINS, enu_sql, fix_positions

_Q = "select s_suppkey as mission_id, s_suppkey, 1.5::double as qw, (s_suppkey % 7) / 10e0 as qx, (s_suppkey % 5) / 10e0 as qy, (s_suppkey % 3) / 10e0 as qz from {supplier}"
_R = {
    "r00": "1-2*(y*y+z*z)", "r01": "2*(x*y-z*w)", "r02": "2*(x*z+y*w)",
    "r10": "2*(x*y+z*w)", "r11": "1-2*(x*x+z*z)", "r12": "2*(y*z-x*w)",
    "r20": "2*(x*z-y*w)", "r21": "2*(y*z+x*w)", "r22": "1-2*(x*x+y*y)",
}
_ROT = ("select mission_id, 1 + (mission_id % 5) / 1e1 as s, " + ", ".join(f"{v} as {k}" for k, v in _R.items())
        + ", mission_id * 3e0 as t0, mission_id * -2e0 as t1, 5e0 as t2 from (select mission_id, qw/k as w, qx/k as x, qy/k as y, qz/k as z "
          "from (select *, sqrt(qw*qw+qx*qx+qy*qy+qz*qz) as k from q))")


def transforms(spark, sf):
    """One similarity per supplier key, used as per-mission transform."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("mission_id"))
    m = F.col("mission_id")
    df = s.withColumns({"qw": F.lit(1.5), "qx": (m % 7) / 10.0, "qy": (m % 5) / 10.0, "qz": (m % 3) / 10.0})
    df = cam.quaternion_rotation(df)
    return df.withColumns({"s": 1.0 + (m % 5) / 10.0, "t0": m * 3.0, "t1": m * -2.0, "t2": F.lit(5.0)})


@query("C11_quaternion_rotation", check_sql("select mission_id, " + ", ".join(rnd(k, 9) + f" as {k}" for k in _R) + " from r", q=_Q, r=_ROT))
def _c11(spark, sf):
    return rounded(transforms(spark, sf).select("mission_id", *cam.R_NAMES), 9)


def _moved(spark, sf):
    p = load(spark, sf, "points").select("mission_id", "point_id", "x", "y", "z")
    df = p.join(transforms(spark, sf), "mission_id")
    out = cam.apply_similarity(F.col("s"), cam.rot(), cam.cols("t0", "t1", "t2"), cam.cols("x", "y", "z"))
    return df.withColumns({f"a{i}": out[i] for i in range(3)})


@query("C7_apply_similarity", check_sql(
    "select point_id, " + ", ".join(rnd(f"s * (r{i}0 * x + r{i}1 * y + r{i}2 * z) + t{i}", 5) + f" as a{i}" for i in range(3))
    + " from points join r using (mission_id)", "points", q=_Q, r=_ROT))
def _c7(spark, sf):
    return rounded(_moved(spark, sf).select("point_id", "a0", "a1", "a2"), 5)


@query("C8_inverse_similarity", check_sql(f"select point_id, {rnd('x', 5)} as x, {rnd('y', 5)} as y, {rnd('z', 5)} as z from points", "points"))
def _c8(spark, sf):
    moved = _moved(spark, sf).select("mission_id", "point_id", "a0", "a1", "a2")
    df = moved.join(cam.invert_similarity(transforms(spark, sf)), "mission_id")
    out = cam.apply_similarity(F.col("s"), cam.rot(), cam.cols("t0", "t1", "t2"), cam.cols("a0", "a1", "a2"))
    return rounded(df.select("point_id", *[out[i].alias(c) for i, c in enumerate("xyz")]), 5)


@query("C9_project_points", check_sql(
    f"""select o.image_id, o.obs_idx, {rnd('case when 60 - p.z > 1e-6 then 100 * (p.x + c.tx) / (60 - p.z) + 50 end', 5)} as pu,
         {rnd('case when 60 - p.z > 1e-6 then 100 * (c.ty - p.y) / (60 - p.z) + 50 end', 5)} as pv, {rnd('60 - p.z', 5)} as pz
       from observations o join track_points p using (point_id) join poses c on c.image_id = o.image_id""", "observations", "track_points", "poses"))
def _c9(spark, sf):
    df = load(spark, sf, "observations").join(load(spark, sf, "track_points"), "point_id").join(load(spark, sf, "poses"), "image_id")
    return rounded(cam.project(df, ("x", "y", "z"), 1e-6).select("image_id", "obs_idx", "pu", "pv", "pz"), 5)


@query("F8_in_front_filter", check_sql(
    "select o.image_id, count(*) as n from observations o join track_points p using (point_id) join poses c on c.image_id = o.image_id where 8 - p.z > 0.01 group by 1",
    "observations", "track_points", "poses"))
def _f8(spark, sf):
    df = load(spark, sf, "observations").join(load(spark, sf, "track_points"), "point_id")
    low = load(spark, sf, "poses").withColumn("tz", F.lit(8.0))
    return cam.project(df.join(low, "image_id"), ("x", "y", "z"), 0.01).where(F.col("pu").isNotNull()).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@query("C10_aligned_poses", check_sql(
    "select image_id, " + ", ".join(rnd(f"c{i}", 5) + f" as c{i}" for i in range(3)) + ", " + ", ".join(rnd(f"a{i}{j}", 7) + f" as r{i}{j}" for i in range(3) for j in range(3)) + ", "
    + ", ".join(rnd(f"-(a{i}0 * c0 + a{i}1 * c1 + a{i}2 * c2)", 5) + f" as t{'xyz'[i]}" for i in range(3))
    + " from (select p.image_id, " + ", ".join(f"r.s * (r.r{i}0 * -p.tx + r.r{i}1 * p.ty + r.r{i}2 * p.tz) + r.t{i} as c{i}" for i in range(3)) + ", "
    + ", ".join(f"{'' if i == 0 else '-'}r.r{j}{i} as a{i}{j}" for i in range(3) for j in range(3))
    + " from poses p join r on r.mission_id = p.session_id)", "poses", q=_Q, r=_ROT))
def _c10(spark, sf):
    tf = transforms(spark, sf).select(F.col("mission_id").alias("session_id"), *[F.col(c).alias(f"tf_{c}") for c in al.TRANSFORM])
    df = cam.aligned_pose(load(spark, sf, "poses").join(tf, "session_id"))
    return df.select("image_id", *[settle(c, d) for c, d in (
        *((f"c{i}", 5) for i in range(3)), *((n, 7) for n in cam.R_NAMES), ("tx", 5), ("ty", 5), ("tz", 5))])


_MODELS = ("SIMPLE_PINHOLE", "PINHOLE", "OPENCV", "SIMPLE_RADIAL", "OTHER")


@query("C12_intrinsics", check_sql(
    f"""select s_suppkey, model, fx, case when model in ('PINHOLE', 'OPENCV') then p2 else fx end as fy,
          case when model in ('PINHOLE', 'OPENCV') then p3 else p2 end as cx, case when model in ('PINHOLE', 'OPENCV') then p4 else p3 end as cy
        from (select s_suppkey, list_extract({list(_MODELS)}, cast(s_suppkey % 5 + 1 as int)) as model, s_suppkey + 100.5::double as fx, s_suppkey + 101.5::double as p2,
          s_suppkey + 50.5::double as p3, s_suppkey + 40.5::double as p4 from supplier)"""))
def _c12(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    k = F.col("s_suppkey")
    df = s.select(k, F.get(F.array(*[F.lit(m) for m in _MODELS]), (k % 5).cast("int")).alias("model"),
                  F.array(k + 100.5, k + 101.5, k + 50.5, k + 40.5).alias("params"))
    return cam.intrinsics(df).select("s_suppkey", "model", "fx", "fy", "cx", "cy")


@query("C14_unproject", check_sql(
    f"select d.image_id, d.row, d.col, {rnd('(d.col - 50) / 100.0::double * d.depth - p.tx', 5)} as x, {rnd('-((d.row - 50) / 100.0::double * d.depth - p.ty)', 5)} as y, {rnd('-(d.depth - p.tz)', 5)} as z "
    "from depth_maps d join poses p using (image_id)", "depth_maps", "poses"))
def _c14(spark, sf):
    df = load(spark, sf, "depth_maps").join(load(spark, sf, "poses"), "image_id")
    return rounded(cam.unproject(df, "col", "row", "depth").select("image_id", "row", "col", "x", "y", "z"), 5)


@query("C16_triangle_normals", check_sql(
    f"""select face_id, {rnd('(ax + bx + cx) / 3')} as cx, {rnd('(ay + by_ + cy) / 3')} as cy, {rnd('(az + bz + cz) / 3')} as cz, {rnd('nx / k')} as nx, {rnd('ny / k')} as ny, {rnd('nz / k')} as nz
        from (select *, case when nx = 0 and ny = 0 and nz = 0 then 1e-6 else sqrt(nx * nx + ny * ny + nz * nz) end as k from (
          select face_id, a.x as ax, a.y as ay, a.z as az, b.x as bx, b.y as by_, b.z as bz, c.x as cx, c.y as cy, c.z as cz,
            (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) as nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) as ny,
            (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) as nz
          from faces f join vertices a on a.vertex_id = f.v0 join vertices b on b.vertex_id = f.v1 join vertices c on c.vertex_id = f.v2))""", "faces", "vertices"))
def _c16(spark, sf):
    from skymill.operators.visibility import face_geometry

    df = face_geometry(load(spark, sf, "faces"), load(spark, sf, "vertices"))
    return rounded(df.select("face_id", F.col("fcx").alias("cx"), F.col("fcy").alias("cy"), F.col("fcz").alias("cz"), "nx", "ny", "nz"))


# --- alignment ----------------------------------------------------------------------------------


def pairs(spark, sf):
    return ac.as_alignment_pairs(load(spark, sf, "trajectory_pairs"))


@query("G1_alignment_moments", check_sql(
    "select session_id, count(*) as n_pairs, " + ", ".join(rnd(f"avg({c})", 6) + f" as ms{i}" for i, c in enumerate(("est_e", "est_n", "est_u"))) + ", "
    + ", ".join(rnd(f"avg({c})", 6) + f" as md{i}" for i, c in enumerate(("gt_e", "gt_n", "gt_u"))) + f", {rnd('var_pop(est_e) + var_pop(est_n) + var_pop(est_u)', 5)} as var_s, "
    + ", ".join(rnd(f"covar_pop(gt_{d}, est_{s})", 5) + f" as c{i}{j}" for i, d in enumerate("enu") for j, s in enumerate("enu")) + " from trajectory_pairs group by 1", "trajectory_pairs"))
def _g1m(spark, sf):
    m = al.alignment_moments(pairs(spark, sf))
    return m.select("session_id", "n_pairs", *[settle(c, 6 if c[:2] in ("ms", "md") else 5) for c in al.MOMENTS])


@query("G1_similarity")
def _g1(spark, sf):
    return rounded(al.umeyama(pairs(spark, sf)))


# a planted transform: quarter turn about the vertical, scale 2, shift (5, -3, 1); fits must find it again
_PLANTED = {"s": 2.0, "r00": 0.0, "r01": -1.0, "r02": 0.0, "r10": 1.0, "r11": 0.0, "r12": 0.0, "r20": 0.0, "r21": 0.0, "r22": 1.0, "t0": 5.0, "t1": -3.0, "t2": 1.0}
_PLANTED_SQL = ", ".join(f"{v}::double as {k}" for k, v in _PLANTED.items())


def _planted(spark, sf, outlier_every: int = 0):
    """Ground truth as source and its planted image as target; every n-th pair is thrown far off if asked for."""
    t = load(spark, sf, "trajectory_pairs")
    off = F.when(F.col("seq") % outlier_every == 1, 80.0 + F.col("seq") * 7.0).otherwise(0.0) if outlier_every else F.lit(0.0)
    return t.select(
        "session_id", "seq", F.col("gt_e").alias("sx"), F.col("gt_n").alias("sy"), F.col("gt_u").alias("sz"),
        (5.0 - 2.0 * F.col("gt_n") + off).alias("dx"), (2.0 * F.col("gt_e") - 3.0 - off).alias("dy"), (2.0 * F.col("gt_u") + 1.0 + off).alias("dz"))


@query("G1_planted_similarity", check_sql(f"select session_id, count(*) as n_pairs, {_PLANTED_SQL} from trajectory_pairs group by 1 having count(*) >= 4", "trajectory_pairs"))
def _g1p(spark, sf):
    return rounded(al.umeyama(_planted(spark, sf), min_pairs=4))


@query("G2_planted_residuals", check_sql(
    "select session_id, seq, 0::double as residual_m from trajectory_pairs join (select session_id from trajectory_pairs group by 1 having count(*) >= 4) using (session_id)", "trajectory_pairs"))
def _g2p(spark, sf):
    p = _planted(spark, sf)
    return rounded(al.with_residuals(p, al.umeyama(p, min_pairs=4)).select("session_id", "seq", "residual_m"), 5)


@query("A5_planted_ate_aligned", check_sql("select session_id, count(*) as n_poses, 0::double as ate_rmse_m, 0::double as ate_mean_m, 0::double as ate_max_m from trajectory_pairs group by 1", "trajectory_pairs"))
def _a5p(spark, sf):
    p = _planted(spark, sf).select("session_id", "seq", *[F.col(f"s{a}").alias(f"est_{b}") for a, b in zip("xyz", "enu")], *[F.col(f"d{a}").alias(f"gt_{b}") for a, b in zip("xyz", "enu")])
    return rounded(ac.absolute_trajectory_error(p), 5)


@query("G3_planted_outliers", check_sql(
    f"select session_id, count(*) - count(*) filter (seq % 5 = 1) as n_inliers, {_PLANTED_SQL} from trajectory_pairs group by 1 having count(*) >= 8", "trajectory_pairs"))
def _g3p(spark, sf):
    p = _planted(spark, sf, 5).withColumn("inlier_threshold_m", F.lit(1.5))
    sizes = p.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 8")
    fits = al.ransac_similarity(p.join(sizes.select("session_id"), "session_id"), ["seq"], trials=100, chunk=50.0)
    return rounded(fits.select("session_id", "n_inliers", *al.TRANSFORM), 5)


@query("G2_alignment_residuals")
def _g2(spark, sf):
    p = pairs(spark, sf)
    return rounded(al.with_residuals(p, al.umeyama(p)).select("session_id", "seq", "residual_m"))


_FIXED_TF = ("select session_id, seq, gt_e, gt_n, gt_u, sqrt(pow(1.01::double * est_e + 0.5 - gt_e, 2) + pow(1.01::double * est_n - 0.25 - gt_n, 2) + pow(1.01::double * est_u - gt_u, 2)) as res from trajectory_pairs")


@query("A22_residual_summary", check_sql(
    f"""select session_id, {rnd('m', 5)} as mean_residual_m, {rnd('md', 5)} as median_residual_m, {rnd('x', 5)} as max_residual_m, {rnd('sd', 5)} as std_residual_m, {rnd('ext', 5)} as extent_m,
         {rnd('case when ext > 0 then m / ext * 100 end', 5)} as relative_error_pct
       from (select session_id, avg(res) as m, quantile_cont(res, 0.5) as md, max(res) as x, stddev_pop(res) as sd,
         sqrt(pow(max(gt_e) - min(gt_e), 2) + pow(max(gt_n) - min(gt_n), 2) + pow(max(gt_u) - min(gt_u), 2)) as ext from f group by 1)""", "trajectory_pairs", f=_FIXED_TF))
def _a22(spark, sf):
    p = pairs(spark, sf)
    tf = {c: F.lit(1.0 if c in ("r00", "r11", "r22") else 0.0) for c in al.TRANSFORM} | {"s": F.lit(1.01), "t0": F.lit(0.5), "t1": F.lit(-0.25)}
    t = p.select("session_id").distinct().withColumns(tf)
    return rounded(al.residual_summary(al.with_residuals(p, t)), 5)


@query("J4_match_by_name", check_sql(
    """select p.session_id, p.image_id, c.n >= 3 as enough from poses p join {supplier} s on s.s_suppkey = p.image_id and s.s_acctbal >= 0
       join (select session_id, count(*) as n from poses join {supplier} s on s.s_suppkey = image_id and s.s_acctbal >= 0 group by 1) c on c.session_id = p.session_id""", "poses"))
def _j4(spark, sf):
    poses = load(spark, sf, "poses").withColumn("name", F.concat(F.lit("run/images/"), "name"))
    fixes = spark.read.parquet(f"{sf}/supplier.parquet").where(F.col("s_acctbal") >= 0).select(
        (F.col("s_suppkey") % 10).alias("session_id"), F.concat(F.lit("f"), F.col("s_suppkey"), F.lit(".jpg")).alias("frame_name"))
    return al.match_by_name(poses, fixes).select("session_id", "image_id", "enough")


@query("G3_robust_similarity")
def _g3(spark, sf):
    p = pairs(spark, sf).withColumn("inlier_threshold_m", F.lit(1.5))
    return rounded(al.ransac_similarity(p, ["seq"], trials=60, chunk=50.0))


_POLICY_MATCHES = "select session_id, count(*) as n_matches, session_id % 7 = 0 as is_rtk from frames group by 1"


@query("G5_georeference_policy", check_sql(
    """select m.session_id, m.n_matches, q.tier as quality_tier, case when loc then 'LOCAL_METRIC' when is_rtk then 'RTK' when q.tier = 'STRONG_GPS' then 'STRONG_GPS' else 'WEAK_GPS' end as mode,
         case when loc then null when is_rtk then 0.5::double when q.tier = 'STRONG_GPS' then greatest(2.5 * 2.0::double, 5) else greatest(3.5 * 2.0::double, 8) end as inlier_threshold_m,
         case when loc then 'LOCAL_METRIC' else 'ENU' end as coordinate_frame
       from (select m.*, m.n_matches < 3 or q.tier is null or q.tier in ('INSUFFICIENT_BASELINE', 'LOCAL_METRIC') as loc from m left join q using (session_id)) m left join q on q.session_id = m.session_id""",
    "frames", "gps_fixes", origins=_ORIGINS, fo=_FIX_ORIGIN, m=_POLICY_MATCHES,
    q="""select session_id, case when count(*) < 2 then 'LOCAL_METRIC' when max(d) / 2 >= 3 then 'STRONG_GPS' when max(d) / 2 >= 0.5 then 'WEAK_GPS' else 'INSUFFICIENT_BASELINE' end as tier
         from (select *, sqrt(pow(e - first_value(e) over w, 2) + pow(n - first_value(n) over w, 2)) as d from (""" + enu_sql("fo", "session_id, timestamp_s") + """)
         window w as (partition by session_id order by timestamp_s)) group by 1"""))
def _g5(spark, sf):
    quality = tm.sensor_quality(fix_positions(spark, sf), gps_noise_m=2.0)
    m = load(spark, sf, "frames").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_matches")).withColumn("is_rtk", F.col("session_id") % 7 == 0)
    return al.georeference_policy(quality, m)


_UNIT = {c: 1.0 if c in ("s", "r00", "r11", "r22") else 0.0 for c in _PLANTED}


@query("G5_adaptive_georeference", check_sql(
    "select session_id, case when session_id % 3 = 0 then 'LOCAL_METRIC' else 'STRONG_GPS' end as mode, case when session_id % 3 = 0 then 'LOCAL_METRIC' else 'ENU' end as coordinate_frame, "
    "case when session_id % 3 = 0 then count(*) else count(*) - count(*) filter (seq % 5 = 1) end as n_correspondences, "
    + ", ".join(f"case when session_id % 3 = 0 then {_UNIT[c]}::double else {v}::double end as {c}" for c, v in _PLANTED.items())
    + " from trajectory_pairs group by 1 having count(*) >= 8", "trajectory_pairs"))
def _g5e(spark, sf):
    p = _planted(spark, sf, 5)
    sizes = p.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_matches")).where("n_matches >= 8").withColumn("is_rtk", F.lit(False))
    tier = F.when(F.col("session_id") % 3 == 0, "INSUFFICIENT_BASELINE").otherwise("STRONG_GPS")
    policy = al.georeference_policy(sizes.select("session_id", tier.alias("quality_tier"), F.lit(0.2).alias("estimated_noise_m")), sizes)
    out = al.adaptive_georeference(p.join(sizes.select("session_id"), "session_id"), policy, ["seq"], trials=100)
    return rounded(out.select("session_id", "mode", "coordinate_frame", "n_correspondences", *al.TRANSFORM), 5)


@query("G6_refine_without_prior", check_sql(
    f"select image_id, {rnd('-tx + 1', 4)} as c0, {rnd('ty - 1', 4)} as c1, {rnd('tz + 0.5', 4)} as c2, true as converged from poses where image_id in (select image_id from observations)", "poses", "observations"))
def _g6w(spark, sf):
    return rounded(_refined(spark, sf, 0.0).where("n_observations > 0").select("image_id", "c0", "c1", "c2", "converged"), 4)


@query("G6_refine_centers")
def _g6(spark, sf):
    return rounded(_refined(spark, sf, 1.0), 4)


def _refined(spark, sf, gps_weight: float):
    """Cameras half a metre off their GPS fix, seen from where the pixels put them: the planted centre."""
    obs = load(spark, sf, "observations").join(load(spark, sf, "track_points"), "point_id")
    poses = load(spark, sf, "poses")
    c = cam.camera_center(cam.rot(), cam.cols("tx", "ty", "tz"))
    cams = poses.withColumns({**{f"c{i}": c[i] for i in range(3)}, **{f"g{i}": c[i] + 0.5 for i in range(3)}})
    # pixel positions consistent with a camera displaced by (1, -1, 0.5)
    true = poses.withColumns({"tx": F.col("tx") - 1.0, "ty": F.col("ty") - 1.0, "tz": F.col("tz") + 0.5})
    seen = cam.project(obs.join(true, "image_id"), ("x", "y", "z"), 1e-6)
    seen = seen.select("image_id", F.col("pu").alias("u"), F.col("pv").alias("v"), "x", "y", "z")
    return al.refine_centers(seen, cams, gps_weight=gps_weight)


# --- accuracy -----------------------------------------------------------------------------------

_H2 = "pow(est_e - gt_e, 2) + pow(est_n - gt_n, 2)"
_V2 = "pow(est_u - gt_u, 2)"
def _acc(d: int) -> str:
    return (f"{rnd(f'sqrt(avg({_H2}))', d)} as horizontal_rmse_m, {rnd(f'sqrt(avg({_V2}))', d)} as vertical_rmse_m, {rnd(f'sqrt(avg({_H2} + {_V2}))', d)} as position_3d_rmse_m, "
        f"{rnd(f'max(sqrt({_H2}))', d)} as max_horizontal_error_m, {rnd('max(abs(est_u - gt_u))', d)} as max_vertical_error_m")


_ACC, _ACC3 = _acc(6), _acc(3)


@query("A4_georeference_accuracy", check_sql(f"select session_id, count(*) as n_points, {_ACC} from trajectory_pairs group by 1", "trajectory_pairs"))
def _a4(spark, sf):
    return rounded(ac.georeference_accuracy(load(spark, sf, "trajectory_pairs")))


@query("A5_ate_unaligned", check_sql(
    f"select session_id, count(*) as n_poses, {rnd(f'case when count(*) >= 3 then sqrt(avg({_H2} + {_V2})) else 0 end')} as ate_rmse_m, "
    f"{rnd(f'case when count(*) >= 3 then avg(sqrt({_H2} + {_V2})) else 0 end')} as ate_mean_m, {rnd(f'case when count(*) >= 3 then max(sqrt({_H2} + {_V2})) else 0 end')} as ate_max_m from trajectory_pairs group by 1", "trajectory_pairs"))
def _a5u(spark, sf):
    return rounded(ac.absolute_trajectory_error(load(spark, sf, "trajectory_pairs"), align=False))


@query("A5_ate_aligned")
def _a5(spark, sf):
    return rounded(ac.absolute_trajectory_error(load(spark, sf, "trajectory_pairs")))


_LAG = " + ".join(f"pow((est_{a} - lag(est_{a}) over w) - (gt_{a} - lag(gt_{a}) over w), 2)" for a in "enu")


@query("W2_relative_pose_error", check_sql(f"select session_id, {rnd('coalesce(sqrt(avg(d)), 0)')} as rpe_rmse_m from (select session_id, {_LAG} as d from trajectory_pairs window w as (partition by session_id order by seq)) group by 1", "trajectory_pairs"))
def _w2(spark, sf):
    return rounded(ac.relative_pose_error(load(spark, sf, "trajectory_pairs")))


@query("A6_distance_check", check_sql(
    f"select session_id, {rnd('avg(abs(d - 1.5))')} as mean_abs_error_m, {rnd('max(abs(d - 1.5))')} as max_abs_error_m from (select session_id, sqrt({_H2} + {_V2}) as d from trajectory_pairs) group by 1", "trajectory_pairs"))
def _a6(spark, sf):
    t = load(spark, sf, "trajectory_pairs").withColumnsRenamed({"est_e": "ax", "est_n": "ay", "est_u": "az", "gt_e": "bx", "gt_n": "by", "gt_u": "bz"})
    return rounded(ac.distance_check(t.withColumn("distance_m", F.lit(1.5))))


@query("C19_scale_error", check_sql(
    f"select p_partkey, {rnd('case when p_size > 10 then abs(p_retailprice / 100 - p_size) / p_size * 100 end')} as scale_error_pct, {rnd('case when p_size > 10 then greatest(0, 100 - abs(p_retailprice / 100 - p_size) / p_size * 100) end')} as scale_precision_pct from part"))
def _c19(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    err = ac.scale_error_pct(F.col("p_retailprice") / 100, F.when(F.col("p_size") > 10, F.col("p_size")).otherwise(0))
    return rounded(p.select("p_partkey", err.alias("scale_error_pct"), ac.scale_precision_pct(err).alias("scale_precision_pct")))


@query("A21_scale_trials", check_sql(
    f"select l_linenumber as noise_level, l_returnflag as setup, {rnd('avg(l_discount * 100)', 5)} as mean_abs_scale_error_pct, {rnd('quantile_cont(l_discount * 100, 0.9)', 5)} as p90_scale_error_pct, count(*) as n_trials from lineitem group by 1, 2"))
def _a21(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    t = li.select(F.col("l_linenumber").alias("noise_level"), F.col("l_returnflag").alias("setup"), (F.col("l_discount") * 100).alias("error_pct"))
    return rounded(ac.scale_trials(t, ["noise_level", "setup"]), 5)


_CP = "select session_id, seq, timestamp_s, lat + (seq % 5) * 2e-6 as lat, lon - (seq % 3) * 2e-6 as lon, alt_m + 0.5 as alt_m, origin_lat, origin_lon, origin_alt from fo"
_CP_PAIRS = ("select a.session_id, concat('f', a.seq, '.jpg') as image_filename, a.e as est_e, a.n as est_n, a.u as est_u, b.e as gt_e, b.n as gt_n, b.u as gt_u from ("
             + enu_sql("fo", "session_id, seq") + ") a join (" + enu_sql("cp", "session_id, seq") + ") b using (session_id, seq)")


def _checkpoint_pairs(spark, sf):
    gps = load(spark, sf, "gps_fixes")
    name = F.concat(F.lit("f"), F.col("seq"), F.lit(".jpg")).alias("image_filename")
    est = fix_positions(spark, sf).select("session_id", name, F.col("e").alias("est_e"), F.col("n").alias("est_n"), F.col("u").alias("est_u"))
    s = F.col("seq")
    cp = gps.withColumns({"lat": F.col("lat") + (s % 5) * 2e-6, "lon": F.col("lon") - (s % 3) * 2e-6, "utm_z": F.col("alt_m") + 0.5, "epsg": F.lit(32632)})
    cp = geodesy.with_utm(cp, "lat", "lon").select("session_id", name, "utm_x", "utm_y", "utm_z", "epsg")
    return ac.checkpoint_pairs(est, cp, tm.first_fix_origin(gps))


@query("J8_checkpoint_pairs", check_sql("select session_id, image_filename, " + ", ".join(rnd(c, 3) + f" as {c}" for c in ("est_e", "est_n", "est_u", "gt_e", "gt_n", "gt_u")) + " from pr",
                                        "gps_fixes", origins=_ORIGINS, fo=_FIX_ORIGIN, cp=_CP, pr=_CP_PAIRS))
def _j8(spark, sf):
    return rounded(_checkpoint_pairs(spark, sf), 3)


@query("R3_checkpoint_report", check_sql(
    f"select session_id, count(*) as n_points, {_ACC3}, count(*) as n_checkpoints from pr group by 1", "gps_fixes", origins=_ORIGINS, fo=_FIX_ORIGIN, cp=_CP, pr=_CP_PAIRS))
def _r3(spark, sf):
    rep = ac.checkpoint_report(_checkpoint_pairs(spark, sf))
    return rounded(rep.withColumn("n_checkpoints", F.size("per_checkpoint").cast("long")).drop("per_checkpoint"), 3)


@query("R4_compare_configurations", check_sql(
    f"select config, count(*) as n_points, {_ACC} from (select 'raw' as config, * from trajectory_pairs union all select 'flat' as config, session_id, seq, gt_e, gt_n, gt_u, est_e, est_n, gt_u as est_u from trajectory_pairs) group by 1", "trajectory_pairs"))
def _r4(spark, sf):
    t = load(spark, sf, "trajectory_pairs")
    runs = t.withColumn("config", F.lit("raw")).unionByName(t.withColumns({"config": F.lit("flat"), "est_u": F.col("gt_u")}))
    return rounded(ac.compare_configurations(runs).drop("ate_rmse_m", "scale_error_pct"))


@query("R4_configuration_alignment")
def _r4b(spark, sf):
    t = load(spark, sf, "trajectory_pairs")
    runs = t.withColumn("config", F.lit("raw")).unionByName(t.withColumns({"config": F.lit("flat"), "est_u": F.col("gt_u")}))
    return rounded(ac.compare_configurations(runs))
