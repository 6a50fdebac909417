"""Registered queries on sources, sinks, reports and the catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skymill.functions import geodesy
from skymill.functions import taxonomy as tx
from skymill.functions.camera import camera_center, cols, rot
from skymill.operators import accuracy as ac
from skymill.operators import confidence as cf
from skymill.operators import frames as fr
from skymill.operators import raster as rs
from skymill.operators import reports as rp
from skymill.operators import telemetry as tm
from skymill.plans.cloud_queries import _SURF, NAME, TIER, _TIERED, VOLUME_SQL, bounds_sql, cells_sql
from skymill.plans.fixtures import check_sql, load
from skymill.plans.registry import query, rnd, rounded, settle
from skymill.plans.telemetry_queries import _FIX_ORIGIN, _ORIGINS, enu_sql
from skymill.runtime import scratch_path
from skymill.sources import logs, sinks
from skymill.sources import sparse_model as sparse


def _supplier(spark, sf):
    return spark.read.parquet(f"{sf}/supplier.parquet")


# --- reports ------------------------------------------------------------------------------------

_VOL = VOLUME_SQL
_STAT = f"select mission_id, n_rows, n_cols, cast(sum(n_ground) as bigint) as n_ground_points, {rnd('100.0 * (n_rows * n_cols - count(dtm)) / (n_rows * n_cols)', 4)} as pct_dtm_cells_unknown from s group by 1, 2, 3"


def _pct4(cond: str) -> str:
    return rnd(f"100.0 * count(case when {cond} then 1 end) / count(*)", 4)


_BREAK = (f"select mission_id, class_name, count(*) as n_points, {_pct4('tier = 2')} as pct_high, {_pct4('tier = 1')} as pct_medium, {_pct4('tier = 0')} as pct_low, "
          f"{rnd('avg(track_len)', 4)} as mean_track_len, {rnd('avg(reproj_err)', 4)} as mean_reprojection_error_px from t group by 1, 2")
_RX = {"t": _TIERED, "b": bounds_sql(2.0), "c": cells_sql(2.0, True), "s": _SURF, "v": _VOL, "st": _STAT, "br": _BREAK}


@query("R1_mission_report", check_sql("select * from br join v using (mission_id) join st using (mission_id)", "points", **_RX))
def _r1(spark, sf):
    return rounded(rp.mission_report(load(spark, sf, "points"), 2.0), 4)


@query("R1_nested_report", check_sql("select mission_id, cast(sum(n_points) as bigint) as sparse_points, count(*) as n_classes, max(total_above_ground_volume_m3) as volume_m3 from br join v using (mission_id) group by 1", "points", **_RX))
def _r1n(spark, sf):
    doc = rp.nested_report(rp.mission_report(load(spark, sf, "points"), 2.0))
    df = doc.select("mission_id", "sparse_points", F.size("class_breakdown").cast("long").alias("n_classes"), F.col("volumetric_metrics.total_above_ground_volume_m3").alias("volume_m3"))
    return rounded(df, 4)


_IMAGES = "select s_suppkey % 10 as mission_id, count(*) as n_input, count(*) filter (s_acctbal >= 0) as n_registered from {supplier} group by 1"


def _images(spark, sf):
    return _supplier(spark, sf).groupBy((F.col("s_suppkey") % 10).alias("mission_id")).agg(F.count(F.lit(1)).alias("n_input"), F.count_if(F.col("s_acctbal") >= 0).alias("n_registered"))


@query("A19_registration_summary", check_sql(
    f"select i.mission_id, n_input, n_registered, {rnd('100.0 * n_registered / n_input')} as registration_rate_pct, count(*) as sparse_points, {rnd('avg(reproj_err)')} as mean_reprojection_error_px, "
    f"{rnd('100.0 * count(*) filter (tier = 2) / count(*)')} as high_confidence_points_pct from i join t using (mission_id) group by 1, 2, 3", "points", t=_TIERED, i=_IMAGES))
def _a19(spark, sf):
    return rounded(rp.registration_summary(load(spark, sf, "points"), _images(spark, sf)))


def _quality_parts(spark, sf):
    m = (F.col("session_id") % 10).alias("mission_id")
    t = load(spark, sf, "trajectory_pairs").select(m, *[f"{w}_{a}" for w in ("est", "gt") for a in "enu"])
    geo = ac.georeference_accuracy(t, ["mission_id"])
    ate = ac.absolute_trajectory_error(t, False, ["mission_id"]).select("mission_id", "ate_rmse_m")
    err = ac.scale_error_pct(F.avg("est_n"), F.avg("gt_n"))
    scale = t.groupBy("mission_id").agg(err.alias("scale_error_pct")).withColumn("scale_precision_pct", ac.scale_precision_pct(F.col("scale_error_pct")))
    return scale, geo, ate, cf.coverage_summary(load(spark, sf, "scored_points")), rp.registration_summary(load(spark, sf, "points"), _images(spark, sf))


@query("R2_quality_report", check_sql(
    f"""select mission_id, {rnd('abs(avg(est_n) - avg(gt_n)) / avg(gt_n) * 100', 5)} as scale_error_pct, {rnd('sqrt(avg(pow(est_e - gt_e, 2) + pow(est_n - gt_n, 2)))', 5)} as horizontal_rmse_m,
       {rnd('sqrt(avg(pow(est_e - gt_e, 2) + pow(est_n - gt_n, 2) + pow(est_u - gt_u, 2)))', 5)} as ate_rmse_m, max(oc) as overall_coverage_pct, 9::bigint as n_lines
       from (select session_id % 10 as mission_id, * from trajectory_pairs) join (select mission_id, {rnd('100.0 * count(*) filter (confidence > 0.1) / count(*)', 5)} as oc from scored_points group by 1) using (mission_id) group by 1""",
    "trajectory_pairs", "scored_points"))
def _r2(spark, sf):
    rep = rp.quality_report(*_quality_parts(spark, sf))
    return rounded(rep.select("mission_id", "scale_error_pct", "horizontal_rmse_m", "ate_rmse_m", "overall_coverage_pct", F.size("summary_lines").cast("long").alias("n_lines")), 5)


_LINES = """select q.mission_id, unnest(range(9)) as line_no, unnest([
    printf('Scale Error:                     %.2f%%', se), printf('Scale Precision:                 %.2f%%', greatest(0, 100 - se)), printf('Horizontal Geolocation (XY):     %.2f m', h),
    printf('Vertical Geolocation (Z):       %.2f m', v), printf('Absolute Trajectory (ATE RMSE):  %.2f m', ate), printf('Mean Reprojection Error:         %.3f px', re),
    printf('Registered Keyframes:            %.1f%%', 100e0 * n_registered / n_input), printf('High-Confidence Points:          %.1f%%', hc), printf('  Observed Surface:              %.1f%%', oc)]) as line
  from (select session_id % 10 as mission_id, abs(avg(est_n) - avg(gt_n)) / avg(gt_n) * 100 as se, sqrt(avg(pow(est_e - gt_e, 2) + pow(est_n - gt_n, 2))) as h, sqrt(avg(pow(est_u - gt_u, 2))) as v,
          sqrt(avg(pow(est_e - gt_e, 2) + pow(est_n - gt_n, 2) + pow(est_u - gt_u, 2))) as ate from trajectory_pairs group by 1) q
  join (select mission_id, 100e0 * count(*) filter (confidence > 0.1) / count(*) as oc from scored_points group by 1) c using (mission_id)
  join (select mission_id, avg(reproj_err) as re, 100e0 * count(*) filter (tier = 2) / count(*) as hc from t group by 1) p using (mission_id) join i using (mission_id)"""


@query("R2_summary_lines", check_sql(_LINES, "trajectory_pairs", "scored_points", "points", t=_TIERED, i=_IMAGES))
def _r2l(spark, sf):
    return rp.quality_report(*_quality_parts(spark, sf)).select("mission_id", F.posexplode("summary_lines").alias("line_no", "line"))


_MIS = """select mission_id, case when mission_id % 8 = 3 then 'ortho_test_' || lower(name) else lower(name) || '_run' end as folder, case when mission_id % 4 <> 0 then name end as name,
  is_demo, modified_time, has_report, case when mission_id % 2 = 0 then 'DRAFT' end as status from missions"""


def _missions(spark, sf):
    m = load(spark, sf, "missions")
    i = F.col("mission_id")
    low = F.lower("name")
    return m.select("mission_id", F.when(i % 8 == 3, F.concat(F.lit("ortho_test_"), low)).otherwise(F.concat(low, F.lit("_run"))).alias("folder"),
                    F.when(i % 4 != 0, F.col("name")).alias("name"), "is_demo", "modified_time", "has_report", F.when(i % 2 == 0, "DRAFT").alias("status"))


def _catalog(spark, sf):
    m = _missions(spark, sf)
    sup = _supplier(spark, sf).groupBy(F.col("s_nationkey").alias("mission_id")).agg(F.count(F.lit(1)).alias("building_count"))
    frames = spark.read.parquet(f"{sf}/customer.parquet").groupBy(F.col("c_nationkey").alias("mission_id")).agg(F.count(F.lit(1)).alias("total_frames"))
    reports = frames.join(m.where("has_report").select("mission_id"), "mission_id", "left_semi")
    return rp.mission_catalog(m.drop("has_report"), reports, sup, ("ortho_test",))


_CAT = """select m.mission_id, m.folder, coalesce(m.name, upper(m.folder[1]) || replace(m.folder[2:], '_', ' ')) as raw_name, m.name as given, coalesce(m.is_demo, false) or contains(m.folder, 'demo') as is_demo, starts_with(m.folder, 'ortho_test') as is_scratch,
   case when coalesce(m.is_demo, false) or contains(m.folder, 'demo') then 'DEMO_MISSIONS' else 'MY_MISSIONS' end as category, m.modified_time,
   case when m.has_report and c.n is not null then 'COMPLETED' else coalesce(m.status, 'IN_PROGRESS') end as status, case when m.has_report then c.n end as total_frames, coalesce(b.n, 0) as building_count
   from mi m left join (select c_nationkey as k, count(*) as n from customer group by 1) c on c.k = m.mission_id left join (select s_nationkey as k, count(*) as n from supplier group by 1) b on b.k = m.mission_id"""


@query("R5_mission_catalog", check_sql("select mission_id, folder, is_demo, is_scratch, category, modified_time, status, total_frames, building_count from ct", "missions", mi=_MIS, ct=_CAT))
def _r5(spark, sf):
    return _catalog(spark, sf).drop("name")


@query("Q2_catalog_order", check_sql("select mission_id, row_number() over (order by category <> 'MY_MISSIONS', modified_time desc, mission_id) as pos from ct", "missions", mi=_MIS, ct=_CAT))
def _q2(spark, sf):
    # one row per mission: numbering the finished catalog in one task is numbering a page list
    w = Window.orderBy(F.col("category") != "MY_MISSIONS", F.col("modified_time").desc(), "mission_id")
    return _catalog(spark, sf).select("mission_id", F.row_number().over(w).cast("long").alias("pos"))


@query("Q5_search_missions", check_sql("select c_custkey as mission_id, c_name as name from {customer} where contains(lower(c_name), '00') order by c_name, c_custkey limit 20 offset 40"))
def _q5(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("mission_id"), F.col("c_name").alias("name"))
    return rp.search_missions(c, "00", 2, 20)


@query("R6_mission_points", check_sql("select mission_id, point_id, class_id from points where mission_id = 4", "points"))
def _r6(spark, sf):
    cat = load(spark, sf, "missions")
    return rp.mission_detail(cat, 4, load(spark, sf, "points")).select("mission_id", "point_id", "class_id")


@query("R7_deliverables", check_sql(
    """select m.mission_id, d.deliverable, coalesce(c.n, 0) as n_rows from missions m, (values ('cameras'), ('points')) d(deliverable) left join (
        select mission_id, 'points' as deliverable, count(*) as n from points group by 1 union all select session_id, 'cameras', count(*) from poses group by 1) c on c.mission_id = m.mission_id and c.deliverable = d.deliverable""",
    "missions", "points", "poses"))
def _r7(spark, sf):
    return rp.deliverables(load(spark, sf, "missions"), {"points": load(spark, sf, "points"), "cameras": load(spark, sf, "poses").withColumnRenamed("session_id", "mission_id")})


@query("R8_scene_summary", check_sql(
    """select p.mission_id, p.n as num_points, true as has_semantics, coalesce(c.n, 0) as num_cameras, coalesce(b.n, 0) as num_buildings from (select mission_id, count(*) as n from points group by 1) p
       left join (select session_id as k, count(*) as n from poses group by 1) c on c.k = p.mission_id left join (select mission_id as k, count(distinct cluster_id) as n from instance_points group by 1) b on b.k = p.mission_id""",
    "points", "poses", "instance_points"))
def _r8(spark, sf):
    inst = load(spark, sf, "instance_points").select("mission_id", "cluster_id").distinct()
    return rp.scene_summary(load(spark, sf, "points"), load(spark, sf, "poses").withColumnRenamed("session_id", "mission_id"), inst)


@query("A23_readiness", check_sql(
    """select mission_id, cast(least(100, sc) as int) as readiness_score, sc >= 40 as ready_to_reconstruct, list_filter([case when has_video and blur > 15 then 'motion_blur' end, case when not has_video then 'no_video' end,
          case when gps_fixes = 0 then 'no_gps' end], lambda x: x is not null) as warnings
        from (select *, case when has_video then 45 + case when width >= 3840 or height >= 2160 then 10 when width >= 1920 or height >= 1080 then 5 else 0 end else 0 end
            + case when gps_fixes > 0 then 35 + case when contains(lower(log_name), 'imu') or gps_fixes > 50 then 10 else 0 end else 0 end as sc,
          least(100, greatest(0, (1 - least(sharpness / 150, 1)) * 25)) as blur from mission_inputs)""", "mission_inputs"))
def _a23(spark, sf):
    m = load(spark, sf, "mission_inputs")
    blur = fr.motion_blur_pct(m, ["mission_id"], 9).select("mission_id", "motion_blur_pct")
    return rp.readiness(m.join(blur, "mission_id"))


@query("C18_slugs", check_sql(
    "select c_custkey, regexp_replace(replace(trim(lower('  ' || c_mktsegment || ' / ' || c_name || '! ')), ' ', '_'), '[^a-z0-9_]', '', 'g') as slug from {customer}"))
def _c18(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", tx.slug(F.concat(F.lit("  "), "c_mktsegment", F.lit(" / "), "c_name", F.lit("! "))).alias("slug"))


@query("Q6_picked_distance", check_sql(
    f"select session_id, seq, {rnd('sqrt(pow(e, 2) + pow(n, 2) + pow(u, 2))', 3)} as distance_m from (" + enu_sql("fo", "session_id, seq") + ")",
    "gps_fixes", origins=_ORIGINS, fo=_FIX_ORIGIN))
def _q6(spark, sf):
    gps = load(spark, sf, "gps_fixes")
    df = gps.join(tm.first_fix_origin(gps), "session_id")
    df = geodesy.with_ecef(geodesy.with_ecef(df, "lat", "lon", "alt_m", "a_"), "origin_lat", "origin_lon", "origin_alt", "b_")
    d2 = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in "xyz"), F.lit(0.0))
    return rounded(df.select("session_id", "seq", F.sqrt(d2).alias("distance_m")), 3)


# --- sinks --------------------------------------------------------------------------------------

_ASPRS = "case class_id when 0 then 6 when 1 then 11 when 2 then 5 when 3 then 3 when 4 then 64 when 5 then 64 else 1 end"


@query("S11_classified_points", check_sql(
    f"""select mission_id, point_id, cast(round_even((x - x0) / 0.001::double, 0) as bigint) as ix, cast(round_even((y - y0) / 0.001::double, 0) as bigint) as iy, cast(round_even((z - z0) / 0.001::double, 0) as bigint) as iz,
         cast((r << 8) | r as int) as red, cast((g << 8) | g as int) as green, cast((b << 8) | b as int) as blue, cast({_ASPRS} as int) as classification,
         cast(case when hi > lo then floor((track_len - lo) / (hi - lo) * 65535) else 32768 end as int) as intensity
       from points join (select mission_id, min(x) as x0, min(y) as y0, min(z) as z0, min(track_len) as lo, max(track_len) as hi from points group by 1) using (mission_id)""", "points"))
def _s11(spark, sf):
    path = scratch_path(spark, "las")
    sinks.write_classified_points(load(spark, sf, "points"), path)
    return spark.read.parquet(path).select("mission_id", "point_id", "ix", "iy", "iz", "red", "green", "blue", "classification", "intensity").withColumn("mission_id", F.col("mission_id").cast("long"))


_ORG = "select mission_id, 47.38e0 as origin_lat, 8.54e0 + mission_id as origin_lon, 460e0 as origin_alt from (select distinct mission_id from points)"


def _origins(spark, sf):
    m = load(spark, sf, "points").select("mission_id").distinct()
    return m.withColumns({"origin_lat": F.lit(47.38), "origin_lon": 8.54 + F.col("mission_id"), "origin_alt": F.lit(460.0)})


@query("S12_raster_header", check_sql(
    f"select mission_id, {rnd('x_min')} as x_min, {rnd('y_max')} as y_max, 2.0::double as cell_size_m, n_rows, n_cols, cast(32600 + floor((origin_lon + 180) / 6) + 1 as int) as epsg from b join o using (mission_id)",
    "points", b=bounds_sql(2.0), o=_ORG))
def _s12(spark, sf):
    p = load(spark, sf, "points")
    header = sinks.raster_header(rs.cloud_bounds(p, 2.0), _origins(spark, sf), 2.0)
    path = scratch_path(spark, "raster")
    sinks.write_raster(rs.grid_elevation(p, 2.0, "max"), header, path)
    return rounded(spark.read.parquet(f"{path}/header"))


@query("S13_viewer_points", check_sql(f"select point_id, {NAME} as class, case {TIER} when 2 then 'high' when 1 then 'medium' else 'low' end as confidence, true as in_place from points", "points"))
def _s13(spark, sf):
    org = _origins(spark, sf)
    path = scratch_path(spark, "viewer")
    sinks.write_documents(sinks.viewer_points(load(spark, sf, "points"), org), path)
    back = spark.read.schema("mission_id long, point_id long, lat double, lon double, alt double, class string, confidence string").json(path)
    # the positions written must lead back to the local frame they came from
    local = geodesy.with_enu(back.join(org, "mission_id"), alt="alt").select("point_id", "class", "confidence", "e", "n", "u")
    src = load(spark, sf, "points").select("point_id", "x", "y", "z")
    near = (F.abs(F.col("e") - F.col("x")) < 1e-4) & (F.abs(F.col("n") - F.col("y")) < 1e-4) & (F.abs(F.col("u") - F.col("z")) < 1e-4)
    return local.join(src, "point_id").select("point_id", "class", "confidence", near.alias("in_place"))


@query("S13_viewer_header", check_sql(f"select mission_id, count(*) as n_points, list(distinct {NAME} order by {NAME}) as classes, origin_lat, origin_lon, origin_alt from points join o using (mission_id) group by 1, 4, 5, 6", "points", o=_ORG))
def _s13h(spark, sf):
    return sinks.viewer_header(load(spark, sf, "points"), _origins(spark, sf))


@query("S14_trajectory_bundle", check_sql(
    f"select session_id, image_id, name as frame, {rnd('47.38 + (ty * cos(0)) / 111180.0', 2)} as lat, {rnd('460 + 60', 1)} as alt_about from poses", "poses"))
def _s14(spark, sf):
    poses = load(spark, sf, "poses")
    c = camera_center(rot(), cols("tx", "ty", "tz"))
    org = poses.select("session_id").distinct().withColumns({"origin_lat": F.lit(47.38), "origin_lon": F.lit(8.54), "origin_alt": F.lit(460.0)})
    path = scratch_path(spark, "trajectory")
    sinks.write_documents(sinks.trajectory_points(poses.withColumns({f"c{i}": c[i] for i in range(3)}), org), path)
    back = spark.read.schema("session_id long, image_id long, frame string, lat double, lon double, alt double").json(path)
    return back.withColumn("alt_about", F.col("alt")).select("session_id", "image_id", "frame", settle("lat", 2), settle("alt_about", 1))


@query("S15_report_sink", check_sql("select mission_id, count(*)::bigint as sparse_points, count(distinct class_name) as n_classes from t group by 1", "points", t=_TIERED))
def _s15(spark, sf):
    path = scratch_path(spark, "report")
    sinks.write_documents(rp.nested_report(rp.mission_report(load(spark, sf, "points"), 2.0)), path)
    back = spark.read.schema("mission_id long, sparse_points long, class_breakdown array<struct<class_name:string,n_points:long>>").json(path)
    return back.select("mission_id", "sparse_points", F.size("class_breakdown").cast("long").alias("n_classes"))


@query("S16_building_documents", check_sql("select mission_id, count(*) as total_buildings, list(n order by id) as point_counts from (select mission_id, cluster_id + 1 as id, count(*) as n from instance_points group by 1, 2) group by 1", "instance_points"))
def _s16(spark, sf):
    inst = load(spark, sf, "instance_points").groupBy("mission_id", (F.col("cluster_id") + 1).alias("instance_id")).agg(F.count(F.lit(1)).alias("point_count"))
    path = scratch_path(spark, "buildings")
    sinks.write_documents(sinks.building_documents(inst), path)
    back = spark.read.schema("mission_id long, total_buildings long, buildings array<struct<instance_id:int,point_count:long>>").json(path)
    return back.select("mission_id", "total_buildings", F.col("buildings.point_count").alias("point_counts"))


@query("S17_comparison_sink", check_sql(
    f"""select 'run' || session_id as config, {rnd('sqrt(avg(pow(est_e - gt_e, 2) + pow(est_n - gt_n, 2)))')} as horizontal_rmse_m, {rnd('sqrt(avg(pow(est_u - gt_u, 2)))')} as vertical_rmse_m from trajectory_pairs group by session_id""", "trajectory_pairs"))
def _s17(spark, sf):
    t = load(spark, sf, "trajectory_pairs").withColumn("config", F.concat(F.lit("run"), "session_id"))
    path = scratch_path(spark, "comparison")
    sinks.write_comparison(ac.georeference_accuracy(t, ["config"]), path)
    back = spark.read.csv(f"{path}/csv", header=True)
    return rounded(back.select("config", F.col("horizontal_rmse_m").cast("double").alias("horizontal_rmse_m"), F.col("vertical_rmse_m").cast("double").alias("vertical_rmse_m")))


# --- sources: each query first writes its own input files from the test tables -------------------


@query("S1_flight_log", check_sql("select timestamp_s, lat, lon, alt_m from gps_fixes", "gps_fixes"))
def _s1(spark, sf):
    path = scratch_path(spark, "log")
    load(spark, sf, "gps_fixes").select("timestamp_s", "lat", "lon", "alt_m").write.csv(path, header=True)
    return logs.flight_log(spark, path)


def _untidy(df, names: dict[str, str], path: str) -> None:
    """A CSV as recorders write it: blanks around header names, an empty trailing column, blank rows in between."""
    cols = [F.col(c).cast("string").alias(h) for c, h in names.items()]
    out = df.select(*cols, F.lit(None).cast("string").alias(" "))
    blank = out.limit(3).select(*[F.lit(" ").alias(c) for c in out.columns])
    out.unionByName(blank).write.csv(path, header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


@query("S2_tolerant_csv", check_sql("select cast(seq as varchar) as imgid, count(*) as n from gps_fixes group by 1", "gps_fixes"))
def _s2(spark, sf):
    path = scratch_path(spark, "untidy")
    _untidy(load(spark, sf, "gps_fixes"), {"seq": " imgid", "lat": "lat ", "lon": " lon "}, path)
    return logs.tolerant_csv(spark, path).groupBy("imgid").agg(F.count(F.lit(1)).alias("n"))


def _recording(spark, sf):
    folder = scratch_path(spark, "recording")
    us = lambda df: df.withColumn("us", F.round(F.col("timestamp_s") * 1e6).cast("long"))
    gps, imu, baro = (us(load(spark, sf, n)) for n in ("gps_fixes", "imu", "baro"))
    stale = gps.withColumns({"us": F.lit(0), "lat": F.lit(0.0)})
    # two rows per image id in one file: the stale one comes first, the later one must win
    both = stale.withColumn("o", F.lit(0)).unionByName(gps.withColumn("o", F.lit(1))).orderBy("seq", "o")
    _untidy(both, {"us": "Timpstemp", "seq": " imgid", "lat": " lat", "lon": " lon", "alt_m": " alt"}, f"{folder}/OnboardGPS.csv")
    imu = imu.orderBy("seq")
    _untidy(imu, {"us": "Timpstemp", "ax": " x", "ay": " y", "az": " z"}, f"{folder}/RawAccel.csv")
    _untidy(imu, {"us": "Timpstemp", "gx": " x", "gy": " y", "gz": " z"}, f"{folder}/RawGyro.csv")
    _untidy(baro, {"us": "Timpstemp", "pressure_hpa": " Pressure", "altitude_m": " Altitude"}, f"{folder}/BarometricPressure.csv")
    truth = gps.unionByName(gps.withColumn("seq", F.col("seq") + 10_000_000)).withColumns({"gx": F.lit(1.5), "gy": F.lit(2.5), "gz": F.col("alt_m")})
    _untidy(truth, {"seq": "imgid ", "gx": " x_gt", "gy": " y_gt", "gz": " z_gt"}, f"{folder}/GroundTruthAGL.csv")
    ids = gps.select("seq").unionByName(gps.select((F.col("seq") + 20_000_000).alias("seq")))
    images = ids.select(F.format_string("%05d.jpg", "seq").alias("image_filename"))
    return logs.multi_log_session(spark, folder, images, "rec", 0.4)


@query("S3_recording_frames", check_sql(
    f"select 'rec' as session_id, row_number() over (order by seq) - 1 as frame_idx, {rnd('round(timestamp_s * 1e6) / 1e6', 5)} as timestamp_s, lpad(cast(seq as varchar), cast(greatest(5, length(cast(seq as varchar))) as int), '0') || '.jpg' as image_filename from gps_fixes", "gps_fixes"))
def _s3(spark, sf):
    return rounded(_recording(spark, sf)["frames"], 5)


@query("S3_recording_logs", check_sql(
    f"select 'gps' as log, count(*) as n, {rnd('sum(lat)', 3)} as total from gps_fixes union all select 'baro', count(*), {rnd('sum(altitude_m)', 3)} from baro union all select 'imu', count(*), {rnd('sum(ax)', 3)} from imu", "gps_fixes", "baro", "imu"))
def _s3l(spark, sf):
    rec = _recording(spark, sf)
    out = None
    for log, table, c in (("gps", "gps_fixes", "lat"), ("baro", "baro", "altitude_m"), ("imu", "imu", "ax")):
        row = rec[table].agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("total")).withColumn("log", F.lit(log))
        out = row if out is None else out.unionByName(row)
    return rounded(out, 3)


_IN_ORDER = "(select 'rec' as session_id, seq, round(timestamp_s * 1e6) / 1e6 as timestamp_s from {log})"
_STEPS = """select count(*) as n, bool_or(d <= 0) as bad, max(d) as mx, avg(d) as av from (select timestamp_s - lag(timestamp_s) over (order by seq) as d from {log})"""


@query("S3_integrity", check_sql(
    f"""select 'rec' as session_id, issue, {rnd('value', 5)} as value from (select unnest([
          case when g.bad then {{'issue': 'frames_not_increasing', 'value': null::double}} end, case when g.bad then {{'issue': 'gps_not_increasing', 'value': null::double}} end,
          case when g.mx > 0.5 then {{'issue': 'gps_gap', 'value': g.mx}} end,
          case when i.n >= 2 and (case when i.av > 0 then 1 / i.av else 0 end) < 20 then {{'issue': 'imu_rate_low', 'value': case when i.av > 0 then 1 / i.av else 0 end}} end], recursive := true) from g, i) where issue is not null""",
    "gps_fixes", "imu", g=_STEPS.replace("{log}", _IN_ORDER.replace("{log}", "gps_fixes")), i=_STEPS.replace("{log}", _IN_ORDER.replace("{log}", "imu"))))
def _s3i(spark, sf):
    rec = _recording(spark, sf)
    sessions = spark.range(1).select(F.lit("rec").alias("session_id"), F.lit("REAL").alias("provenance"))
    frames = rec["frames"].withColumn("seq", F.col("frame_idx"))
    return rounded(tm.validate_integrity(sessions, frames, rec["gps_fixes"], rec["imu"], max_gap_s=0.5, chunk=1000.0), 5)


@query("S4_checkpoints", check_sql(
    f"select 'rec' as session_id, lpad(cast(seq as varchar), cast(greatest(5, length(cast(seq as varchar))) as int), '0') || '.jpg' as image_filename, 1.5::double as utm_x, 2.5::double as utm_y, {rnd('alt_m')} as utm_z from gps_fixes", "gps_fixes"))
def _s4(spark, sf):
    return rounded(_recording(spark, sf)["checkpoints"])


@query("S5_blank_separated_logs", check_sql("select timestamp_s, gx, gy, gz, ax, ay, az from imu", "imu"))
def _s5(spark, sf):
    path = scratch_path(spark, "imu")
    line = F.concat_ws("  ", *[F.col(c).cast("string") for c in ("timestamp_s", "gx", "gy", "gz", "ax", "ay", "az")])
    load(spark, sf, "imu").select(F.explode(F.array(F.lit("# t wx wy wz ax ay az"), F.concat(F.lit(" "), line), F.lit(""))).alias("value")).write.text(path)
    return logs.imu_list(spark, path).drop("seq")


@query("S5_image_list", check_sql("select frame_idx as id, timestamp_s, image_filename from frames", "frames"))
def _s5i(spark, sf):
    path = scratch_path(spark, "images")
    line = F.concat_ws(" ", F.col("frame_idx").cast("string"), F.col("timestamp_s").cast("string"), "image_filename")
    load(spark, sf, "frames").select(F.explode(F.array(F.lit("# id t name"), line)).alias("value")).write.text(path)
    return logs.image_list(spark, path).drop("seq")


@query("S6_session_documents", check_sql(
    " union all ".join(f"select '{n}' as log, cast(session_id as varchar) as session_id, count(*) as n, {rnd(f'sum(timestamp_s)', 5)} as total from {n} group by 2" for n in ("frames", "gps_fixes", "imu", "baro")),
    "frames", "gps_fixes", "imu", "baro"))
def _s6(spark, sf):
    t = {n: load(spark, sf, n) for n in ("frames", "gps_fixes", "imu", "baro")}
    origin = tm.first_fix_origin(t["gps_fixes"]).withColumns({"provenance": F.lit("REAL"), "crs_epsg": F.lit(4326)})
    path = scratch_path(spark, "sessions")
    logs.session_documents(origin, t["frames"], t["gps_fixes"], t["imu"], t["baro"]).write.json(path)
    back = logs.read_sessions(spark, path)
    out = None
    for n in t:
        rows = back[n].groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("timestamp_s").alias("total")).withColumn("log", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, 5)


def _model(spark, sf):
    folder = scratch_path(spark, "model")
    s = _supplier(spark, sf)
    cam = F.format_string("%d PINHOLE 100 100 100.5 101.5 50.0 49.0", "s_suppkey")
    s.select(F.explode(F.array(F.lit("# cameras"), cam)).alias("value")).write.text(f"{folder}/cameras.txt")
    p = load(spark, sf, "track_points")
    pt = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("point_id", "x", "y", "z")], F.lit("1 2 3"), F.lit("0.75"), F.lit("4 0 5 1 6 2"))
    p.select(F.explode(F.array(F.lit("# points"), pt, F.lit(""))).alias("value")).write.text(f"{folder}/points3D.txt")
    obs = load(spark, sf, "observations")
    triple = F.concat_ws(" ", F.col("u").cast("string"), F.col("v").cast("string"), F.when(F.col("obs_idx") == 1, F.lit("-1")).otherwise(F.col("point_id").cast("string")))
    # a suppliers' worth of observations per line, in order; images of poor suppliers get an empty line
    tails = obs.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("obs_idx", triple.alias("t")))), lambda r: r["t"]), " ").alias("tail"))
    heads = s.join(tails, s["s_suppkey"] == tails["image_id"], "left")
    head = F.format_string("%d 1.0 0.1 0.2 0.3 1.5 2.5 3.5 %d f%d.jpg", "s_suppkey", "s_suppkey", "s_suppkey")
    tail = F.when(F.col("s_acctbal") < 1000, F.lit("")).otherwise(F.coalesce("tail", F.lit("")))
    heads.select(F.concat(F.lit("# image\n"), head, F.lit("\n"), tail).alias("value")).write.text(f"{folder}/images.txt")
    return sparse.read_model(spark, folder)


@query("S7_model_cameras", check_sql("select s_suppkey as camera_id, 'PINHOLE' as model, 100 as width, 100 as height, 100.5::double as fx, 101.5::double as fy, 50.0::double as cx, 49.0::double as cy from {supplier}"))
def _s7(spark, sf):
    return _model(spark, sf)["cameras"].drop("params")


@query("S8_model_points", check_sql(f"select point_id, {rnd('x')} as x, {rnd('y')} as y, {rnd('z')} as z, 1 as r, 2 as g, 3 as b, 0.75::double as reproj_err, 3.0::double as track_len from track_points", "track_points"))
def _s8(spark, sf):
    return rounded(_model(spark, sf)["points"])


@query("S9_model_observations", check_sql(
    f"select o.image_id, o.obs_idx, {rnd('u')} as u, {rnd('v')} as v, o.point_id from observations o join {{supplier}} s on s.s_suppkey = o.image_id and s.s_acctbal >= 1000 where o.obs_idx <> 1 and o.point_id in (select point_id from track_points)", "observations", "track_points"))
def _s9(spark, sf):
    return rounded(_model(spark, sf)["observations"])


@query("S10_model_poses", check_sql("select s_suppkey as image_id, 'f' || s_suppkey || '.jpg' as name, 1.5::double as tx, 100.5::double as fx, 100 as width from {supplier}"))
def _s10(spark, sf):
    return _model(spark, sf)["poses"].select("image_id", "name", "tx", "fx", "width")


@query("S18_probe_fixes", check_sql("select lat, lon, case when seq % 2 = 0 then alt_m else 0 end as alt_m from gps_fixes", "gps_fixes"))
def _s18(spark, sf):
    path = scratch_path(spark, "probe")
    g = load(spark, sf, "gps_fixes")
    g.select(F.col("lat").alias("Latitude"), F.col("lon").alias("longitude"), F.when(F.col("seq") % 2 == 0, F.col("alt_m")).alias("altitude")).write.csv(path, header=True)
    return logs.probe_fixes(logs.tolerant_csv(spark, path))
