"""Registered queries on point confidence, coverage and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from skymill.functions import taxonomy as tx
from skymill.operators import confidence as cf
from skymill.operators import raster as rs
from skymill.plans.fixtures import check_sql, load
from skymill.plans.registry import query, rnd, rounded

TIER = "case when track_len >= 5 and reproj_err <= 1 then 2 when track_len >= 3 and reproj_err <= 2 then 1 else 0 end"


def case_map(expr: str, table: dict, default) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"case {expr} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in table.items()) + f" else {q(default)} end"


NAME = case_map("class_id", tx.CLASS_NAMES, "Background clutter")


def _pct(cond: str) -> str:
    return rnd(f"100.0 * count(case when {cond} then 1 end) / count(*)", 5)


_TIER_COLS = f"count(*) as n_points, {_pct('tier = 2')} as pct_high, {_pct('tier = 1')} as pct_medium, {_pct('tier = 0')} as pct_low"
_TIERED = f"select *, {TIER} as tier, {NAME} as class_name from points"


@query("P9_confidence_tier", check_sql(f"select point_id, cast({TIER} as int) as tier, case {TIER} when 2 then 0.9::double when 1 then 0.6::double else 0.3::double end as score, "
                                       f"case {TIER} when 2 then 'high' when 1 then 'medium' else 'low' end as tier_name from points", "points"))
def _p9(spark, sf):
    t = cf.confidence_tier()
    return load(spark, sf, "points").select("point_id", t.alias("tier"), cf.tier_score(t).alias("score"), cf.tier_name(t).alias("tier_name"))


@query("A2_tier_summary", check_sql(f"select mission_id, {_TIER_COLS} from t group by 1", "points", t=_TIERED))
def _a2(spark, sf):
    return rounded(cf.tier_summary(load(spark, sf, "points")), 5)


@query("A3_class_breakdown", check_sql(f"select mission_id, class_name, {_TIER_COLS}, {rnd('avg(track_len)', 5)} as mean_track_len, "
                                       f"{rnd('avg(reproj_err)', 5)} as mean_reprojection_error_px from t group by 1, 2", "points", t=_TIERED))
def _a3(spark, sf):
    return rounded(cf.class_breakdown(load(spark, sf, "points")), 5)


_FACTORS = """select *, greatest(0, least(1, 1 - reproj_err / 2)) as f1, greatest(0, least(1, (track_len - 2) / 4)) as f2,
  case when depth_c is not null then greatest(0, least(1, depth_c)) end as f3,
  case when sensor_res_m is not null then greatest(0, least(1, 1 - sensor_res_m / 3)) end as f4,
  case when semantic_c is not null then greatest(0, least(1, semantic_c)) end as f5 from scored_points"""


@query("P10_uncertainty", check_sql(
    f"""select point_id, {rnd('c', 7)} as total_confidence, case when c >= 0.7 then 'HIGH' when c >= 0.4 then 'MEDIUM' when c >= 0.1 then 'LOW' else 'UNOBSERVED' end as tier,
       {rnd('f1', 7)} as reprojection_score, {rnd('f2', 7)} as track_length_score, {rnd('f3', 7)} as depth_consistency_score,
       {rnd('f4', 7)} as sensor_agreement_score, {rnd('f5', 7)} as semantic_confidence_score
       from (select *, least(1, greatest(0, (0.3::double * f1 + 0.25::double * f2 + coalesce(0.25::double * f3, 0) + coalesce(0.2::double * f4, 0) + coalesce(0.15::double * f5, 0))
         / (0.3::double + 0.25::double + case when f3 is null then 0::double else 0.25::double end + case when f4 is null then 0::double else 0.2::double end + case when f5 is null then 0::double else 0.15::double end))) as c from f)""",
    "scored_points", f=_FACTORS))
def _p10(spark, sf):
    out = cf.score_uncertainty(load(spark, sf, "scored_points"), digits=9)
    return rounded(out.select("point_id", "total_confidence", "tier", "reprojection_score", "track_length_score",
                              "depth_consistency_score", "sensor_agreement_score", "semantic_confidence_score"), 7)


_CAT = case_map("class_name", tx.CLASS_TO_CATEGORY, "Terrain")


@query("A7_categorical_coverage", check_sql(
    f"""select g.mission_id, g.category, coalesce(c.n, 0) as total_elements, coalesce(c.o, 0) as observed_elements,
        {rnd('case when coalesce(c.n, 0) > 0 then 100.0 * c.o / c.n when g.obs > 0 then 100 else 0 end', 5)} as coverage_ratio_pct
      from (select mission_id, obs, unnest({list(tx.COVERAGE_CATEGORIES)}) as category from (select mission_id, count(case when confidence > 0.1 then 1 end) as obs from s group by 1)) g
      left join (select mission_id, category, count(*) as n, count(case when confidence > 0.1 then 1 end) as o from (
           select *, case when class_name = 'Building' then case when abs(z - mz) > 2 then 'Facades' else 'Roofs' end else {_CAT} end as category
           from (select *, avg(z) over (partition by mission_id) as mz from s)) group by 1, 2) c on c.mission_id = g.mission_id and c.category = g.category""",
    "scored_points", s=f"select *, {NAME} as class_name from scored_points"))
def _a7(spark, sf):
    return rounded(cf.categorical_coverage(load(spark, sf, "scored_points")), 5)


@query("A7_coverage_summary", check_sql(
    f"""select mission_id, {rnd('100.0 * o / n', 5)} as overall_coverage_pct, {rnd('100.0 * h / n', 5)} as high_confidence_observed_pct,
        {rnd('100.0 * (o - h) / n', 5)} as low_confidence_observed_pct, {rnd('100.0 * (n - o - x) / n', 5)} as unobserved_occluded_pct,
        {rnd('100.0 * x / n', 5)} as unobserved_outside_fov_pct, true as is_assumed
      from (select *, floor((n - o) * 0.4::double) as x from (select mission_id, count(*) as n, count(case when confidence > 0.1 then 1 end) as o, count(case when confidence >= 0.7 then 1 end) as h
       from scored_points group by 1))""", "scored_points"))
def _a7s(spark, sf):
    return rounded(cf.coverage_summary(load(spark, sf, "scored_points")), 5)


def _state_pct(cond: str) -> str:
    return f"round_even(100.0::double * count(case when {cond} then 1 end) / count(*) * 0.88::double, 2) + 0.0"


@query("A9_scene_states", check_sql(
    f"select mission_id, count(*) as total_elements, {_state_pct('confidence >= 0.795')} as observed_high_pct, "
    f"{_state_pct('confidence >= 0.495 and confidence < 0.795')} as observed_uncertain_pct, {_state_pct('confidence < 0.495')} as observed_low_pct, "
    "12.0::double as unobserved_pct from scored_points group by 1", "scored_points"))
def _a9(spark, sf):
    return rounded(cf.scene_state_report(load(spark, sf, "scored_points")), 2)


_INSTANCES = "select l_suppkey % 10 as mission_id, l_partkey as instance_id, sum(l_quantity) * 3e0 as footprint_area_m2 from {lineitem} where l_returnflag = 'R' group by 1, 2"


@query("A11_semantic_quality", check_sql(
    """select c.mission_id, c.n as n_points, round_even(c.m, 4) + 0.0 as mean_semantic_confidence, round_even(c.low, 2) + 0.0 as low_confidence_point_pct,
        coalesce(b.ids, []::bigint[]) as oversized_instance_ids, cast(len(coalesce(b.ids, []::bigint[])) as int) as oversized_instance_count,
        case when len(b.ids) > 0 and (c.m is null or c.m >= 0.4) then 'REVIEW_RECOMMENDED' when c.m < 0.4 then 'LOW_CONFIDENCE' when c.m is null then 'UNKNOWN' else 'TRUSTED' end as quality_tier
      from (select mission_id, count(semantic_c) as n, avg(semantic_c) as m, 100.0::double * count(case when semantic_c < 0.3 then 1 end) / count(semantic_c) as low from scored_points group by 1) c
      left join (select mission_id, list(instance_id order by instance_id) as ids from i where footprint_area_m2 > 900 group by 1) b on b.mission_id = c.mission_id""",
    "scored_points", i=_INSTANCES))
def _a11(spark, sf):
    inst = spark.sql(_INSTANCES.replace("{lineitem}", f"parquet.`{sf}/lineitem.parquet`"))
    return rounded(cf.semantic_quality(load(spark, sf, "scored_points"), inst, max_footprint_m2=900.0), 4)


@query("Q8_high_share", check_sql(f"select mission_id, {_pct('tier = 2')} as high_confidence_pct from t group by 1", "points", t=_TIERED))
def _q8(spark, sf):
    return rounded(cf.high_confidence_share(load(spark, sf, "points")), 5)


@query("Q7_class_counts", check_sql("select mission_id, class_name, count(*) as n from t group by 1, 2", "points", t=_TIERED))
def _q7(spark, sf):
    return load(spark, sf, "points").groupBy("mission_id", tx.class_name(F.col("class_id")).alias("class_name")).agg(F.count(F.lit(1)).alias("n"))


@query("U3_distinct_classes", check_sql("select mission_id, list(distinct class_name order by class_name) as classes from t group by 1", "points", t=_TIERED))
def _u3(spark, sf):
    p = load(spark, sf, "points")
    return p.groupBy("mission_id").agg(F.sort_array(F.collect_set(tx.class_name(F.col("class_id")))).alias("classes"))


@query("F9_class_predicates", check_sql(
    "select mission_id, count(case when class_id in (1, 7) then 1 end) as n_ground_like, count(case when class_id in (0, 2, 4, 6) then 1 end) as n_elevated from points group by 1", "points"))
def _f9(spark, sf):
    c = F.col("class_id")
    return load(spark, sf, "points").groupBy("mission_id").agg(
        F.count_if(c.isin(*tx.GROUND_LIKE_IDS)).alias("n_ground_like"), F.count_if(c.isin(*tx.ELEVATED_CLASS_IDS)).alias("n_elevated"))


@query("F10_layer_filter", check_sql("select point_id, class_id from points where class_id in (0, 1)", "points"))
def _f10(spark, sf):
    return load(spark, sf, "points").where(F.col("class_id").isin(0, 1)).select("point_id", "class_id")


@query("C17_class_maps", check_sql(
    f"""select train_id, cast({case_map('train_id', tx.STREET_TO_CLASS, 7)} as int) as class_id, cast({case_map('train_id % 9', tx.CLASS_TO_ASPRS, 1)} as int) as asprs,
        {case_map('train_id % 9', tx.CLASS_NAMES, 'Background clutter')} as class_name, count(*) as n from w group by 1, 2, 3, 4""",
    w="select cast((l_partkey + l_linenumber) % 21 as int) as train_id from {lineitem}"))
def _c17(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    t = ((F.col("l_partkey") + F.col("l_linenumber")) % 21).cast("int")
    df = li.select(t.alias("train_id")).groupBy("train_id").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("train_id") % 9
    return df.select("train_id", tx.street_to_class(F.col("train_id")).alias("class_id"), tx.asprs_code(c).alias("asprs"), tx.class_name(c).alias("class_name"), "n")


# --- rasters ------------------------------------------------------------------------------------


def bounds_sql(cell: float, src: str = "points") -> str:
    return f"""select *, cast(greatest(1, ceil((x_max - x_min) / {cell}::double)) as bigint) as n_cols, cast(greatest(1, ceil((y_max - y_min) / {cell}::double)) as bigint) as n_rows
      from (select mission_id, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max from {src} group by 1)"""


def cells_sql(cell: float, north: bool, src: str = "points") -> str:
    up = f"cast(floor((y - y_min) / {cell}::double) as bigint)"
    row = f"n_rows - 1 - {up}" if north else up
    return f"""select p.*, n_rows, n_cols, greatest(0, least(n_rows - 1, {row})) as row, greatest(0, least(n_cols - 1, cast(floor((x - x_min) / {cell}::double) as bigint))) as col
      from {src} p join b using (mission_id)"""


@query("O1_grid_elevation", check_sql(f"select mission_id, row, col, {rnd('max(z)')} as z from c group by 1, 2, 3", "points", b=bounds_sql(2.0), c=cells_sql(2.0, True)))
def _o1(spark, sf):
    return rounded(rs.grid_elevation(load(spark, sf, "points"), 2.0, "max"))


_SURF = "select mission_id, row, col, n_rows, n_cols, max(z) as dsm, min(case when class_id in (1, 7) then z end) as dtm, count(case when class_id in (1, 7) then 1 end) as n_ground from c group by 1, 2, 3, 4, 5"


@query("O2_surface_terrain", check_sql(f"select mission_id, row, col, {rnd('dsm')} as dsm, {rnd('dtm')} as dtm, n_ground from s", "points", b=bounds_sql(2.0), c=cells_sql(2.0, True), s=_SURF))
def _o2(spark, sf):
    return rounded(rs.surface_and_terrain(load(spark, sf, "points"), 2.0).drop("n_rows", "n_cols"))


@query("O2_elevation_stats", check_sql(
    f"select mission_id, n_rows, n_cols, cast(sum(n_ground) as bigint) as n_ground_points, {rnd('100.0 * (n_rows * n_cols - count(dtm)) / (n_rows * n_cols)', 5)} as pct_dtm_cells_unknown from s group by 1, 2, 3",
    "points", b=bounds_sql(2.0), c=cells_sql(2.0, True), s=_SURF))
def _o2s(spark, sf):
    return rounded(rs.elevation_stats(rs.surface_and_terrain(load(spark, sf, "points"), 2.0)), 5)


VOLUME_SQL = f"""select mission_id, {rnd('coalesce(sum(case when dsm - dtm > 0.5 then dsm - dtm end), 0) * 4', 4)} as total_above_ground_volume_m3,
  4.0::double * count(case when dsm - dtm > 0.5 then 1 end) as elevated_surface_area_m2, {rnd('coalesce(avg(case when dsm - dtm > 0.5 then dsm - dtm end), 0)', 4)} as mean_elevated_height_m,
  {rnd('coalesce(max(case when dsm - dtm > 0.5 then dsm - dtm end), 0)', 4)} as max_height_m from s group by 1"""


@query("A10_volumetrics", check_sql(VOLUME_SQL, "points", b=bounds_sql(2.0), c=cells_sql(2.0, True), s=_SURF))
def _a10(spark, sf):
    return rounded(rs.volumetrics(rs.surface_and_terrain(load(spark, sf, "points"), 2.0), 2.0), 4)


_REGION = f"select mission_id, row, col, n_rows, n_cols, count(*) as point_count, avg({TIER}) as mean_tier from c group by 1, 2, 3, 4, 5"


@query("O3_region_grid", check_sql(f"select mission_id, row, col, point_count, {rnd('mean_tier')} as mean_tier from g", "points", b=bounds_sql(5.0), c=cells_sql(5.0, False), g=_REGION))
def _o3(spark, sf):
    return rounded(rs.region_grid(load(spark, sf, "points")).drop("n_rows", "n_cols"))


@query("O3_region_grid_dense", check_sql(
    f"""select d.mission_id, d.row, d.col, g.point_count, {rnd('g.mean_tier')} as mean_tier from (select mission_id, r.i as row, k.i as col from b, range(200) r(i), range(200) k(i) where r.i < n_rows and k.i < n_cols) d
        left join g on g.mission_id = d.mission_id and g.row = d.row and g.col = d.col""",
    "points_small", b=bounds_sql(5.0, "points_small"), c=cells_sql(5.0, False, "points_small"), g=_REGION))
def _o3d(spark, sf):
    p = load(spark, sf, "points_small")
    return rounded(rs.dense_grid(rs.region_grid(p), rs.cloud_bounds(p, 5.0)))


@query("A24_unobserved_share", check_sql(f"select mission_id, {rnd('100.0 * (n_rows * n_cols - count(*)) / (n_rows * n_cols)', 5)} as pct_grid_cells_unobserved from g group by mission_id, n_rows, n_cols",
                                         "points_small", b=bounds_sql(5.0, "points_small"), c=cells_sql(5.0, False, "points_small"), g=_REGION))
def _a24(spark, sf):
    return rounded(rs.unobserved_share(rs.region_grid(load(spark, sf, "points_small"))), 5)


@query("O5_ground_reference", check_sql(
    f"select mission_id, {rnd('coalesce(quantile_cont(case when class_id in (1, 7) then z end, 0.5), quantile_cont(z, 0.5))')} as z_ref from points group by 1", "points"))
def _o5(spark, sf):
    return rounded(rs.ground_reference(load(spark, sf, "points")))


def _near(dr: int, dc: int) -> str:
    r = f"case when p.row + {dr} < 0 then 1 when p.row + {dr} > 63 then 62 else p.row + {dr} end"
    c = f"case when p.col + {dc} < 0 then 1 when p.col + {dc} > 63 then 62 else p.col + {dc} end"
    return f"list_extract(im.g, ({r}) * 64 + ({c}) + 1)"


_IM = "select image_id, list(gray order by row, col) as g from gray_pixels group by 1"


@query("O6_sharpness", check_sql(
    f"select image_id, {rnd('var_pop(lap)', 4)} as sharpness from (select p.image_id, {_near(-1, 0)} + {_near(1, 0)} + {_near(0, -1)} + {_near(0, 1)} - 4 * p.gray as lap "
    "from gray_pixels p join im on im.image_id = p.image_id) group by 1", "gray_pixels", im=_IM))
def _o6(spark, sf):
    return rounded(rs.sharpness(load(spark, sf, "gray_pixels")), 4)


_GX = f"({_near(-1, 1)} + 2 * {_near(0, 1)} + {_near(1, 1)} - {_near(-1, -1)} - 2 * {_near(0, -1)} - {_near(1, -1)})"
_GY = f"({_near(1, -1)} + 2 * {_near(1, 0)} + {_near(1, 1)} - {_near(-1, -1)} - 2 * {_near(-1, 0)} - {_near(-1, 1)})"


@query("O8_gradient_confidence", check_sql(
    f"select image_id, row, col, {rnd('least(0.95, greatest(0.4, sqrt(gx * gx + gy * gy) / 100.0::double))')} as depth_confidence from (select p.image_id, p.row, p.col, {_GX}::double as gx, {_GY}::double as gy "
    "from gray_pixels p join im on im.image_id = p.image_id)", "gray_pixels", im=_IM))
def _o8(spark, sf):
    return rounded(rs.gradient_confidence(load(spark, sf, "gray_pixels")))


@query("A15_exposure_score", check_sql(f"select image_id, {rnd('1 - count(case when gray < 5 or gray > 252 then 1 end) / count(*)')} as exposure from gray_pixels group by 1", "gray_pixels"))
def _a15(spark, sf):
    return rounded(rs.exposure_score(load(spark, sf, "gray_pixels")))


def _mosaic_poses(spark, sf):
    """The nadir cameras with intrinsics of a 64 x 64 sensor."""
    k = {"fx": F.lit(64.0), "fy": F.lit(64.0), "cx": F.lit(32.0), "cy": F.lit(32.0), "width": F.lit(64), "height": F.lit(64)}
    return load(spark, sf, "poses").withColumns(k)


_CANVAS = "select session_id, min(-tx) - 30.0 as x_min, max(-tx) + 31.0 as x_max, min(ty) - 30.0 as y_min, max(ty) + 31.0 as y_max, 1.5::double as z_ref from poses group by 1"


@query("O4_orthomosaic", check_sql(
    """select session_id, row, col, cast(floor(avg(g) + 1e-9) as int) as gray, count(*) as coverage from (
        select session_id, t.image_id, t.row, t.col, sum(w * coalesce(gray, 0)) as g from (
          select h.session_id, h.image_id, h.row, h.col, h.fv + dv as v, h.fu + du as u, (1 - abs(pv - h.fv - dv)) * (1 - abs(pu - h.fu - du)) as w
          from h, (values (0), (1)) a(dv), (values (0), (1)) b(du)) t
        left join gray_pixels p on p.image_id = t.image_id and p.row = t.v and p.col = t.u where w > 0 group by 1, 2, 3, 4) o group by 1, 2, 3""",
    "poses", "gray_pixels", cv=_CANVAS,
    h="""select *, cast(floor(pv) as bigint) as fv, cast(floor(pu) as bigint) as fu from (
        select c.session_id, p.image_id, r.i as row, k.i as col, 64 * (c.x_min + k.i * 1.0::double + p.tx) / (60 - z_ref) + 32 as pu,
          64 * (p.ty - (c.y_max - r.i * 1.0::double)) / (60 - z_ref) + 32 as pv
        from cv c join poses p on p.session_id = c.session_id, range(400) r(i), range(400) k(i)
        where k.i < greatest(1, ceil(x_max - x_min)) and r.i < greatest(1, ceil(y_max - y_min)))
        where round_even(pu, 0) between 0 and 63 and round_even(pv, 0) between 0 and 63"""))
def _o4(spark, sf):
    poses = _mosaic_poses(spark, sf)
    canvas = poses.groupBy("session_id").agg(
        (F.min(-F.col("tx")) - 30.0).alias("x_min"), (F.max(-F.col("tx")) + 31.0).alias("x_max"),
        (F.min("ty") - 30.0).alias("y_min"), (F.max("ty") + 31.0).alias("y_max"), F.lit(1.5).alias("z_ref"))
    return rs.orthomosaic(poses, load(spark, sf, "gray_pixels"), canvas, 1.0)


@query("C15_ground_plane_pixel", check_sql(
    f"select image_id, {rnd('100 * (10.5 + tx) / (60 - 1.5) + 50')} as pu, {rnd('100 * (ty - 20.25) / (60 - 1.5) + 50')} as pv, "
    f"{rnd('(10.5 - (-50.0)) / 0.2::double')} as ortho_col, {rnd('(150.0 - 20.25) / 0.2::double')} as ortho_row from poses", "poses"))
def _c15(spark, sf):
    from skymill.functions.camera import project

    df = load(spark, sf, "poses").withColumns({"wx": F.lit(10.5), "wy": F.lit(20.25), "wz": F.lit(1.5)})
    df = project(df, ("wx", "wy", "wz"), 1e-6)
    ortho_col, ortho_row = (F.col("wx") - F.lit(-50.0)) / 0.2, (F.lit(150.0) - F.col("wy")) / 0.2
    return rounded(df.select("image_id", "pu", "pv", ortho_col.alias("ortho_col"), ortho_row.alias("ortho_row")))
