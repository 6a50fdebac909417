"""Registered queries on labels of points, frames and objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from skymill.functions import taxonomy as tx
from skymill.operators import semantics as sm
from skymill.plans.fixtures import check_sql, load
from skymill.plans.registry import query, rnd, rounded

_SEEN = """select o.image_id, o.obs_idx, o.point_id, m.row, m.col, m.class_id from observations o
  join mask_pixels m on m.image_id = o.image_id and m.row = round_even(o.v, 0) and m.col = round_even(o.u, 0)"""
_BASE = ("observations", "mask_pixels", "track_points")
_W = """select *, greatest(0.5, least(1, 1 - 0.3 * sqrt(pow((col - 50) / 50.0::double, 2) + pow((row - 50) / 50.0::double, 2)) / sqrt(2.0::double))) as w from seen"""
_VOTES = "select point_id, class_id, round(sum(w), 9) as votes, count(*) as n from wt group by 1, 2"
_RANKED = "select *, votes / greatest(sum(votes) over (partition by point_id), 1e-6) as p, sum(n) over (partition by point_id) as n_obs, row_number() over (partition by point_id order by votes desc, class_id) as rk from vt"


def seen(spark, sf):
    return sm.observed_classes(load(spark, sf, "observations"), load(spark, sf, "mask_pixels"))


def voted(spark, sf):
    shapes = sm.mask_shapes(load(spark, sf, "mask_pixels"))
    return sm.vote_points(load(spark, sf, "track_points"), seen(spark, sf), shapes)


@query("J5_invert_tracks", check_sql("select point_id, count(*) as n_obs, min(image_id) as first_image from observations where point_id in (select point_id from track_points where z >= 5) group by 1",
                                     "observations", "track_points"))
def _j5(spark, sf):
    kept = load(spark, sf, "track_points").where(F.col("z") >= 5)
    df = sm.invert_tracks(load(spark, sf, "observations"), kept)
    return df.groupBy("point_id").agg(F.count(F.lit(1)).alias("n_obs"), F.min("image_id").alias("first_image"))


@query("J6_mask_lookup", check_sql("select image_id, obs_idx, point_id, class_id from seen", "observations", "mask_pixels", seen=_SEEN))
def _j6(spark, sf):
    return seen(spark, sf).select("image_id", "obs_idx", "point_id", "class_id")


@query("J7_observed_points", check_sql("select o.image_id, o.obs_idx, p.x, p.y, p.z from observations o join track_points p using (point_id)", "observations", "track_points"))
def _j7(spark, sf):
    df = load(spark, sf, "observations").join(load(spark, sf, "track_points"), "point_id")
    return df.select("image_id", "obs_idx", "x", "y", "z")


@query("W9_first_seen_class", check_sql("select p.mission_id, p.point_id, cast(coalesce(s.c, 7) as int) as class_id from track_points p left join "
                                        "(select point_id, arg_min(class_id, image_id * 1000000000 + obs_idx) as c from seen group by 1) s using (point_id)", *_BASE, seen=_SEEN))
def _w9(spark, sf):
    return sm.tag_first_seen(load(spark, sf, "track_points"), seen(spark, sf))


_P11 = """select t.mission_id, t.point_id, cast(coalesce(a.class_id, 7) as int) as class_id,
   coalesce(least(1, greatest(0, a.p - coalesce(b.p, 0) + 0.1 * least(a.n_obs, 5))), 0) as semantic_confidence, cast(coalesce(a.n_obs, 0) as bigint) as n_obs, coalesce(a.p, 1) as p_top
   from track_points t left join rk a on a.point_id = t.point_id and a.rk = 1 left join rk b on b.point_id = t.point_id and b.rk = 2"""


@query("P11_semantic_vote", check_sql(f"select mission_id, point_id, class_id, {rnd('semantic_confidence')} as semantic_confidence, n_obs, {rnd('p_top')} as p_top from v",
                                      *_BASE, seen=_SEEN, wt=_W, vt=_VOTES, rk=_RANKED, v=_P11))
def _p11(spark, sf):
    df = voted(spark, sf).withColumn("p_top", F.array_max("probabilities"))
    return rounded(df.drop("probabilities"))


@query("Q3_top_two_classes", check_sql(
    f"select a.point_id, cast(a.class_id as int) as first_class, {rnd('a.votes - coalesce(b.votes, 0)')} as margin from rk a left join rk b on b.point_id = a.point_id and b.rk = 2 where a.rk = 1",
    *_BASE, seen=_SEEN, wt=_W, vt=_VOTES, rk=_RANKED))
def _q3(spark, sf):
    return rounded(sm.top_two(seen(spark, sf), sm.mask_shapes(load(spark, sf, "mask_pixels"))).drop("second_class"))


@query("P12_label_fallback", check_sql(
    f"""select v.mission_id, v.point_id, cast(case when u.useful then v.class_id else coalesce(f.c, 7) end as int) as class_id, {rnd('case when u.useful then v.semantic_confidence end')} as semantic_confidence
      from v join (select mission_id, bool_or(class_id <> 7) as useful from v group by 1) u using (mission_id)
      left join (select point_id, arg_min(class_id, image_id * 1000000000 + obs_idx) as c from seen group by 1) f on f.point_id = v.point_id""",
    *_BASE, seen=_SEEN, wt=_W, vt=_VOTES, rk=_RANKED, v=_P11))
def _p12(spark, sf):
    tagged = sm.tag_first_seen(load(spark, sf, "track_points"), seen(spark, sf))
    return rounded(sm.label_points(voted(spark, sf), tagged))


_NAMES = " union all ".join(f"select {c} as class_id, '{n}' as class_name" for c, n in tx.CLASS_NAMES.items())


@query("A12_class_fractions", check_sql(
    f"select i.image_id, n.class_name, {rnd('coalesce(c.k, 0) / i.total')} as fraction from (select image_id, count(*)::double as total from mask_pixels group by 1) i, nm n "
    "left join (select image_id, class_id, count(*) as k from mask_pixels group by 1, 2) c on c.image_id = i.image_id and c.class_id = n.class_id", "mask_pixels", nm=_NAMES))
def _a12(spark, sf):
    return rounded(sm.class_fractions(load(spark, sf, "mask_pixels")))


@query("F7_dynamic_mask", check_sql("select image_id, cast(case when class_id in (4, 6) then 0 else 255 end as int) as keep, count(*) as n from mask_pixels group by 1, 2", "mask_pixels"))
def _f7(spark, sf):
    return sm.reconstruction_mask(load(spark, sf, "mask_pixels")).groupBy("image_id", "keep").agg(F.count(F.lit(1)).alias("n"))


@query("A18_semantic_stability", check_sql(f"select image_id, {rnd('greatest(0, 1 - count(case when class_id in (4, 6) then 1 end) / count(*)::double)')} as semantic_stability from mask_pixels group by 1", "mask_pixels"))
def _a18(spark, sf):
    return rounded(sm.semantic_stability(load(spark, sf, "mask_pixels")))


@query("J12_car_motion", check_sql(
    """select c.session_id, c.frame_seq, c.component_id, case when exists (select 1 from car_components p where p.session_id = c.session_id and p.frame_seq = c.frame_seq - 1
         and sqrt(pow(p.cx - c.cx, 2) + pow(p.cy - c.cy, 2)) <= 8) then 'Static car' else 'Moving car' end as class_name from car_components c""", "car_components"))
def _j12(spark, sf):
    return sm.resolve_car_motion(load(spark, sf, "car_components"))


@query("A20_object_motion", check_sql(
    """select image_id, component_id, case when dom = 6 then 'Human' else 'Vehicle' end as class_name,
         case when dom = 6 then case when flow >= 1.5 then 'MOVING' else 'UNCERTAIN' end when flow >= 3.5 then 'MOVING' when flow >= 1.5 then 'UNCERTAIN' else 'STATIC' end as motion_status,
         round_even(flow, 2) + 0.0 as displacement_px, box_x, box_y, box_w, box_h, round_even(cx, 1) + 0.0 as centroid_x, round_even(cy, 1) + 0.0 as centroid_y
       from (select image_id, component_id, count(*) as area, quantile_cont(flow_px, 0.5) as flow,
          case when count(*) filter (class_id = 4) >= greatest(count(*) filter (class_id = 5), count(*) filter (class_id = 6)) then 4
               when count(*) filter (class_id = 5) >= count(*) filter (class_id = 6) then 5 else 6 end as dom,
          min(col) as box_x, min(row) as box_y, max(col) - min(col) + 1 as box_w, max(row) - min(row) + 1 as box_h, avg(col) as cx, avg(row) as cy
        from flow_pixels group by 1, 2) where area >= 10""", "flow_pixels"))
def _a20(spark, sf):
    return rounded(sm.object_motion(load(spark, sf, "flow_pixels"), min_area=10), 2)


@query("A16_feature_quality", check_sql(
    f"""select image_id, {rnd('0.5 * least(1, sum(n) / 400.0::double) + 0.5 * count(case when n >= 5 then 1 end) / 16.0::double')} as feature_quality from (
         select image_id, least(3, floor(v / 25)) as r, least(3, floor(u / 25)) as c, count(*) as n from keypoints group by 1, 2, 3) group by 1""", "keypoints"))
def _a16(spark, sf):
    return rounded(sm.feature_quality(load(spark, sf, "keypoints"), 100.0, 100.0))


@query("A17_match_overlap", check_sql(
    f"""select pair_id, n_matches, {rnd('case when n_matches >= 8 then greatest(0, least(1, 1.5 * n_matches / k)) else 0 end')} as overlap,
         {rnd('case when n_matches >= 8 then greatest(0, least(1, d / 60)) else 0 end')} as parallax, {rnd('case when n_matches >= 8 then d else 0 end')} as motion_px
       from (select pair_id, count(*) as n_matches, quantile_cont(disp_px, 0.5) as d, max(greatest(n_prev, n_curr))::double as k from feature_matches group by 1)""", "feature_matches"))
def _a17(spark, sf):
    return rounded(sm.match_overlap(load(spark, sf, "feature_matches"), ["pair_id"]))
