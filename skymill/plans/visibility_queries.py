"""Registered queries on visibility and best views."""

from __future__ import annotations

from pyspark.sql import functions as F

from skymill.operators import visibility as vs
from skymill.plans.fixtures import check_sql, load
from skymill.plans.registry import query, rnd, rounded

_CAMS = "select image_id % 3 as mission_id, image_id as cam_id, -tx as cx, ty as cy, 40e0 as cz, 0.6e0 as dx, 0e0 as dy, -0.8e0 as dz from poses"
_BOX = "select box_id % 3 as mission_id, box_id, x0, x1, y0, y1, z0, z1 from boxes"
_PTS = "select mission_id, point_id, x, y, z, case when class_id = 0 then -1e0 else 0e0 end as nx, 0e0 as ny, case when class_id = 0 then 0e0 else 1e0 end as nz, class_id from points_small"
_RAYS = """select p.mission_id, p.point_id, c.cam_id, p.x + p.nx * 1e-3 as ox, p.y + p.ny * 1e-3 as oy, p.z + p.nz * 1e-3 as oz, (c.cx - p.x) / l as ux, (c.cy - p.y) / l as uy, (c.cz - p.z) / l as uz, l - 1e-3 as seg
  from pts p join cams c on c.mission_id = p.mission_id, lateral (select sqrt(pow(c.cx - p.x, 2) + pow(c.cy - p.y, 2) + pow(c.cz - p.z, 2)) as l) d
  where l <= 45 and (p.nx * (c.cx - p.x) + p.ny * (c.cy - p.y) + p.nz * (c.cz - p.z)) / l > 0.05
    and -(c.dx * (c.cx - p.x) + c.dy * (c.cy - p.y) + c.dz * (c.cz - p.z)) / l >= cos(35 * pi() / 180)"""


def _slab(a: str) -> tuple[str, str]:
    lo, hi = f"(b.{a}0 - r.o{a}) / r.u{a}", f"(b.{a}1 - r.o{a}) / r.u{a}"
    enter = f"case when r.u{a} = 0 then case when r.o{a} < b.{a}0 or r.o{a} > b.{a}1 then 'inf'::double else '-inf'::double end else least({lo}, {hi}) end"
    leave = f"case when r.u{a} = 0 then case when r.o{a} < b.{a}0 or r.o{a} > b.{a}1 then '-inf'::double else 'inf'::double end else greatest({lo}, {hi}) end"
    return enter, leave


_E = ", ".join(_slab(a)[0] for a in "xyz")
_L = ", ".join(_slab(a)[1] for a in "xyz")
_HID = f"select distinct r.mission_id, r.point_id, r.cam_id from rays r join bx b on b.mission_id = r.mission_id where least({_L}) >= greatest({_E}) and least({_L}) > 1e-6 and greatest({_E}) < r.seg - 1e-2"
_VIS = "select p.mission_id, p.point_id, p.class_id, exists (select 1 from rays r where r.mission_id = p.mission_id and r.point_id = p.point_id and not exists (select 1 from hid h where h.mission_id = r.mission_id and h.point_id = r.point_id and h.cam_id = r.cam_id)) as visible from pts p"


def _visible(spark, sf):
    p = load(spark, sf, "points_small")
    wall = F.col("class_id") == 0
    pts = p.select("mission_id", "point_id", "x", "y", "z", F.when(wall, -1.0).otherwise(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.when(wall, 0.0).otherwise(1.0).alias("nz"), "class_id")
    cams = load(spark, sf, "poses").select((F.col("image_id") % 3).alias("mission_id"), F.col("image_id").alias("cam_id"), (-F.col("tx")).alias("cx"), F.col("ty").alias("cy"), F.lit(40.0).alias("cz"),
                                           F.lit(0.6).alias("dx"), F.lit(0.0).alias("dy"), F.lit(-0.8).alias("dz"))
    boxes = load(spark, sf, "boxes").withColumn("mission_id", F.col("box_id") % 3)
    return vs.visible_points(pts, cams, boxes, 35.0, 45.0, 10.0)


_VN = ("points_small", "poses", "boxes")
_VX = {"pts": _PTS, "cams": _CAMS, "bx": _BOX, "rays": _RAYS, "hid": _HID, "vis": _VIS}


@query("J9_visibility", check_sql("select mission_id, point_id, visible from vis", *_VN, **_VX))
def _j9(spark, sf):
    return _visible(spark, sf).select("mission_id", "point_id", "visible")


@query("A8_coverage_by_label", check_sql(f"select class_id as label, {rnd('100.0 * count(case when visible then 1 end) / count(*)', 5)} as coverage_pct, count(*) as n_points from vis group by rollup (class_id)", *_VN, **_VX))
def _a8(spark, sf):
    return rounded(vs.coverage_by_label(_visible(spark, sf).withColumnRenamed("class_id", "label")), 5)


@query("J10_ray_box_entry", check_sql(
    f"""select r.rid, b.box_id, {rnd(f"case when least({_L}) >= greatest({_E}) and least({_L}) > 1e-6 then greatest({_E}) end", 5)} as t_enter
        from (select p.image_id as rid, -p.tx + 0.5 as ox, p.ty + 0.25 as oy, 40e0 as oz, 0.6e0 as ux, 0e0 as uy, -0.8e0 as uz from poses p) r
        join boxes b on cast(floor(r.oy / 20) as bigint) = cast(floor(b.y0 / 20) as bigint)""", "poses", "boxes"))
def _j10(spark, sf):
    r = load(spark, sf, "poses").select(F.col("image_id").alias("rid"), (-F.col("tx") + 0.5).alias("ox"), (F.col("ty") + 0.25).alias("oy"))
    b = load(spark, sf, "boxes").withColumn("_band", F.floor(F.col("y0") / 20))
    df = r.withColumn("_band", F.floor(F.col("oy") / 20)).join(b, "_band")
    t = vs.slab_entry([F.col("ox"), F.col("oy"), F.lit(40.0)], [F.lit(0.6), F.lit(0.0), F.lit(-0.8)], [(F.col(f"{c}0"), F.col(f"{c}1")) for c in "xyz"])
    return rounded(df.select("rid", "box_id", t.alias("t_enter")), 5)


_FG = """select f.face_id, f.session_id, a.x as x0, a.y as y0, a.z as z0, b.x as x1, b.y as y1, b.z as z1, c.x as x2, c.y as y2, c.z as z2,
  (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) as nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) as ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) as nz
  from faces f join vertices a on a.vertex_id = f.v0 join vertices b on b.vertex_id = f.v1 join vertices c on c.vertex_id = f.v2"""
_CD = """select g.*, p.image_id, (x0 + x1 + x2) / 3 as mx, (y0 + y1 + y2) / 3 as my, (z0 + z1 + z2) / 3 as mz, -p.tx as kx, p.ty as ky, p.tz as kz,
  100 * (x0 + p.tx) / (60 - z0) + 50 as pu0, 100 * (p.ty - y0) / (60 - z0) + 50 as pv0, 100 * (x1 + p.tx) / (60 - z1) + 50 as pu1, 100 * (p.ty - y1) / (60 - z1) + 50 as pv1,
  100 * (x2 + p.tx) / (60 - z2) + 50 as pu2, 100 * (p.ty - y2) / (60 - z2) + 50 as pv2 from g join poses p on p.session_id = g.session_id"""
_SC = """select *, round(co / (1 + 0.05 * dist), 9) as score from (select *, (nx * (kx - mx) + ny * (ky - my) + nz * (kz - mz)) / dist / case when nx = 0 and ny = 0 and nz = 0 then 1e-6 else sqrt(nx * nx + ny * ny + nz * nz) end as co
  from (select *, sqrt(pow(kx - mx, 2) + pow(ky - my, 2) + pow(kz - mz, 2)) as dist from cd
    where pu0 >= 0 and pu0 < 100 and pu1 >= 0 and pu1 < 100 and pu2 >= 0 and pu2 < 100 and pv0 >= 0 and pv0 < 100 and pv1 >= 0 and pv1 < 100 and pv2 >= 0 and pv2 < 100)) where co > cos(75 * pi() / 180)
  qualify row_number() over (partition by face_id order by score desc, image_id) = 1"""
_BEST = """select f.session_id, f.face_id, coalesce(s.image_id, -1) as image_id, s.score, coalesce(pu0 / 100, 0) as tu0, coalesce(1 - pv0 / 100, 0) as tv0, coalesce(pu1 / 100, 0) as tu1,
  coalesce(1 - pv1 / 100, 0) as tv1, coalesce(pu2 / 100, 0) as tu2, coalesce(1 - pv2 / 100, 0) as tv2 from faces f left join sc s using (face_id)"""
_BX = {"g": _FG, "cd": _CD, "sc": _SC, "best": _BEST}


def _best(spark, sf):
    return vs.best_camera_per_face(load(spark, sf, "faces"), load(spark, sf, "vertices"), load(spark, sf, "poses"))


@query("J11_best_camera", check_sql(f"select session_id, face_id, image_id, {rnd('score')} as score, " + ", ".join(rnd(f"t{a}{i}") + f" as t{a}{i}" for i in range(3) for a in "uv") + " from best",
                                    "faces", "vertices", "poses", **_BX))
def _j11(spark, sf):
    return rounded(_best(spark, sf))


@query("A25_dominant_camera", check_sql("select session_id, image_id, n as n_faces from (select session_id, image_id, count(*) as n from best where image_id >= 0 group by 1, 2) qualify row_number() over (partition by session_id order by n desc, image_id) = 1",
                                        "faces", "vertices", "poses", **_BX))
def _a25(spark, sf):
    return vs.dominant_camera(_best(spark, sf))


@query("J13_structure_evidence", check_sql(
    f"""select mission_id, cluster_id, count(*) as n_frames, cast(sum(n) as bigint) as n_observations, arg_max(image_id, n * 1000000 - image_id) as best_frame, {rnd('sum(a) / sum(n)', 4)} as mean_view_angle_deg
       from (select t.mission_id, cast(floor(t.x / 25) as bigint) as cluster_id, o.image_id, count(*) as n, sum(atan2(sqrt(pow(t.x + p.tx, 2) + pow(p.ty - t.y, 2)), 60 - t.z) * 180 / pi()) as a
         from observations o join track_points t using (point_id) join poses p on p.image_id = o.image_id group by 1, 2, 3) group by 1, 2""", "observations", "track_points", "poses"))
def _j13(spark, sf):
    inst = load(spark, sf, "track_points").withColumn("cluster_id", F.floor(F.col("x") / 25))
    return rounded(vs.structure_evidence(inst, load(spark, sf, "observations"), load(spark, sf, "poses").drop("session_id", "name")), 4)


