"""Registered queries on neighbourhoods, clusters and instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from skymill.operators import spatial as sp
from skymill.plans.fixtures import check_sql, load
from skymill.plans.registry import query, rnd, rounded

_D = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"


def _knn_sql(k: int, include_self: bool, src: str = "points_small") -> str:
    own = "" if include_self else "where a.point_id <> b.point_id"
    return f"""select a.mission_id, a.point_id, a.x as px, a.y as py, a.z as pz, b.x, b.y, b.z, {_D} as d from {src} a join {src} b on a.mission_id = b.mission_id {own}
      qualify row_number() over (partition by a.mission_id, a.point_id order by {_D}, b.point_id) <= {k}"""


def _outlier_sql(means: str) -> str:
    return f"""select m.mission_id, m.point_id from {means} m join (select mission_id, avg(md) as mu, count(*) as n from {means} group by 1) s using (mission_id)
      join (select m.mission_id, sum(case when md > 0 then pow(md - mu, 2) end) as ss from {means} m join (select mission_id, avg(md) as mu from {means} group by 1) u using (mission_id) group by 1) v using (mission_id)
      where md > 0 and md < mu + 2 * sqrt(ss / (n - 1))"""


_MEANS = "select mission_id, point_id, avg(d) as md from nn group by 1, 2"


@query("P1_statistical_outliers", check_sql("select mission_id, point_id from kept", "points_small", nn=_knn_sql(20, True), mm=_MEANS, kept=_outlier_sql("mm")))
def _p1(spark, sf):
    return sp.remove_statistical_outliers(load(spark, sf, "points_small")).select("mission_id", "point_id")


@query("P1_mean_distances_full_cloud", check_sql(
    f"select point_id, {rnd('md')} as mean_dist from mm", "points",
    mm="select a.point_id, list_avg(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 6)) as md from points a join points b on a.mission_id = b.mission_id group by 1"))
def _p1b(spark, sf):
    p = load(spark, sf, "points")
    means = sp.mean_neighbour_distance(p, 6).select("mission_id", "x", "y", "z", "mean_dist")
    return rounded(p.join(means, ["mission_id", "x", "y", "z"]).select("point_id", "mean_dist"))


_RAD = "select a.mission_id, a.point_id from {src} a join {src} b on a.mission_id = b.mission_id and abs(a.x - b.x) <= {r} where pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= {r2} group by 1, 2 having count(*) > {n}"


@query("P2_radius_outliers", check_sql(_RAD.format(src="points", r=2.5, r2=6.25, n=4), "points"))
def _p2(spark, sf):
    return sp.remove_radius_outliers(load(spark, sf, "points"), 4, 2.5).select("mission_id", "point_id")


@query("P3_clean_cloud", check_sql(
    """select a.mission_id, a.point_id from kp a join kp b on a.mission_id = b.mission_id join rr r on r.mission_id = a.mission_id
       where pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= r.r * r.r group by 1, 2 having count(*) > 5""",
    "points_small", nn=_knn_sql(20, True), mm=_MEANS, kept=_outlier_sql("mm"),
    kp="select p.* from points_small p join kept k on k.mission_id = p.mission_id and k.point_id = p.point_id", n1=_knn_sql(1, False, "kp"),
    rr="select mission_id, 2 * quantile_cont(d, 0.5) as r from n1 group by 1"))
def _p3(spark, sf):
    return sp.clean_cloud(load(spark, sf, "points_small"), radius_filter=True, radius_nb_points=5).select("mission_id", "point_id")


#: The covariance of each point's 15 nearest, and its least direction: eigenvalues by cosines, then the longest cross product.
_NORMAL = dict(
    nn=_knn_sql(15, True),
    cv="""select mission_id, point_id, avg((x - px) * (x - px)) - avg(x - px) * avg(x - px) as a, avg((x - px) * (y - py)) - avg(x - px) * avg(y - py) as b,
        avg((x - px) * (z - pz)) - avg(x - px) * avg(z - pz) as c, avg((y - py) * (y - py)) - avg(y - py) * avg(y - py) as d,
        avg((y - py) * (z - pz)) - avg(y - py) * avg(z - pz) as e, avg((z - pz) * (z - pz)) - avg(z - pz) * avg(z - pz) as f from nn group by 1, 2""",
    pp="select *, (a + d + f) / 3 as q, sqrt((pow(a - (a + d + f) / 3, 2) + pow(d - (a + d + f) / 3, 2) + pow(f - (a + d + f) / 3, 2) + 2 * (b * b + c * c + e * e)) / 6) as p from cv",
    ev="""select *, q + 2 * p * cos(acos(greatest(-1e0, least(1e0, ((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c)) / (2 * p * p * p)))) / 3
        + 2 * pi() / 3) as l from pp""",
    cr="""select mission_id, point_id, unnest([{'n': pow(b * e - c * (d - l), 2) + pow(c * b - (a - l) * e, 2) + pow((a - l) * (d - l) - b * b, 2), 'z': abs((a - l) * (d - l) - b * b)},
        {'n': pow(b * (f - l) - c * e, 2) + pow(c * c - (a - l) * (f - l), 2) + pow((a - l) * e - b * c, 2), 'z': abs((a - l) * e - b * c)},
        {'n': pow((d - l) * (f - l) - e * e, 2) + pow(e * c - b * (f - l), 2) + pow(b * e - (d - l) * c, 2), 'z': abs(b * e - (d - l) * c)}]) as s from ev""",
)


@query("P4_normals", check_sql(f"select mission_id, point_id, {rnd('max(s.z / sqrt(s.n)) filter (s.n = m)', 4)} as abs_nz from (select *, max(s.n) over (partition by mission_id, point_id) as m from cr) group by 1, 2", "points_small", **_NORMAL))
def _p4(spark, sf):
    p = load(spark, sf, "points_small")
    return rounded(p.join(sp.normals(p), ["mission_id", "x", "y", "z"]).select("mission_id", "point_id", "abs_nz"), 4)


@query("P4_normals_cloud")
def _p4c(spark, sf):
    p = load(spark, sf, "points")
    return rounded(p.join(sp.normals(p), ["mission_id", "x", "y", "z"]).select("mission_id", "point_id", "abs_nz"))


@query("P1_statistical_outliers_cloud")
def _p1c(spark, sf):
    return sp.remove_statistical_outliers(load(spark, sf, "points")).select("mission_id", "point_id")


@query("P3_clean_cloud_whole")
def _p3c(spark, sf):
    return sp.clean_cloud(load(spark, sf, "points"), radius_filter=True, radius_nb_points=5).select("mission_id", "point_id")


@query("P5_detect_ground_cloud")
def _p5w(spark, sf):
    return sp.ground_counts(sp.detect_ground(load(spark, sf, "points"), height_m=2.0, cell_m=5.0))


_GROUND = """select s.mission_id, s.point_id, case when s.st is not null then s.st when s.z <= f.low + 0.35 then 'ground' else 'elevated' end as ground_state
  from (select c.*, floor((c.x - k.x0) / 1) as gx, floor((c.y - k.y0) / 1) as gy from cd c left join (select mission_id, min(x) as x0, min(y) as y0 from cd where st is null group by 1) k using (mission_id)) s
  left join (select c.mission_id, floor((c.x - k.x0) / 1) as gx, floor((c.y - k.y0) / 1) as gy, min(z) as low from cd c join (select mission_id, min(x) as x0, min(y) as y0 from cd where st is null group by 1) k using (mission_id)
     where st is null group by 1, 2, 3) f on f.mission_id = s.mission_id and f.gx = s.gx and f.gy = s.gy"""
_CD = "select *, case when class_id in (0, 2, 4, 6) then 'semantic' when (point_id % 101) / 100e0 < 0.70 then 'vertical' end as st from points"


def _given_normals(spark, sf):
    return sp.classify_ground(load(spark, sf, "points").withColumn("abs_nz", (F.col("point_id") % 101) / 100.0))


@query("P5_ground_given_normals", check_sql("select mission_id, point_id, ground_state from g", "points", cd=_CD, g=_GROUND))
def _p5(spark, sf):
    return _given_normals(spark, sf).select("mission_id", "point_id", "ground_state")


@query("P5_ground_counts", check_sql(
    "select mission_id, count(*) filter (ground_state = 'ground') as n_ground_points, count(*) filter (ground_state = 'semantic') as n_rejected_semantic, "
    "count(*) filter (ground_state = 'vertical') as n_rejected_vertical, count(*) filter (ground_state = 'elevated') as n_rejected_elevated from g group by 1", "points", cd=_CD, g=_GROUND))
def _p5c(spark, sf):
    return sp.ground_counts(_given_normals(spark, sf))


@query("P5_detect_ground")
def _p5d(spark, sf):
    return sp.ground_counts(sp.detect_ground(load(spark, sf, "points_small"), height_m=2.0, cell_m=5.0))


_NEAR = "select a.mission_id, a.point_id as a, b.point_id as b from points_small a join points_small b on a.mission_id = b.mission_id where pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= {r2}"


@query("P6_dbscan", check_sql(
    """select p.mission_id, p.point_id, cast(coalesce(r.rk, -1) as int) as cluster_id from points_small p left join
        (select point_id, min(root) as root from (select a as point_id, root from reach where a in (select id from core) union all
            select e.a, c.root from e join (select a, root from reach) c on c.a = e.b where e.a not in (select id from core)) group by 1) l on l.point_id = p.point_id
        left join (select mission_id, root, row_number() over (partition by mission_id order by root) - 1 as rk from (select distinct mission_id, root from reach)) r on r.root = l.root""",
    "points_small", e=_NEAR.format(r2=5.5 * 5.5), core="select a as id from e group by 1 having count(*) >= 8",
    ce="select mission_id, a, b from e where a in (select id from core) and b in (select id from core)",
    walk="select mission_id, a, b from ce union select w.mission_id, w.a, c.b from walk w join ce c on c.a = w.b",
    reach="select mission_id, a, min(b) as root from walk group by 1, 2"))
def _p6(spark, sf):
    return sp.dbscan(load(spark, sf, "points_small"), 5.5, 8).select("mission_id", "point_id", "cluster_id")


@query("P6_building_clusters")
def _p6b(spark, sf):
    out = sp.building_clusters(load(spark, sf, "points"), 3.0, 8)
    return out.groupBy("mission_id", "cluster_id").agg(F.count(F.lit(1)).alias("n_points"), F.min("point_id").alias("first_point"))


def _instances_sql(area: str, join: str = "") -> str:
    return f"""select mission_id, cluster_id, cast(cluster_id + 1 as int) as instance_id, n as point_count, {rnd('ax', 5)} as centroid_x, {rnd('ay', 5)} as centroid_y, {rnd('az', 5)} as centroid_z,
         {rnd('x0', 5)} as min_x, {rnd('y0', 5)} as min_y, {rnd('z0', 5)} as min_z, {rnd('x1', 5)} as max_x, {rnd('y1', 5)} as max_y, {rnd('z1', 5)} as max_z,
         {rnd(area, 5)} as footprint_area_m2, {rnd('p5', 5)} as base_elevation_m, {rnd('p95', 5)} as peak_elevation_m,
         {rnd('greatest(0.1, p95 - p5)', 5)} as height_m, {rnd('greatest(0.1, z1 - p5)', 5)} as max_height_m, {rnd('greatest(0.1, roof - p5)', 5)} as mean_height_m,
         {rnd(f'{area} * greatest(0.1, roof - p5)', 5)} as volume_m3, {rnd('mc', 5)} as mean_confidence
       from (select mission_id, cluster_id, count(*) as n, avg(x) as ax, avg(y) as ay, avg(z) as az, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1,
           max(p5) as p5, max(p95) as p95, avg(case when z >= p50 then z end) as roof, avg(confidence) as mc
         from instance_points join (select mission_id, cluster_id, quantile_cont(z, 0.05) as p5, quantile_cont(z, 0.5) as p50, quantile_cont(z, 0.95) as p95 from instance_points group by 1, 2) q using (mission_id, cluster_id)
         group by 1, 2) i {join} where n >= 20"""


#: Sub-queries that walk around each cluster, always to the position that turns least: ``hull`` holds the enclosed areas.
_HULL = {
    "hp": "select distinct mission_id, cluster_id, x, y from instance_points",
    "round": """select mission_id, cluster_id, x0, y0, x0 as x, y0 as y, 0e0 as turn, 0e0 as twice from (select mission_id, cluster_id, arg_min(x, (y, x)) as x0, min(y) as y0 from hp group by 1, 2) s
      union all select mission_id, cluster_id, x0, y0, nx, ny, nt, (x - x0) * (ny - y0) - (y - y0) * (nx - x0) from (
        select w.*, p.x as nx, p.y as ny, atan2(p.y - w.y, p.x - w.x) + case when atan2(p.y - w.y, p.x - w.x) < 0 then 2 * pi() else 0 end as nt,
          row_number() over (partition by w.mission_id, w.cluster_id order by nt, pow(p.x - w.x, 2) + pow(p.y - w.y, 2) desc) as rk
        from round w join hp p on p.mission_id = w.mission_id and p.cluster_id = w.cluster_id and (p.x <> w.x or p.y <> w.y)
        where (w.turn = 0 or w.x <> w.x0 or w.y <> w.y0) and nt >= w.turn - 1e-12) t where rk = 1""",
    "hull": """select mission_id, cluster_id, case when n < 3 then 1 when a <= 1e-12 then greatest(0.5, w) * greatest(0.5, h) else a end as area
      from (select mission_id, cluster_id, sum(twice) / 2 as a from round group by 1, 2) r
      join (select mission_id, cluster_id, count(*) as n, round(max(x), 3) - round(min(x), 3) as w, round(max(y), 3) - round(min(y), 3) as h from hp group by 1, 2) s using (mission_id, cluster_id)""",
}


@query("P7_instance_metrics", check_sql(_instances_sql("(x1 - x0) * (y1 - y0)"), "instance_points"))
def _p7(spark, sf):
    p = load(spark, sf, "instance_points")
    area = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    return rounded(sp.instance_metrics(p, p.groupBy("mission_id", "cluster_id").agg(area.alias("footprint_area_m2")), digits=(8, 8)), 5)


@query("P7_instances_with_hulls", check_sql(_instances_sql("area", "join hull using (mission_id, cluster_id)"), "instance_points", **_HULL))
def _p7h(spark, sf):
    p = load(spark, sf, "instance_points")
    return rounded(sp.instance_metrics(p, sp.footprint_area(p), digits=(8, 8)), 5)


@query("P8_footprint_area", check_sql(f"select mission_id, cluster_id, {rnd('area')} as footprint_area_m2 from hull", "instance_points", **_HULL))
def _p8(spark, sf):
    return rounded(sp.footprint_area(load(spark, sf, "instance_points")))


@query("P13_nearest_point", check_sql(
    f"select mission_id, point_id, {rnd('d')} as distance_m from (select mission_id, point_id, sqrt(pow(x - 50, 2) + pow(y - 50, 2) + pow(z - 5, 2)) as d from points where class_id in (0, 1, 2)) "
    "qualify row_number() over (partition by mission_id order by round(d, 9), point_id) = 1", "points"))
def _p13(spark, sf):
    return rounded(sp.nearest_point(load(spark, sf, "points"), 50.0, 50.0, 5.0, [0, 1, 2]))
