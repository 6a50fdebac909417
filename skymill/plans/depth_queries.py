"""Registered queries on depth maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from skymill.operators import depth as dp
from skymill.plans.fixtures import check_sql, load
from skymill.plans.registry import query, rnd, rounded, settle

_FIT = """select image_id, count(*) as n_pairs, regr_slope(metric, rel) as scale_a, regr_intercept(metric, rel) as shift_b from depth_pairs group by 1 having count(*) >= 6"""
_FITR = """select f.*, sqrt(r.m) as fit_residual from ft f join (select d.image_id, avg(pow(scale_a * rel + shift_b - metric, 2)) as m from depth_pairs d join ft using (image_id) group by 1) r using (image_id)"""
_REL = "select image_id, row, col, (row + 2 * col + image_id) % 17 / 10e0 as rel from depth_maps"


def _rel(spark, sf):
    d = load(spark, sf, "depth_maps")
    return d.select("image_id", "row", "col", ((F.col("row") + 2 * F.col("col") + F.col("image_id")) % 17 / 10.0).alias("rel"))


@query("G7_depth_fit", check_sql(f"select image_id, n_pairs, {rnd('scale_a')} as scale_a, {rnd('shift_b')} as shift_b, {rnd('fit_residual')} as fit_residual from fr", "depth_pairs", ft=_FIT, fr=_FITR))
def _g7(spark, sf):
    return rounded(dp.fit_depth(load(spark, sf, "depth_pairs")))


@query("G7_correspondence_pairs", check_sql(
    f"select o.image_id, count(*) as n, {rnd('avg(d.depth)')} as mean_rel, {rnd('avg(60 - t.z)')} as mean_metric from observations o join track_points t using (point_id) "
    "join depth_maps d on d.image_id = o.image_id and d.row = round_even(o.v, 0) and d.col = round_even(o.u, 0) where 60 - t.z > 0.1 group by 1", "observations", "track_points", "depth_maps"))
def _g7p(spark, sf):
    rel = load(spark, sf, "depth_maps").withColumnRenamed("depth", "rel")
    p = dp.depth_pairs(load(spark, sf, "observations"), load(spark, sf, "track_points"), load(spark, sf, "poses"), rel)
    return rounded(p.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rel").alias("mean_rel"), F.avg("metric").alias("mean_metric")))


@query("D1_metric_depth", check_sql(
    f"select r.image_id, r.row, r.col, {rnd('case when scale_a * rel + shift_b > 11 then scale_a * rel + shift_b end')} as depth from r join ft using (image_id)", "depth_pairs", "depth_maps", ft=_FIT, r=_REL))
def _d1(spark, sf):
    return rounded(dp.metric_depth(_rel(spark, sf), dp.fit_depth(load(spark, sf, "depth_pairs")), 11.0).drop("fit_residual"))


_NB = "select p.image_id, q.image_id as other_id from poses p join poses q on q.session_id = p.session_id and q.image_id in (p.image_id + 10, p.image_id - 10)"


def _neighbours(spark, sf):
    p = load(spark, sf, "poses").select("session_id", "image_id")
    want = p.select("session_id", "image_id", F.explode(F.array(F.col("image_id") + 10, F.col("image_id") - 10)).alias("other_id"))
    return want.join(p.select("session_id", F.col("image_id").alias("other_id")), ["session_id", "other_id"]).select("image_id", "other_id")


def _cams(spark, sf):
    """Nadir cameras of 32 x 32 pixels, close enough for neighbours to overlap."""
    k = {"fx": 32.0, "fy": 32.0, "cx": 16.0, "cy": 16.0, "width": 32, "height": 32}
    return load(spark, sf, "poses").withColumns({**{n: F.lit(v) for n, v in k.items()}, "ty": F.col("ty") * 0.3})


_MOVE = """select d.image_id, d.row, d.col, n.other_id, d.depth as p2, 32 * ((d.col - 16) / 32.0::double * d.depth - a.tx + b.tx) / d.depth + 16 as u, 32 * ((d.row - 16) / 32.0::double * d.depth - 0.3 * a.ty + 0.3 * b.ty) / d.depth + 16 as v
  from depth_maps d join poses a using (image_id) join nb n using (image_id) join poses b on b.image_id = n.other_id"""
_SAMP = """select m.*, (a.depth * (1 - fu) + b.depth * fu) * (1 - fv) + (c.depth * (1 - fu) + d.depth * fu) * fv as s from (
    select *, u - floor(u) as fu, v - floor(v) as fv, case when u >= 0 and u < 31 and v >= 0 and v < 31 then cast(floor(u) as bigint) end as iu, cast(floor(v) as bigint) as iv from mv) m
  left join depth_maps a on a.image_id = m.other_id and a.row = m.iv and a.col = m.iu left join depth_maps b on b.image_id = m.other_id and b.row = m.iv and b.col = m.iu + 1
  left join depth_maps c on c.image_id = m.other_id and c.row = m.iv + 1 and c.col = m.iu left join depth_maps d on d.image_id = m.other_id and d.row = m.iv + 1 and d.col = m.iu + 1"""
_PAIR = "select image_id, row, col, other_id, case when s > 1e-3 then abs(p2 - s) / s else 1 end as rel_error, coalesce(s > 1e-3 and abs(p2 - s) / s <= 0.02, false) as is_consistent from sp"
_CONF = """select image_id, row, col, nc as n_consistent, nc >= 1 as is_consistent, least(1, greatest(0, sc / k)) as weight from (select image_id, row, col, count(*) filter (is_consistent) as nc, sum(case when is_consistent then exp(-(rel_error * rel_error) / (2 * 0.03 * 0.03::double)) else 0 end) as sc from pr group by 1, 2, 3)
  join (select image_id, count(*) as k from nb group by 1) using (image_id)"""
_CX = {"nb": _NB, "mv": _MOVE, "sp": _SAMP, "pr": _PAIR, "cf": _CONF}


def _pairwise(spark, sf):
    return dp.pair_consistency(load(spark, sf, "depth_maps"), _cams(spark, sf), _neighbours(spark, sf), 0.02)


def _weights(spark, sf):
    return dp.view_confidence(_pairwise(spark, sf), _neighbours(spark, sf))


@query("D2_pair_consistency", check_sql(f"select image_id, row, col, other_id, {rnd('rel_error')} as rel_error, is_consistent from pr", "depth_maps", "poses", **_CX))
def _d2(spark, sf):
    return rounded(_pairwise(spark, sf))


@query("D3_view_confidence", check_sql(f"select image_id, row, col, n_consistent, is_consistent, {rnd('weight')} as weight from cf", "depth_maps", "poses", **_CX))
def _d3(spark, sf):
    return rounded(_weights(spark, sf))


_MVS = "select image_id, row, col, depth as mvs_depth, (row + col) % 11 / 10e0 as mvs_conf from depth_maps where depth > 60.25 and image_id in (select s_suppkey from {supplier} where s_acctbal >= 1000)"
_AI = "select image_id, row, col, depth + 0.25 as ai_depth, (row * 3 + col) % 11 / 10e0 as ai_weight from depth_maps where depth < 61.75"


@query("D4_blend_depths", check_sql(
    f"""select image_id, row, col, {rnd("case when has then case when wm + wa > 1e-4 then (wm * coalesce(mvs_depth, 0) + wa * coalesce(ai_depth, 0)) / (wm + wa) end when ai_weight > 0.3 then ai_depth end")} as depth
        from (select *, least(1, greatest(0, coalesce(ai_weight, 0) * (1 - wm))) as wa from (select coalesce(m.image_id, a.image_id) as image_id, coalesce(m.row, a.row) as row, coalesce(m.col, a.col) as col, mvs_depth, ai_depth, ai_weight,
          least(1, greatest(0, coalesce(mvs_conf, 0))) as wm, h.image_id is not null as has from mvs m full join ai a on a.image_id = m.image_id and a.row = m.row and a.col = m.col
          left join hs h on h.image_id = coalesce(m.image_id, a.image_id)))""",
    "depth_maps", mvs=_MVS, ai=_AI, hs="select distinct image_id from mvs"))
def _d4(spark, sf):
    d = load(spark, sf, "depth_maps")
    rich = spark.read.parquet(f"{sf}/supplier.parquet").where(F.col("s_acctbal") >= 1000).select(F.col("s_suppkey").alias("image_id"))
    r, c = F.col("row"), F.col("col")
    mvs = d.where(F.col("depth") > 60.25).join(rich, "image_id", "left_semi").select("image_id", "row", "col", F.col("depth").alias("mvs_depth"), ((r + c) % 11 / 10.0).alias("mvs_conf"))
    ai = d.where(F.col("depth") < 61.75).select("image_id", "row", "col", (F.col("depth") + 0.25).alias("ai_depth"), ((r * 3 + c) % 11 / 10.0).alias("ai_weight"))
    return rounded(dp.blend_depths(mvs, ai))


_RANK = "(row * 7919 + col * 104729 + image_id * 1299709) % 1000003"


@query("Q4_sample_cap", check_sql(f"select image_id, row, col from depth_maps qualify row_number() over (partition by image_id order by {_RANK}, row, col) <= 200", "depth_maps"))
def _q4(spark, sf):
    return dp.sample_pixels(load(spark, sf, "depth_maps"), 200).select("image_id", "row", "col")


_DYN = "select image_id, row, col from depth_maps where row between 4 and 9 and col between 4 and 9"


def _dyn(spark, sf):
    return load(spark, sf, "depth_maps").where(F.col("row").between(4, 9) & F.col("col").between(4, 9)).select("image_id", "row", "col")


@query("D5_dense_points", check_sql(
    f"""select image_id, row, col, {rnd('(col - 16) / 32.0::double * depth - tx', 5)} as x, {rnd('-((row - 16) / 32.0::double * depth - 0.3 * ty)', 5)} as y, {rnd('tz - depth', 5)} as z, {rnd('weight')} as confidence, case when weight >= 0.8 then 'AI+MVS' else 'AI' end as source
        from (select d.*, c.weight from depth_maps d join cf c using (image_id, row, col) where c.is_consistent and not exists (select 1 from dy where dy.image_id = d.image_id and dy.row = d.row and dy.col = d.col)) join poses using (image_id)""", "depth_maps", "poses", **_CX, dy=_DYN))
def _d5(spark, sf):
    d = load(spark, sf, "depth_maps")
    out = dp.dense_points(d, _weights(spark, sf), _dyn(spark, sf), _cams(spark, sf))
    return out.select("image_id", "row", "col", settle("x", 5), settle("y", 5), settle("z", 5), settle("confidence", 6), "source")


@query("D5_rejected_counts", check_sql(
    "select d.image_id, count(*) filter (not coalesce(c.is_consistent, false) or dy.row is not null) as n_rejected from depth_maps d left join cf c using (image_id, row, col) left join dy on dy.image_id = d.image_id and dy.row = d.row and dy.col = d.col group by 1",
    "depth_maps", "poses", **_CX, dy=_DYN))
def _d5r(spark, sf):
    return dp.rejected_counts(load(spark, sf, "depth_maps"), _weights(spark, sf), _dyn(spark, sf))


@query("D6_fuse_sequence", check_sql(
    f"""select image_id, row, col, {rnd('(col - 16) / 32.0::double * dd - tx', 5)} as x, {rnd('-((row - 16) / 32.0::double * dd - 0.3 * ty)', 5)} as y, {rnd('tz - dd', 5)} as z
        from (select r.*, scale_a * rel + shift_b as dd from r join ft using (image_id) where scale_a * rel + shift_b > 0) join poses using (image_id)""",
    "depth_pairs", "depth_maps", "poses", ft=_FIT.replace(">= 6", ">= 8"), r=_REL))
def _d6(spark, sf):
    pts, _ = dp.fuse_sequence(_rel(spark, sf), load(spark, sf, "depth_pairs"), _cams(spark, sf))
    return rounded(pts, 5)
