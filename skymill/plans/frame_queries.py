"""Registered queries on frame selection and fused trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from skymill.operators import frames as fr
from skymill.operators import telemetry as tm
from skymill.operators import trajectory as tj
from skymill.plans.fixtures import check_sql, load
from skymill.plans.registry import query, rnd, rounded
from skymill.plans.telemetry_queries import TEST_CHUNK_S, _synced


@query("F1_sample_at_rate", check_sql(
    f"select session_id, frame_idx, {rnd('frame_idx / fps')} as timestamp_s from (select session_id, frame_idx, (session_id % 4 + 1) * 7.5::double as fps from frames) "
    "where frame_idx % greatest(1, cast(round_even(fps / 2, 0) as bigint)) = 0", "frames"))
def _f1(spark, sf):
    f = load(spark, sf, "frames").withColumn("fps", (F.col("session_id") % 4 + 1) * 7.5)
    return rounded(fr.sample_at_rate(f).select("session_id", "frame_idx", "timestamp_s"))


@query("F3_blur_gate", check_sql("select session_id, frame_idx, case when blur_score < 100 then 'blurry' end as drop_reason from frame_hashes", "frame_hashes"))
def _f3(spark, sf):
    return load(spark, sf, "frame_hashes").select("session_id", "frame_idx", fr.blur_gate().alias("drop_reason"))


@query("F4_keyframe_gate", check_sql(
    "select session_id, frame_idx, case when sharpness < 50 then 'blur_detected' when exposure < 0.40::double then 'poor_exposure' end as gate from frame_metrics", "frame_metrics"))
def _f4(spark, sf):
    return load(spark, sf, "frame_metrics").select("session_id", "frame_idx", fr.keyframe_gate().alias("gate"))


@query("A26_motion_blur", check_sql(
    f"select session_id, {rnd('avg(sharpness)', 5)} as blur_score, {rnd('least(100, greatest(0, (1 - least(avg(sharpness) / 150, 1)) * 25))', 5)} as motion_blur_pct from frame_metrics group by 1", "frame_metrics"))
def _a26(spark, sf):
    return rounded(fr.motion_blur_pct(load(spark, sf, "frame_metrics"), digits=9), 5)


_PAIRS = "select x.session_id, x.frame_idx as a, y.frame_idx as b from first x join first y on x.session_id = y.session_id and x.frame_idx < y.frame_idx and bit_count(xor(x.phash, y.phash)) <= 5"
_FIRST = "select session_id, phash, min(frame_idx) as frame_idx from frame_hashes group by 1, 2"


@query("W8_duplicate_pairs", check_sql("select session_id, a, b from pr", "frame_hashes", first=_FIRST, pr=_PAIRS))
def _w8p(spark, sf):
    first = load(spark, sf, "frame_hashes").groupBy("session_id", "phash").agg(F.min("frame_idx").alias("frame_idx"))
    return fr.hash_pairs(first, 5)


def _greedy(frames: str) -> dict[str, str]:
    """Sub-queries that walk each session frame by frame: ``fin`` holds the frames kept in the end."""
    return {
        "fo": f"select session_id, frame_idx, phash, row_number() over (partition by session_id order by frame_idx) as i from {frames}",
        "st": """select session_id, cast(0 as bigint) as i, cast([] as struct(f bigint, h bigint)[]) as kept from (select distinct session_id from fo)
          union all select st.session_id, fo.i, case when len(list_filter(st.kept, lambda k: bit_count(xor(k.h, fo.phash)) <= 5)) = 0 then list_append(st.kept, {'f': fo.frame_idx, 'h': fo.phash}) else st.kept end
          from st join fo on fo.session_id = st.session_id and fo.i = st.i + 1""",
        "fin": "select session_id, unnest(kept, recursive := true) from st qualify row_number() over (partition by session_id order by i desc) = 1",
    }


@query("W8_near_duplicates", check_sql(
    """select h.session_id, h.frame_idx, k.f is not null as kept, case when k.f is null then (select min(p.f) from fin p where p.session_id = h.session_id and p.f < h.frame_idx and bit_count(xor(p.h, h.phash)) <= 5) end as duplicate_of
       from frame_hashes h left join fin k on k.session_id = h.session_id and k.f = h.frame_idx""", "frame_hashes", **_greedy("frame_hashes")))
def _w8(spark, sf):
    return fr.drop_near_duplicates(load(spark, sf, "frame_hashes").drop("blur_score")).select("session_id", "frame_idx", "kept", "duplicate_of")


@query("A13_filter_report", check_sql(
    """select h.session_id, count(*) as n_input_frames, count(k.f) as n_kept, count(*) filter (blur_score < 100) as n_dropped_blur, count(*) filter (blur_score >= 100 and k.f is null) as n_dropped_duplicate
       from frame_hashes h left join fin k on k.session_id = h.session_id and k.f = h.frame_idx group by 1""", "frame_hashes", **_greedy("frame_hashes where blur_score >= 100")))
def _a13(spark, sf):
    return fr.filter_report(fr.filter_frames(load(spark, sf, "frame_hashes"), 100.0))


@query("A13_blur_counts", check_sql(
    "select session_id, count(*) as n_input_frames, count(*) filter (blur_score < 100) as n_dropped_blur, count(*) filter (blur_score >= 100) as n_sharp from frame_hashes group by 1", "frame_hashes"))
def _a13b(spark, sf):
    r = fr.filter_report(fr.filter_frames(load(spark, sf, "frame_hashes"), 100.0))
    return r.select("session_id", "n_input_frames", "n_dropped_blur", (F.col("n_kept") + F.col("n_dropped_duplicate")).alias("n_sharp"))


@query("R9_selection_manifest")
def _r9(spark, sf):
    h = load(spark, sf, "frame_hashes")
    kept = fr.filter_frames(h, 100.0)
    times = h.select("session_id", "frame_idx", (F.col("frame_idx") * 0.5).alias("timestamp_s"))
    gaps = tm.largest_gap(kept.where("kept").select("session_id", "frame_idx"), times, 5.0, 64.0)
    return fr.selection_manifest(fr.filter_report(kept), gaps)


def keyframe_tables(spark, sf):
    """Frame metrics, and match metrics of each frame with up to three frames before it."""
    m = load(spark, sf, "frame_metrics").withColumn("sharpness", F.col("sharpness") + 40.0)
    m = m.withColumn("speed", F.when(F.col("k") % 3 == 0, F.col("k") * 4.0))
    back = m.select("session_id", "frame_idx", "k", "event_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("d"))
    back = back.where(F.col("frame_idx") >= F.col("d"))
    pairs = back.select(
        "session_id", (F.col("frame_idx") - F.col("d")).alias("prev_idx"), "frame_idx",
        (F.lit(1.0) - F.col("k") * F.col("d") / 400.0).alias("overlap"), (F.col("event_id") % 60 / 60.0).alias("parallax"), (F.col("event_id") % 40 * 1.0).alias("motion_px"))
    return m.select("session_id", "frame_idx", "timestamp_s", "sharpness", "exposure", "feature_quality", "speed"), pairs


@query("W6_select_keyframes")
def _w6(spark, sf):
    return rounded(fr.select_keyframes(*keyframe_tables(spark, sf), chunk_frames=8))


@query("W7_composite_score", check_sql(
    f"select session_id, frame_idx, {rnd('0.2 * least(1, sharpness / 500) + 0.1 * exposure + 0.2 * feature_quality + 0.2 * 0.5 + 0.15 * least(1, k / 10 / 1.5) + 0.15 * 0.9')} as score from frame_metrics", "frame_metrics"))
def _w7(spark, sf):
    m = load(spark, sf, "frame_metrics")
    s = fr.composite_score(F.col("sharpness"), F.col("exposure"), F.col("feature_quality"), F.lit(0.5), F.col("k") / 10.0, F.lit(0.9))
    return rounded(m.select("session_id", "frame_idx", s.alias("score")))


@query("W5_fused_trajectory")
def _w5(spark, sf):
    return rounded(tj.estimate_trajectory(load(spark, sf, "imu"), _synced(spark, sf), TEST_CHUNK_S))


_LOGS = {"IMU": "imu", "GPS": "gps_fixes", "BARO": "baro", "FRAME": "frames"}


@query("U1_event_union", check_sql(
    """select 'IMU' as kind, count(*) as n from imu union all select 'FRAME', count(*) from frames
       union all select 'GPS', count(*) from frames f where (select count(*) from gps_fixes g where g.session_id = f.session_id) >= 2
       union all select 'BARO', count(*) from frames f where (select count(*) from baro b where b.session_id = f.session_id) >= 2""", *_LOGS.values()))
def _u1(spark, sf):
    ev = tm.event_stream(load(spark, sf, "imu"), _synced(spark, sf))
    return ev.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
