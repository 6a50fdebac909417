"""Input tables for the registered queries, derived from the generic test tables.

One text per table, valid in both engines; only the tokens below differ. ``{name}`` of a base table
becomes a parquet path for Spark and a view name for the checking engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def _emb(i: int) -> str:
    return "{E:%d}" % i


# 64 sign bits of every fourth vector; the three after it repeat them with one bit changed each
_HASH_BITS = "\n + ".join(
    f"(case when ({_emb(i + 1)} > 0) <> (fid % 4 > 0 and fid % 61 = {i}) then {2**i if i < 63 else '(-9223372036854775807 - 1)'} else 0 end)"
    for i in range(64)
)

FIXTURES: dict[str, str] = {
    "frames": """
        select user_id as session_id,
               cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as frame_idx,
               {US} / 1e12 as timestamp_s,
               concat('f', cast(event_id as varchar(20)), '.jpg') as image_filename
        from {events} where event_type = 'view'""",
    "gps_fixes": """
        select user_id as session_id, event_id as seq, {US} / 1e12 as timestamp_s,
               47.38e0 + value * 1e-5 as lat, 8.54e0 + {K} * 1e-5 as lon, 460e0 + {K} / 1e1 as alt_m,
               1e0 + {K} / 5e1 as horizontal_accuracy_m
        from {events} where event_type = 'click'""",
    "imu": """
        select user_id as session_id, event_id as seq, {US} / 1e12 as timestamp_s,
               ({K} - 50) / 1e2 as ax, value / 5e2 as ay, 9.80665e0 + ({K} - 50) / 5e2 as az,
               ({K} - 50) / 5e3 as gx, 0e0 as gy, value / 5e4 as gz
        from {events} where event_type = 'purchase'""",
    "baro": """
        select user_id as session_id, event_id as seq, {US} / 1e12 as timestamp_s,
               960e0 - {K} / 1e1 as pressure_hpa, 460e0 + value / 1e2 as altitude_m
        from {events} where event_type = 'signup'""",
    "trajectory_pairs": """
        select user_id as session_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as seq,
               {K} * 1e0 as gt_e, value as gt_n, 10e0 + {K} / 1e1 as gt_u,
               {K} * 1e0 + (event_id % 7 - 3) * 0.25e0 as est_e,
               value + (event_id % 5 - 2) * 0.5e0 as est_n,
               10e0 + {K} / 1e1 + (event_id % 3 - 1) * 1e0 as est_u
        from {events} where event_type = 'error'""",
    "frame_metrics": """
        select user_id as session_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as frame_idx,
               {US} / 1e12 as timestamp_s,
               value * 3e0 as sharpness, 1e0 - {K} / 1.2e2 as exposure, {K} / 1e2 as feature_quality,
               {K} as k, event_id
        from {events} where event_type = 'view'""",
    "points": """
        select l_suppkey % 10 as mission_id,
               l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber as point_id,
               l_extendedprice / 1e3 as x, l_quantity * 2e0 + (l_partkey % 100) / 1e2 as y,
               l_discount * 1e2 + l_tax * 5e1 + (l_orderkey % 10) / 1e1 as z,
               cast(l_partkey % 256 as int) as r, cast(l_suppkey % 256 as int) as g, cast(l_orderkey % 256 as int) as b,
               cast((l_linenumber + l_partkey) % 8 as int) as class_id,
               1e0 + (l_partkey % 9) as track_len,
               l_tax * 25e0 + (l_orderkey % 20) / 2e1 as reproj_err
        from {lineitem}""",
    "points_small": """
        select vec_id % 3 as mission_id, vec_id as point_id,
               {E:1} * 1e2 as x, {E:2} * 1e2 as y, ({E:3} + 0.5e0) * 20e0 as z,
               cast(label % 8 as int) as class_id, 1e0 + floor(abs({E:4}) * 40e0) as track_len,
               abs({E:5}) * 1e1 as reproj_err
        from {embeddings}""",
    "scored_points": """
        select l_suppkey % 10 as mission_id,
               l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber as point_id,
               l_discount * 1e2 as z, cast((l_linenumber + l_partkey) % 8 as int) as class_id,
               (l_partkey % 101) / 1e2 as confidence,
               l_tax * 25e0 + (l_orderkey % 20) / 2e1 as reproj_err, 1e0 + (l_partkey % 9) as track_len,
               case when l_partkey % 3 = 0 then null else (l_orderkey % 101) / 1e2 end as depth_c,
               case when l_partkey % 5 = 0 then null else l_quantity / 1e1 end as sensor_res_m,
               case when l_partkey % 7 = 0 then null else (l_suppkey % 101) / 1e2 end as semantic_c
        from {lineitem}""",
    "observations": """
        select l_suppkey as image_id,
               cast(row_number() over (partition by l_suppkey order by l_orderkey, l_partkey, l_linenumber) - 1 as bigint) as obs_idx,
               l_quantity * 2e0 - 0.5e0 as u, l_extendedprice / 1.05e3 as v, l_partkey as point_id
        from {lineitem}""",
    "track_points": """
        select p_partkey as point_id, p_partkey % 10 as mission_id,
               (p_partkey % 211) * 0.5e0 as x, (p_partkey % 199) * 0.5e0 as y, p_size * 0.2e0 as z
        from {part}""",
    "mask_pixels": """
        select s.s_suppkey as image_id, a.i as row, b.i as col,
               cast((s.s_suppkey + cast(floor(a.i / 1e1) as bigint) + cast(floor(b.i / 1e1) as bigint)) % 8 as int) as class_id
        from {supplier} s, {SEQ:100:a} , {SEQ:100:b}
        where s.s_acctbal >= 0""",
    "poses": """
        select s_suppkey as image_id, s_suppkey % 10 as session_id,
               concat('f', cast(s_suppkey as varchar(20)), '.jpg') as name,
               1e0 as r00, 0e0 as r01, 0e0 as r02, 0e0 as r10, -1e0 as r11, 0e0 as r12,
               0e0 as r20, 0e0 as r21, -1e0 as r22,
               -(s_suppkey % 10) * 10e0 as tx,
               (cast(floor(s_suppkey / 1e1) as bigint) % 10) * 10e0 as ty, 60e0 as tz,
               100e0 as fx, 100e0 as fy, 50e0 as cx, 50e0 as cy, 100 as width, 100 as height
        from {supplier}""",
    "depth_pairs": """
        select l_suppkey as image_id, l_discount + l_tax as rel,
               10e0 + 3e0 * (l_discount + l_tax) + (l_linenumber - 4) / 1e1 as metric
        from {lineitem}""",
    "depth_maps": """
        select s.s_suppkey as image_id, a.i as row, b.i as col,
               60e0 + ((a.i + b.i + s.s_suppkey) % 5) * 0.5e0 as depth
        from {supplier} s, {SEQ:32:a}, {SEQ:32:b}""",
    "gray_pixels": """
        select s.s_suppkey as image_id, a.i as row, b.i as col,
               cast((a.i * a.i + 3 * b.i + 17 * s.s_suppkey) % 256 as int) as gray
        from {supplier} s, {SEQ:64:a}, {SEQ:64:b}""",
    "frame_hashes": f"""
        select cast(floor(fid / 4e0) as bigint) % 3 as session_id, fid as frame_idx,
               cast({_HASH_BITS} as bigint) as phash,
               60e0 + abs({_emb(20)}) * 600e0 as blur_score
        from (select f.vec_id as fid, b.embedding from {{embeddings}} f join {{embeddings}} b on b.vec_id = f.vec_id - f.vec_id % 4) as paired""",
    "boxes": """
        select n_nationkey as box_id, (n_nationkey % 5) * 20e0 + 6e0 as x0, (n_nationkey % 5) * 20e0 + 14e0 as x1,
               cast(floor(n_nationkey / 5e0) as bigint) * 20e0 + 6e0 as y0,
               cast(floor(n_nationkey / 5e0) as bigint) * 20e0 + 14e0 as y1,
               0e0 as z0, 6e0 + (n_nationkey % 7) * 3e0 as z1
        from {nation}""",
    "missions": """
        select n_nationkey as mission_id, n_name as name, n_nationkey % 5 = 0 as is_demo,
               n_regionkey * 1000 + n_nationkey as modified_time, n_nationkey % 3 <> 0 as has_report
        from {nation}""",
    "mission_inputs": """
        select c_custkey as mission_id,
               c_acctbal >= 0 as has_video, cast(1280 + (c_custkey % 4) * 960 as int) as width,
               cast(720 + (c_custkey % 4) * 540 as int) as height,
               cast(c_custkey % 83 as int) as gps_fixes, c_acctbal / 5e1 as sharpness,
               concat(c_name, case when c_nationkey % 2 = 0 then '_IMU.csv' else '.csv' end) as log_name
        from {customer}""",
    "keypoints": """
        select l_suppkey as image_id, l_quantity * 2e0 as u, l_extendedprice / 1.05e3 as v
        from {lineitem}""",
    "feature_matches": """
        select user_id as session_id, cast(floor(event_id / 40e0) as bigint) as pair_id,
               value as disp_px, {K} + 60 as n_prev, {K} + 55 as n_curr
        from {events}""",
    "flow_pixels": """
        select l_suppkey as image_id, cast(l_partkey % 40 as bigint) as component_id,
               cast(l_quantity as bigint) as col, cast(floor(l_extendedprice / 1e3) as bigint) as row,
               cast(4 + (l_linenumber + l_partkey % 40) % 3 as int) as class_id,
               l_discount * 50e0 + l_tax * 1e1 as flow_px
        from {lineitem}""",
    "car_components": """
        select l_suppkey as session_id, l_linenumber as frame_seq, l_orderkey * 100000 + l_partkey as component_id,
               l_quantity * 2e0 as cx, l_extendedprice / 1.05e3 as cy
        from {lineitem}""",
    "instance_points": """
        select l_suppkey % 10 as mission_id, l_linenumber as cluster_id,
               l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber as point_id,
               l_extendedprice / 1e3 as x, l_quantity * 2e0 + (l_partkey % 100) / 1e2 as y,
               l_discount * 1e2 + l_tax * 5e1 + (l_orderkey % 10) / 1e1 as z,
               case when l_partkey % 9 >= 4 then 0.9e0 when l_partkey % 9 >= 2 then 0.6e0 else 0.3e0 end as confidence
        from {lineitem}""",
    "vertices": """
        select p_partkey as vertex_id, (p_partkey % 97) * 1e0 as x,
               cast(floor(p_partkey / 97e0) as bigint) % 101 * 1e0 as y, p_size / 1e1 as z
        from {part}""",
    "faces": """
        select o_orderkey as face_id, o_orderkey % 10 as session_id,
               o_custkey as v0, o_custkey + 1 as v1, o_custkey + 98 as v2
        from {orders}""",
    "views": """
        select l_suppkey as image_id, l_suppkey % 10 as session_id, l_partkey as point_id, l_orderkey as seq
        from {lineitem}""",
}


def _to_spark(text: str, sf_dir: str, ntz: bool, parts: int) -> str:
    us = (
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)"
        if ntz
        else "(unix_micros(ts) - 1704067200000000)"
    )
    text = text.replace("{US}", us).replace("{K}", "cast(get_json_object(props, '$.k') as int)")
    text = re.sub(r"\{E:(\d+)\}", r"cast(element_at(embedding, \1) as double)", text)
    if "{SEQ:" in text:
        # Few images become many pixels: deal the images out first. Crossed with ranges, the table also has its true size for
        # the planner; an exploded sequence would count as small as the images and be broadcast.
        text = text.replace("{supplier}", f"(select /*+ repartition({parts}, s_suppkey) */ * from {{supplier}})")
        text = re.sub(r"\{SEQ:(\d+):(\w)\}", r"range(\1) as \2(i)", text)
    return re.sub(r"\{(%s)\}" % "|".join(BASE_TABLES), rf"parquet.`{sf_dir}/\1.parquet`", text)


def _to_check(text: str) -> str:
    text = text.replace("{US}", "(epoch_us(ts) - 1704067200000000)")
    text = text.replace("{K}", "cast(json_extract_string(props, '$.k') as int)")
    text = re.sub(r"\{E:(\d+)\}", r"cast(list_extract(embedding, \1) as double)", text)
    text = re.sub(r"\{SEQ:(\d+):(\w)\}", r"(select range as i from range(\1)) \2", text)
    return re.sub(r"\{(%s)\}" % "|".join(BASE_TABLES), r"\1", text)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture table ``name`` over the parquet files in ``sf_dir``."""
    ntz = False
    text = FIXTURES[name]
    if "{US}" in text:
        kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema["ts"].dataType.typeName()
        ntz = kind == "timestamp_ntz"
    return spark.sql(_to_spark(text, sf_dir, ntz, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def check_sql(body: str, *names: str, **extra: str) -> str:
    """``body`` behind WITH clauses for the named fixtures and then the extra named sub-queries, in order."""
    parts = [f"{n} as ({_to_check(FIXTURES[n])})" for n in names]
    parts += [f"{n} as ({_to_check(q)})" for n, q in extra.items()]
    head = "with recursive " + ",\n".join(parts) + "\n" if parts else ""
    return head + _to_check(body)
