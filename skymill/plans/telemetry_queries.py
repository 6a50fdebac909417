"""Registered telemetry queries: alignment in time, geodesy, integrity, sensor quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from skymill.functions import camera, geodesy
from skymill.operators import telemetry as tm
from skymill.operators.ordered import previous_row
from skymill.plans.fixtures import check_sql, load
from skymill.plans.registry import query, rnd, rounded, settle

# The test clock squeezes 30 days into 2.6 s; slices this narrow make every session span several chunks.
TEST_CHUNK_S = 0.4


def _interp_sql(name: str, sensor: str, values: list[str], clamp: bool, outside: float | None = None) -> str:
    """As-of interpolation written with list positions rather than carries."""
    vals = ", ".join(values)
    picks = []
    for v in values:
        if clamp:
            picks.append(
                f"case when k = 0 then list_extract({v}s, 1) when k = n then list_extract({v}s, n) else "
                f"list_extract({v}s, k) + (list_extract({v}s, k + 1) - list_extract({v}s, k)) * "
                f"((t - list_extract(ts, k)) / (list_extract(ts, k + 1) - list_extract(ts, k))) end as {v}"
            )
        else:
            picks.append(
                f"case when n >= 2 then list_extract({v}s, j) + (list_extract({v}s, j + 1) - list_extract({v}s, j)) * "
                f"((t - list_extract(ts, j)) / (list_extract(ts, j + 1) - list_extract(ts, j))) end as {v}"
            )
    lists = ", ".join(f"list({v} order by timestamp_s) as {v}s" for v in values)
    where = "" if outside is None else f"where t >= list_extract(ts, 1) - {outside} and t <= list_extract(ts, n) + {outside}"
    return f"""(select session_id, fid, {', '.join(picks)} from (
        select f.session_id, f.fid, f.t, s.*exclude(session_id),
               len(list_filter(s.ts, lambda x: x <= f.t)) as k,
               greatest(1, least(len(list_filter(s.ts, lambda x: x <= f.t)), s.n - 1)) as j
        from {name} f join (select session_id, count(*) as n, list(timestamp_s order by timestamp_s) as ts, {lists}
                            from (select session_id, timestamp_s, {vals} from {sensor}
                                  qualify row_number() over (partition by session_id, timestamp_s order by seq desc) = 1)
                            group by session_id) s on f.session_id = s.session_id) {where})"""


_TARGETS = "select session_id, frame_idx as fid, timestamp_s as t from frames"


@query(
    "J1_sync_telemetry",
    check_sql(
        "select f.session_id, f.frame_idx, "
        + ", ".join(rnd(f"{a}.{v}", 9 if v in ("lat", "lon") else 6) + f" as {v}"
                    for a, vs in (("g", tm.GPS_VALUES), ("i", tm.IMU_VALUES), ("b", tm.BARO_VALUES)) for v in vs)
        + " from frames f left join g on g.session_id = f.session_id and g.fid = f.frame_idx"
        " left join i on i.session_id = f.session_id and i.fid = f.frame_idx"
        " left join b on b.session_id = f.session_id and b.fid = f.frame_idx",
        "frames", "gps_fixes", "imu", "baro",
        tg=_TARGETS,
        g="select * from " + _interp_sql("tg", "gps_fixes", list(tm.GPS_VALUES), False),
        i="select * from " + _interp_sql("tg", "imu", list(tm.IMU_VALUES), False),
        b="select * from " + _interp_sql("tg", "baro", list(tm.BARO_VALUES), False),
    ),
)
def _sync(spark, sf):
    df = tm.sync_telemetry(*[load(spark, sf, n) for n in ("frames", "gps_fixes", "imu", "baro")], chunk_s=TEST_CHUNK_S)
    fine = df.select("session_id", "frame_idx", *[settle(c, 9) for c in ("lat", "lon")],
                     *[settle(c, 6) for c in ("alt_m", *tm.IMU_VALUES, *tm.BARO_VALUES)])
    return fine


@query(
    "J2_interpolate_fixes",
    check_sql(
        f"select session_id, fid as frame_idx, {rnd('lat', 9)} as lat, {rnd('lon', 9)} as lon, {rnd('alt_m')} as alt_m from g",
        "frames", "gps_fixes", tg=_TARGETS,
        g="select * from " + _interp_sql("tg", "gps_fixes", list(tm.GPS_VALUES), True, 0.05),
    ),
)
def _bounded(spark, sf):
    df = tm.interpolate_fixes(load(spark, sf, "frames"), load(spark, sf, "gps_fixes"), 0.05, TEST_CHUNK_S)
    return df.select("session_id", "frame_idx", *[settle(c, d) for c, d in (("lat", 9), ("lon", 9), ("alt_m", 6))])


@query(
    "J3_gyro_onto_accel",
    check_sql(
        f"select session_id, fid as seq, {rnd('gx')} as gx, {rnd('gy')} as gy, {rnd('gz')} as gz from g",
        "gps_fixes", "imu", tg="select session_id, seq as fid, timestamp_s as t from gps_fixes",
        g="select * from " + _interp_sql("tg", "imu", ["gx", "gy", "gz"], True),
    ),
)
def _gyro(spark, sf):
    accel = load(spark, sf, "gps_fixes").select("session_id", "timestamp_s", "seq")
    out = tm.gyro_onto_accel(accel, load(spark, sf, "imu"), TEST_CHUNK_S)
    return rounded(out.where(F.col("gx").isNotNull()).select("session_id", "seq", "gx", "gy", "gz"))


@query(
    "W3_first_fix_origin",
    check_sql(
        "select session_id, arg_min(lat, timestamp_s) as origin_lat, arg_min(lon, timestamp_s) as origin_lon, "
        "arg_min(alt_m, timestamp_s) as origin_alt from gps_fixes group by session_id", "gps_fixes"),
)
def _origin(spark, sf):
    return tm.first_fix_origin(load(spark, sf, "gps_fixes"))


_RAD = "pi() / 180"
_ECEF = """select {keep}, (nn + h) * cos(ph) * cos(la) as {p}x, (nn + h) * cos(ph) * sin(la) as {p}y,
    (nn * (1 - {e2}) + h) * sin(ph) as {p}z from (select *, 6378137.0::double / sqrt(1 - {e2} * sin(ph) * sin(ph)) as nn
    from (select *, {lat} * pi() / 180 as ph, {lon} * pi() / 180 as la, {alt} as h from {src}))"""


def ecef_sql(src: str, keep: str, lat: str, lon: str, alt: str, p: str) -> str:
    return _ECEF.format(src=src, keep=keep, lat=lat, lon=lon, alt=alt, p=p, e2=repr(geodesy.E2) + "::double")


def enu_sql(src: str, keep: str, lat="lat", lon="lon", alt="alt_m") -> str:
    """ENU against origin_lat/lon/alt on the same row, as nested sub-queries."""
    a = ecef_sql(src, "*", lat, lon, alt, "q_")
    b = ecef_sql(f"(select * exclude (ph, la, h, nn) from ({a.replace('select *,', 'select *, ', 1)}))", "*", "origin_lat", "origin_lon", "origin_alt", "o_")
    return f"""select {keep}, -sin(la) * dx + cos(la) * dy as e,
        -sin(ph) * cos(la) * dx - sin(ph) * sin(la) * dy + cos(ph) * dz as n,
        cos(ph) * cos(la) * dx + cos(ph) * sin(la) * dy + sin(ph) * dz as u
        from (select *, q_x - o_x as dx, q_y - o_y as dy, q_z - o_z as dz from ({b}))"""


_ORIGINS = ("select session_id, arg_min(lat, timestamp_s) as origin_lat, arg_min(lon, timestamp_s) as origin_lon, "
            "arg_min(alt_m, timestamp_s) as origin_alt from gps_fixes group by session_id")
_FIX_ORIGIN = "select g.session_id, g.seq, g.timestamp_s, g.lat, g.lon, g.alt_m, o.* exclude (session_id) from gps_fixes g join origins o on g.session_id = o.session_id"


@query(
    "C1_geodetic_to_ecef",
    check_sql(f"select session_id, seq, {rnd('qx', 3)} as x, {rnd('qy', 3)} as y, {rnd('qz', 3)} as z from ("
              + ecef_sql("gps_fixes", "session_id, seq", "lat", "lon", "alt_m", "q") + ")", "gps_fixes"),
)
def _ecef(spark, sf):
    df = geodesy.with_ecef(load(spark, sf, "gps_fixes"), "lat", "lon", "alt_m", "")
    return rounded(df.select("session_id", "seq", "x", "y", "z"), 3)


@query(
    "C3_wgs84_to_enu",
    check_sql(f"select session_id, seq, {rnd('e', 4)} as e, {rnd('n', 4)} as n, {rnd('u', 4)} as u from ("
              + enu_sql("fo", "session_id, seq") + ")", "gps_fixes", origins=_ORIGINS, fo=_FIX_ORIGIN),
)
def _enu(spark, sf):
    gps = load(spark, sf, "gps_fixes")
    df = geodesy.with_enu(gps.join(tm.first_fix_origin(gps), ["session_id"]))
    return rounded(df.select("session_id", "seq", "e", "n", "u"), 4)


@query(
    "C2_enu_rotation",
    check_sql(
        "select session_id, " + ", ".join(rnd(x, 9) + f" as {n}" for n, x in {
            "b00": "-sin(lo)", "b01": "cos(lo)", "b02": "0.0::double",
            "b10": "-sin(la) * cos(lo)", "b11": "-sin(la) * sin(lo)", "b12": "cos(la)",
            "b20": "cos(la) * cos(lo)", "b21": "cos(la) * sin(lo)", "b22": "sin(la)"}.items())
        + " from (select session_id, origin_lat * pi() / 180 as la, origin_lon * pi() / 180 as lo from origins)",
        "gps_fixes", origins=_ORIGINS),
)
def _basis(spark, sf):
    o = tm.first_fix_origin(load(spark, sf, "gps_fixes"))
    b = geodesy.enu_basis(F.col("origin_lat"), F.col("origin_lon"))
    return rounded(o.select("session_id", *[v.alias(k) for k, v in b.items()]), 9)


@query(
    "C4_enu_to_wgs84",
    check_sql(f"select session_id, seq, {rnd('lat', 7)} as lat, {rnd('lon', 7)} as lon, {rnd('alt_m', 3)} as alt_m from gps_fixes", "gps_fixes"),
)
def _enu_back(spark, sf):
    gps = load(spark, sf, "gps_fixes")
    df = geodesy.with_enu(gps.join(tm.first_fix_origin(gps), ["session_id"])).drop("lat", "lon", "alt_m")
    df = geodesy.with_wgs84_from_enu(df)
    return df.select("session_id", "seq", *[settle(c, d) for c, d in (("lat", 7), ("lon", 7), ("alt_m", 3))])


# Spread the fixes over the globe so that every zone and both hemispheres occur.
_WORLD = "select event_id, (event_id * 53 % 16000) / 1e2 - 80e0 as lat, (event_id * 37 % 36000) / 1e2 - 180e0 as lon from {events}"


@query(
    "C5_utm_zone",
    check_sql("select event_id, cast(case when lat >= 0 then 32600 else 32700 end + least(60, floor((lon + 180) / 6) + 1) as int) as epsg from w", w=_WORLD),
)
def _zone(spark, sf):
    return _world(spark, sf).select("event_id", "epsg")


def _world(spark, sf):
    df = spark.sql(_WORLD.replace("{events}", f"parquet.`{sf}/events.parquet`"))
    return df.withColumn("epsg", geodesy.utm_epsg(F.col("lon"), F.col("lat")).cast("int"))


def utm_sql(src: str, keep: str) -> str:
    k0a = repr(geodesy.UTM_K0 * geodesy.RECTIFYING_RADIUS) + "::double"
    ecc = f"sqrt({geodesy.E2!r}::double)"
    xs = " + ".join(f"{a!r}::double * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geodesy.ALPHA, 1))
    ys = " + ".join(f"{a!r}::double * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geodesy.ALPHA, 1))
    return f"""select {keep}, 500000 + {k0a} * (eta + {xs}) as utm_x,
        case when epsg >= 32700 then 10000000 else 0 end + {k0a} * (xi + {ys}) as utm_y
      from (select *, atan2(tt, cos(la)) as xi, atanh(sin(la) / sqrt(1 + tt * tt)) as eta
      from (select *, sinh(atanh(sin(ph)) - {ecc} * atanh({ecc} * sin(ph))) as tt
      from (select *, lat * pi() / 180 as ph, (lon - ((epsg % 100) * 6 - 183)) * pi() / 180 as la from {src})))"""


_WORLD_Z = "select *, cast(case when lat >= 0 then 32600 else 32700 end + least(60, floor((lon + 180) / 6) + 1) as int) as epsg from w"


@query(
    "C6_wgs84_to_utm",
    check_sql(f"select event_id, epsg, {rnd('utm_x', 3)} as utm_x, {rnd('utm_y', 3)} as utm_y from (" + utm_sql("wz", "event_id, epsg") + ")",
              w=_WORLD, wz=_WORLD_Z),
)
def _utm(spark, sf):
    df = geodesy.with_utm(_world(spark, sf), "lat", "lon")
    return rounded(df.select("event_id", "epsg", "utm_x", "utm_y"), 3)


@query(
    "C6_utm_to_wgs84",
    check_sql(f"select event_id, {rnd('lat', 8)} as lat, {rnd('lon', 8)} as lon from w", w=_WORLD),
)
def _utm_back(spark, sf):
    df = geodesy.with_utm(_world(spark, sf), "lat", "lon").drop("lat", "lon")
    return rounded(geodesy.with_wgs84_from_utm(df, "utm_x", "utm_y").select("event_id", "lat", "lon"), 8)


@query(
    "C6_enu_to_utm",
    check_sql(f"select session_id, seq, epsg, {rnd('utm_x', 3)} as utm_x, {rnd('utm_y', 3)} as utm_y, {rnd('alt_m', 3)} as utm_z from (" + utm_sql("oz", "session_id, seq, epsg, alt_m") + ")",
              "gps_fixes", origins=_ORIGINS, fo=_FIX_ORIGIN,
              oz="select session_id, seq, lat, lon, alt_m, cast(case when origin_lat >= 0 then 32600 else 32700 end + least(60, floor((origin_lon + 180) / 6) + 1) as int) as epsg from fo"),
)
def _utm_of_enu(spark, sf):
    df = geodesy.with_utm_from_enu(fix_positions(spark, sf).drop("lat", "lon", "alt_m"))
    return rounded(df.select("session_id", "seq", "epsg", "utm_x", "utm_y", "utm_z"), 3)


_SESSIONS = ("select c_custkey as session_id, case when c_acctbal < 0 then 'NONE' when c_nationkey % 2 = 0 then 'REAL' "
             "else 'SIMULATED' end as provenance from {customer}")


def _sessions(spark, sf):
    return spark.sql(_SESSIONS.replace("{customer}", f"parquet.`{sf}/customer.parquet`"))


@query(
    "F6_is_georeferenced",
    check_sql("select s.session_id, s.provenance, coalesce(n, 0) as n_fixes, s.provenance in ('REAL', 'SIMULATED') and coalesce(n, 0) >= 3 as is_georeferenced "
              "from s left join (select session_id, count(*) as n from gps_fixes group by 1) g on g.session_id = s.session_id",
              "gps_fixes", s=_SESSIONS),
)
def _georef(spark, sf):
    return tm.is_georeferenced(_sessions(spark, sf), load(spark, sf, "gps_fixes"))


_GAPS = """select session_id, count(*) as n, coalesce(bool_or(d <= 0), false) as bad, max(d) as mx, avg(d) as av from (
    select session_id, timestamp_s - lag(timestamp_s) over (partition by session_id order by seq) as d from {src}) group by 1"""


@query(
    "A14_validate_integrity",
    check_sql(
        f"""select session_id, issue, {rnd('value')} as value from (
        select s.session_id, unnest([
          case when f.n is null then {{'issue': 'no_frames', 'value': null::double}} end,
          case when f.bad then {{'issue': 'frames_not_increasing', 'value': null::double}} end,
          case when g.bad then {{'issue': 'gps_not_increasing', 'value': null::double}} end,
          case when g.mx > 0.5 then {{'issue': 'gps_gap', 'value': g.mx}} end,
          case when i.n >= 2 and (case when i.av > 0 then 1 / i.av else 0 end) < 20 then
               {{'issue': 'imu_rate_low', 'value': case when i.av > 0 then 1 / i.av else 0 end}} end,
          case when s.provenance = 'REAL' and g.n is null then {{'issue': 'real_without_gps', 'value': null::double}} end], recursive := true)
        from s left join f using (session_id) left join g using (session_id) left join i using (session_id)) where issue is not null""",
        "frames", "gps_fixes", "imu", s=_SESSIONS,
        f=_GAPS.replace("{src}", "(select session_id, frame_idx as seq, timestamp_s from frames)"),
        g=_GAPS.replace("{src}", "gps_fixes"), i=_GAPS.replace("{src}", "imu")),
)
def _integrity(spark, sf):
    frames = load(spark, sf, "frames").withColumn("seq", F.col("frame_idx"))
    out = tm.validate_integrity(
        _sessions(spark, sf), frames, load(spark, sf, "gps_fixes"), load(spark, sf, "imu"), max_gap_s=0.5, chunk=1000.0
    )
    return rounded(out)


def _synced(spark, sf):
    gps = load(spark, sf, "gps_fixes")
    df = tm.sync_telemetry(load(spark, sf, "frames"), gps, load(spark, sf, "imu"), load(spark, sf, "baro"), TEST_CHUNK_S)
    return tm.with_positions(df, tm.first_fix_origin(gps))


def fix_positions(spark, sf):
    gps = load(spark, sf, "gps_fixes")
    return geodesy.with_enu(gps.join(tm.first_fix_origin(gps), ["session_id"]))


@query(
    "A1_sensor_quality",
    check_sql(
        """select session_id, total_fixes, total_fixes as valid_fixes,
          round_even(case when ok then h else 0 end, 3) + 0.0 as horizontal_spread_m,
          round_even(case when ok then v else 0 end, 3) + 0.0 as vertical_spread_m,
          round_even(case when ok then base else 0 end, 3) + 0.0 as trajectory_baseline_m,
          2.0::double as estimated_noise_m,
          round_even(case when ok then base / 2 else 0 end, 3) + 0.0 as baseline_to_noise_ratio,
          case when not ok then 'LOCAL_METRIC' when base / 2 >= 3 then 'STRONG_GPS' when base / 2 >= 0.5 then 'WEAK_GPS' else 'INSUFFICIENT_BASELINE' end as quality_tier,
          round_even(case when not ok then 0 when base / 2 >= 3 then 1 when base / 2 >= 0.5
             then least(0.5, greatest(0.05, 0.05 + 0.18 * (base / 2 - 0.5))) else 0.01 end, 4) + 0.0 as recommended_gps_weight
        from (select session_id, count(*) as total_fixes, count(*) >= 2 as ok,
            sqrt(pow(max(e) - min(e), 2) + pow(max(n) - min(n), 2)) as h, max(u) - min(u) as v,
            max(sqrt(pow(e - e0, 2) + pow(n - n0, 2))) as base
          from (select *, first_value(e) over w as e0, first_value(n) over w as n0 from ("""
        + enu_sql("fo", "session_id, timestamp_s")
        + """) window w as (partition by session_id order by timestamp_s)) group by session_id)""",
        "gps_fixes", origins=_ORIGINS, fo=_FIX_ORIGIN),
)
def _quality(spark, sf):
    return tm.sensor_quality(fix_positions(spark, sf), gps_noise_m=2.0)


@query("F2_every_nth", check_sql("select session_id, frame_idx from frames where frame_idx % 5 = 0", "frames"))
def _nth(spark, sf):
    return tm.every_nth(load(spark, sf, "frames"), ["session_id"], ["timestamp_s", "image_filename"], 5, TEST_CHUNK_S).select("session_id", "frame_idx")


@query(
    "F2_evenly_spaced",
    check_sql("select f.session_id, f.frame_idx from frames f join (select session_id, count(*) as n from frames group by 1) c using (session_id) "
              "where exists (select 1 from range(4) r(i) where i < least(4, n) and f.frame_idx = cast(floor(i * (n - 1) / greatest(least(4, n) - 1, 1)) as bigint))", "frames"),
)
def _even(spark, sf):
    return tm.evenly_spaced(load(spark, sf, "frames"), ["session_id"], ["timestamp_s", "image_filename"], 4, TEST_CHUNK_S).select("session_id", "frame_idx")


@query(
    "W10_replay_frame",
    check_sql("select f.session_id, f.image_filename from frames f join (select session_id, count(*) as n from frames group by 1) c using (session_id) "
              "where f.frame_idx = least(cast(floor(0.37 * n) as bigint), n - 1)", "frames"),
)
def _replay(spark, sf):
    return tm.replay_frame(load(spark, sf, "frames"), ["session_id"], ["timestamp_s", "image_filename"], 0.37, TEST_CHUNK_S).select("session_id", "image_filename")


@query(
    "W1_largest_gap",
    check_sql(
        f"""select k.session_id, k.n as n_kept_frames, coalesce(g.gap, 0) as max_gap_frames, g.a as gap_start, g.b as gap_end,
          {rnd('ta.timestamp_s')} as t_start, {rnd('tb.timestamp_s')} as t_end,
          case when k.n < 2 then 'too_few_frames' when tb.timestamp_s - ta.timestamp_s > 0.3 then 'gap_too_long' end as coverage_warning
        from (select session_id, count(*) as n from kept group by 1) k
        left join (select * from (select session_id, lag(frame_idx) over (partition by session_id order by frame_idx) as a, frame_idx as b,
                 frame_idx - lag(frame_idx) over (partition by session_id order by frame_idx) as gap from kept) where gap is not null
              qualify row_number() over (partition by session_id order by gap desc, a) = 1) g using (session_id)
        left join frame_metrics ta on ta.session_id = k.session_id and ta.frame_idx = g.a
        left join frame_metrics tb on tb.session_id = k.session_id and tb.frame_idx = g.b""",
        "frame_metrics", kept="select session_id, frame_idx from frame_metrics where sharpness >= 100"),
)
def _gap(spark, sf):
    m = load(spark, sf, "frame_metrics")
    kept = m.where(F.col("sharpness") >= 100).select("session_id", "frame_idx")
    return rounded(tm.largest_gap(kept, m.select("session_id", "frame_idx", "timestamp_s"), 0.3, chunk=4.0))


@query(
    "F5_invalid_fix_filter",
    check_sql("select session_id, count(*) as total, count(case when x is not null and not isnan(x) and not isinf(x) then 1 end) as valid from "
              "(select session_id, case when k % 11 = 0 then 'NaN'::double when k % 13 = 0 then 'Infinity'::double else value end as x from w) group by 1",
              w="select user_id as session_id, value, {K} as k from {events}"),
)
def _finite(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    x = F.when(k % 11 == 0, F.lit(float("nan"))).when(k % 13 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    e = e.select(F.col("user_id").alias("session_id"), x.alias("x"))
    return e.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(tm.is_finite("x")).alias("valid"))


@query(
    "Q1_sort_log",
    check_sql("select session_id, seq, row_number() over (partition by session_id order by timestamp_s, seq) - 1 as pos from gps_fixes", "gps_fixes"),
)
def _sorted(spark, sf):
    from skymill.operators.ordered import row_index

    return row_index(load(spark, sf, "gps_fixes"), ["session_id"], ["timestamp_s", "seq"], TEST_CHUNK_S, "pos").select("session_id", "seq", "pos")


@query(
    "W4_event_merge",
    check_sql(
        """select session_id, kind, pos, lag(kind) over (partition by session_id order by timestamp_s, fe, pos, rank) as prev_kind from (
          select session_id, timestamp_s, 0 as fe, seq as pos, 0 as rank, 'IMU' as kind from imu
          union all select f.session_id, f.timestamp_s, 1, f.frame_idx, 1, 'GPS' from frames f where (select count(*) from gps_fixes g where g.session_id = f.session_id) >= 2
          union all select f.session_id, f.timestamp_s, 1, f.frame_idx, 2, 'BARO' from frames f where (select count(*) from baro b where b.session_id = f.session_id) >= 2
          union all select session_id, timestamp_s, 1, frame_idx, 3, 'FRAME' from frames)""",
        "frames", "gps_fixes", "imu", "baro"),
)
def _merge(spark, sf):
    ev = tm.event_stream(load(spark, sf, "imu"), _synced(spark, sf))
    ev = previous_row(ev, ["session_id"], tm.EVENT_ORDER, ["kind"], TEST_CHUNK_S)
    return ev.select("session_id", "kind", "pos", F.col("prev.kind").alias("prev_kind"))


_ANGLES = "select event_id, {K} / 3e1 as roll, value / 4e1 as pitch, {K} / 1e1 as yaw from {events}"


@query(
    "C13_euler_rotation",
    check_sql(
        "select event_id, " + ", ".join(rnd(x, 8) + f" as {n}" for n, x in {
            "r00": "cos(yaw)*cos(pitch)", "r01": "cos(yaw)*sin(pitch)*sin(roll)-sin(yaw)*cos(roll)", "r02": "cos(yaw)*sin(pitch)*cos(roll)+sin(yaw)*sin(roll)",
            "r10": "sin(yaw)*cos(pitch)", "r11": "sin(yaw)*sin(pitch)*sin(roll)+cos(yaw)*cos(roll)", "r12": "sin(yaw)*sin(pitch)*cos(roll)-cos(yaw)*sin(roll)",
            "r20": "-sin(pitch)", "r21": "cos(pitch)*sin(roll)", "r22": "cos(pitch)*cos(roll)"}.items()) + " from w", w=_ANGLES),
)
def _euler(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    df = e.select("event_id", (k / 30.0).alias("roll"), (F.col("value") / 40.0).alias("pitch"), (k / 10.0).alias("yaw"))
    return rounded(camera.euler_rotation(df, "roll", "pitch", "yaw").select("event_id", *camera.R_NAMES), 8)
