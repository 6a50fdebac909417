import math

import pytest

from skymill.functions import geodesy
from skymill.operators import telemetry as tm

FIX = "session_id long, seq long, timestamp_s double, lat double, lon double, alt_m double"
FRAME = "session_id long, frame_idx long, timestamp_s double"
IMU = "session_id long, seq long, timestamp_s double, ax double, ay double, az double, gx double, gy double, gz double"
BARO = "session_id long, seq long, timestamp_s double, pressure_hpa double, altitude_m double"


def test_bounded_interpolation(spark):
    log = spark.createDataFrame([(1, 0, 10.0, 11.0, 21.0, 110.0), (1, 1, 0.0, 10.0, 20.0, 100.0)], FIX)
    frames = spark.createDataFrame([(1, 0, 5.0), (1, 1, 10.5), (1, 2, 12.0), (1, 3, -0.5)], FRAME)
    rows = {r.frame_idx: r for r in tm.interpolate_fixes(frames, log, 1.0, chunk_s=2.0).collect()}
    assert (rows[0].lat, rows[0].lon, rows[0].alt_m) == (10.5, 20.5, 105.0)
    assert rows[1].lat == 11.0 and rows[3].lat == 10.0 and 2 not in rows


@pytest.mark.parametrize("chunk", [0.5, 100.0])
def test_sync_extrapolates_and_never_invents(spark, chunk):
    gps = spark.createDataFrame([(1, 0, 0.0, 12.0, 8.0, 900.0), (1, 1, 2.0, 12.0002, 8.0, 910.0), (2, 0, 0.0, 1.0, 1.0, 1.0)], FIX)
    imu = spark.createDataFrame([], IMU)
    baro = spark.createDataFrame([], BARO)
    frames = spark.createDataFrame([(1, 0, 1.0), (1, 1, 4.0), (2, 0, 1.0)], FRAME)
    rows = {(r.session_id, r.frame_idx): r for r in tm.sync_telemetry(frames, gps, imu, baro, chunk).collect()}
    assert math.isclose(rows[1, 0].lat, 12.0001) and rows[1, 0].alt_m == 905.0
    assert math.isclose(rows[1, 1].alt_m, 920.0) and rows[1, 1].ax is None
    assert rows[2, 0].lat is None


def test_geodetic_round_trips(spark):
    df = spark.createDataFrame([(47.4, 8.5, 460.0, 47.38, 8.54, 400.0), (-33.9, 151.2, 30.0, -33.8, 151.0, 0.0)],
                               "lat double, lon double, alt_m double, origin_lat double, origin_lon double, origin_alt double")
    back = geodesy.with_wgs84_from_enu(geodesy.with_enu(df), out=("lat2", "lon2", "alt2"))
    for r in back.collect():
        assert abs(r.lat - r.lat2) < 1e-9 and abs(r.lon - r.lon2) < 1e-9 and abs(r.alt_m - r.alt2) < 1e-4


def test_quality_tiers(spark):
    rows = [(1, float(i), i * 1.0, 0.0, 0.0) for i in range(30)] + [(2, float(i), 0.1 * i, 0.0, 0.0) for i in range(10)] + [(3, 0.0, 0.0, 0.0, 0.0)]
    rows += [(1, 99.0, float("nan"), 0.0, 0.0)]
    q = {r.session_id: r for r in tm.sensor_quality(spark.createDataFrame(rows, "session_id long, timestamp_s double, e double, n double, u double")).collect()}
    assert q[1].quality_tier == "STRONG_GPS" and q[1].total_fixes == 31 and q[1].valid_fixes == 30
    assert q[2].quality_tier == "INSUFFICIENT_BASELINE" and q[3].quality_tier == "LOCAL_METRIC"
