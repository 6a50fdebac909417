"""Session telemetry: alignment in time, origins, integrity and sensor quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymill.functions.geodesy import with_enu
from skymill.operators.ordered import interpolate_at, previous_row, row_index

SESSION = ["session_id"]
GPS_VALUES = ("lat", "lon", "alt_m")
IMU_VALUES = ("ax", "ay", "az", "gx", "gy", "gz")
BARO_VALUES = ("pressure_hpa", "altitude_m")
# Sensors log at a bounded rate, so a slice of this many seconds holds a bounded number of rows.
CHUNK_S = 60.0


def sync_telemetry(
    frames: DataFrame, gps: DataFrame, imu: DataFrame, baro: DataFrame, chunk_s: float = CHUNK_S
) -> DataFrame:
    """GPS, IMU and barometer on frame times; a sensor with fewer than two samples stays NULL."""
    sensors = {"gps": (gps, GPS_VALUES), "imu": (imu, IMU_VALUES), "baro": (baro, BARO_VALUES)}
    return interpolate_at(frames, sensors, SESSION, width=chunk_s)


def interpolate_fixes(
    frames: DataFrame, log: DataFrame, max_extrapolation_s: float = 1.0, chunk_s: float = CHUNK_S
) -> DataFrame:
    """Flight log on frame times, held at its ends, frames beyond the tolerance dropped."""
    return interpolate_at(
        frames, {"gps": (log, GPS_VALUES)}, SESSION, clamp=True, max_outside_s=max_extrapolation_s, width=chunk_s
    )


def gyro_onto_accel(accel: DataFrame, gyro: DataFrame, chunk_s: float = CHUNK_S) -> DataFrame:
    """Angular rates on the accelerometer's own times, held at the ends."""
    return interpolate_at(accel, {"gyro": (gyro, ("gx", "gy", "gz"))}, SESSION, clamp=True, width=chunk_s)


def first_fix_origin(gps: DataFrame, order: str | Column = "timestamp_s") -> DataFrame:
    """The first fix of each session as its local origin; the order key is the caller's choice."""
    key = F.col(order) if isinstance(order, str) else order
    first = F.min_by(F.struct("lat", "lon", "alt_m"), key)
    return gps.groupBy(*SESSION).agg(first.alias("_o")).select(
        *SESSION,
        F.col("_o.lat").alias("origin_lat"),
        F.col("_o.lon").alias("origin_lon"),
        F.col("_o.alt_m").alias("origin_alt"),
    )


def with_positions(synced: DataFrame, origins: DataFrame) -> DataFrame:
    """Frame positions in the session's ENU; NULL where there is no GPS."""
    return with_enu(synced.join(origins, SESSION, "left"))


def is_georeferenced(sessions: DataFrame, gps: DataFrame, min_fixes: int = 3) -> DataFrame:
    """provenance REAL or SIMULATED and enough fixes."""
    fixes = gps.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n_fixes"))
    out = sessions.join(fixes, SESSION, "left").withColumn("n_fixes", F.coalesce("n_fixes", F.lit(0)))
    return out.withColumn(
        "is_georeferenced", F.col("provenance").isin("REAL", "SIMULATED") & (F.col("n_fixes") >= min_fixes)
    )


def log_gaps(log: DataFrame, order: str = "seq", chunk: float = 100_000.0) -> DataFrame:
    """Per session: rows, strictness of time in log order, largest step and mean step."""
    stepped = previous_row(log, SESSION, [order], ["timestamp_s"], chunk)
    step = F.col("timestamp_s") - F.col("prev.timestamp_s")
    return stepped.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_or(step <= 0), F.lit(False)).alias("not_increasing"),
        F.max(step).alias("max_step_s"),
        F.avg(step).alias("mean_step_s"),
    )


def validate_integrity(
    sessions: DataFrame,
    frames: DataFrame,
    gps: DataFrame,
    imu: DataFrame,
    max_gap_s: float = 2.0,
    min_imu_hz: float = 20.0,
    chunk: float = 100_000.0,
) -> DataFrame:
    """One row per session and issue. Log order is data here, so each log carries its ``seq``."""
    table = sessions.select(*SESSION, "provenance")
    for name, log in (("frame", frames), ("gps", gps), ("imu", imu)):
        stats = log_gaps(log, chunk=chunk)
        table = table.join(
            stats.select(*SESSION, *[F.col(c).alias(f"{name}_{c}") for c in stats.columns[1:]]), SESSION, "left"
        )
    hz = F.when(F.col("imu_mean_step_s") > 0, 1.0 / F.col("imu_mean_step_s")).otherwise(F.lit(0.0))
    cases = [
        ("no_frames", F.col("frame_n").isNull(), F.lit(None).cast("double")),
        ("frames_not_increasing", F.col("frame_not_increasing"), F.lit(None).cast("double")),
        ("gps_not_increasing", F.col("gps_not_increasing"), F.lit(None).cast("double")),
        ("gps_gap", F.col("gps_max_step_s") > max_gap_s, F.col("gps_max_step_s")),
        ("imu_rate_low", (F.col("imu_n") >= 2) & (hz < min_imu_hz), hz),
        ("real_without_gps", (F.col("provenance") == "REAL") & F.col("gps_n").isNull(), F.lit(None).cast("double")),
    ]
    issues = F.array(
        *[F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(n).alias("issue"), v.alias("value"))) for n, hit, v in cases]
    )
    return table.select(*SESSION, F.explode(F.array_compact(issues)).alias("_i")).select(*SESSION, "_i.issue", "_i.value")


def is_finite(*names: str) -> Column:
    """neither NULL, NaN nor infinite."""
    test = F.lit(True)
    for n in names:
        c = F.col(n)
        test = test & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return test


def sensor_quality(
    positions: DataFrame,
    order: str = "timestamp_s",
    gps_noise_m: float = 6.0,
    rtk_noise_m: float = 0.05,
    is_rtk: Column | None = None,
) -> DataFrame:
    """A1: baseline-to-noise gate per session over ENU positions ``e, n, u``.

    The baseline runs from the first valid fix, so that fix is found first and joined back as one row
    per session; extents come from the same second pass.
    """
    valid = is_finite("e", "n", "u")
    rtk = F.lit(False) if is_rtk is None else is_rtk
    firsts = positions.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("total_fixes"),
        F.count_if(valid).alias("valid_fixes"),
        F.min_by(F.when(valid, F.struct("e", "n")), F.when(valid, F.col(order))).alias("_first"),
        F.bool_or(rtk).alias("_rtk"),
    )
    far = F.hypot(F.col("e") - F.col("_first.e"), F.col("n") - F.col("_first.n"))
    spans = (
        positions.where(valid)
        .join(firsts.select(*SESSION, "_first"), SESSION)
        .groupBy(*SESSION)
        .agg(
            F.hypot(F.max("e") - F.min("e"), F.max("n") - F.min("n")).alias("_h"),
            (F.max("u") - F.min("u")).alias("_v"),
            F.max(far).alias("_base"),
        )
    )
    out = firsts.drop("_first").join(spans, SESSION, "left")
    noise = F.when(F.col("_rtk"), F.lit(rtk_noise_m)).otherwise(F.lit(gps_noise_m))
    enough = F.col("valid_fixes") >= 2
    out = out.withColumns({"_noise": noise, "_bnr": F.col("_base") / F.greatest(noise, F.lit(1e-6))})
    bnr = F.col("_bnr")
    tier = (
        F.when(~enough, "LOCAL_METRIC")
        .when(bnr >= 3.0, "STRONG_GPS")
        .when(bnr >= 0.5, "WEAK_GPS")
        .otherwise("INSUFFICIENT_BASELINE")
    )
    weight = (
        F.when(~enough, F.lit(0.0))
        .when(bnr >= 3.0, F.lit(1.0))
        .when(bnr >= 0.5, F.least(F.lit(0.5), F.greatest(F.lit(0.05), 0.05 + 0.18 * (bnr - 0.5))))
        .otherwise(F.lit(0.01))
    )

    def measured(c: str) -> Column:
        return F.bround(F.when(enough, F.col(c)).otherwise(F.lit(0.0)), 3)

    return out.select(
        *SESSION,
        "total_fixes",
        "valid_fixes",
        measured("_h").alias("horizontal_spread_m"),
        measured("_v").alias("vertical_spread_m"),
        measured("_base").alias("trajectory_baseline_m"),
        F.when(enough, F.col("_noise")).otherwise(F.lit(gps_noise_m)).alias("estimated_noise_m"),
        measured("_bnr").alias("baseline_to_noise_ratio"),
        tier.alias("quality_tier"),
        F.bround(weight, 4).alias("recommended_gps_weight"),
    )


def every_nth(df: DataFrame, keys: list[str], order: list[str], n: int, width: float) -> DataFrame:
    """keep rows 0, n, 2n … of each key."""
    return row_index(df, keys, order, width, "_i").where(F.col("_i") % n == 0).drop("_i")


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], k: int, width: float) -> DataFrame:
    """k rows per key at equal index spacing (all rows when there are at most k)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    i = F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("_n").cast("int")) - 1)).alias("_k")
    step = F.floor(F.col("_k") * (F.col("_n") - 1) / F.greatest(F.least(F.lit(k), F.col("_n")) - 1, F.lit(1)))
    picks = sizes.select(*keys, "_n", i).select(*keys, step.cast("long").alias("_i"))
    return row_index(df, keys, order, width, "_i").join(picks, [*keys, "_i"], "left_semi").drop("_i")


def replay_frame(df: DataFrame, keys: list[str], order: list[str], fraction: float, width: float) -> DataFrame:
    """The frame shown at a playback fraction."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    at = F.least(F.floor(F.lit(fraction) * F.col("_n")), F.col("_n") - 1).alias("_i")
    return row_index(df, keys, order, width, "_i").join(sizes.select(*keys, at), [*keys, "_i"], "left_semi")


def largest_gap(
    kept: DataFrame, timestamps: DataFrame, max_gap_s: float = 5.0, chunk: float = 100_000.0
) -> DataFrame:
    """Widest index gap between consecutive kept frames (earliest wins), with its times and a warning."""
    steps = previous_row(kept, SESSION, ["frame_idx"], ["frame_idx"], chunk)
    gap = F.col("frame_idx") - F.col("prev.frame_idx")
    # an earlier gap wins on equal width: order by (gap, -start)
    best = steps.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("n_kept_frames"),
        F.max(
            F.when(gap.isNotNull(), F.struct(gap.alias("gap"), (-F.col("prev.frame_idx")).alias("neg")))
        ).alias("_g"),
    )
    best = best.select(
        *SESSION,
        "n_kept_frames",
        F.coalesce(F.col("_g.gap"), F.lit(0).cast("long")).alias("max_gap_frames"),
        (-F.col("_g.neg")).alias("gap_start"),
        (F.col("_g.gap") - F.col("_g.neg")).alias("gap_end"),
    )
    t = timestamps.select(*SESSION, F.col("frame_idx").alias("_f"), "timestamp_s")
    for side in ("start", "end"):
        named = t.select(*SESSION, F.col("_f").alias(f"gap_{side}"), F.col("timestamp_s").alias(f"t_{side}"))
        best = best.join(named, [*SESSION, f"gap_{side}"], "left")
    seconds = F.col("t_end") - F.col("t_start")
    return best.select(
        *SESSION,
        "n_kept_frames",
        "max_gap_frames",
        "gap_start",
        "gap_end",
        "t_start",
        "t_end",
        F.when(F.col("n_kept_frames") < 2, "too_few_frames").when(seconds > max_gap_s, "gap_too_long").alias("coverage_warning"),
    )


def event_stream(imu: DataFrame, frames: DataFrame) -> DataFrame:
    """One ordered event table per session; at equal times IMU < GPS < BARO < FRAME, frame by frame.

    ``frames`` are synchronised frames with ENU position ``e, n, u`` and ``altitude_m``.
    """
    base = ["session_id", "timestamp_s"]
    imu_rows = imu.select(
        *base, F.lit(0).alias("frame_event"), F.col("seq").cast("long").alias("pos"), F.lit(0).alias("rank"),
        F.lit("IMU").alias("kind"), *IMU_VALUES,
    )
    # one pass over the frames: each yields its fix, its barometer reading and itself, as far as present
    kinds = F.array_compact(
        F.array(
            F.when(F.col("e").isNotNull(), F.struct(F.lit(1).alias("rank"), F.lit("GPS").alias("kind"))),
            F.when(F.col("altitude_m").isNotNull(), F.struct(F.lit(2).alias("rank"), F.lit("BARO").alias("kind"))),
            F.struct(F.lit(3).alias("rank"), F.lit("FRAME").alias("kind")),
        )
    )
    at_frame = frames.select(
        *base, F.lit(1).alias("frame_event"), F.col("frame_idx").cast("long").alias("pos"), F.explode(kinds).alias("_k"), "e", "n", "u", "altitude_m"
    )
    fix, baro = F.col("_k.rank") == 1, F.col("_k.rank") == 2
    at_frame = at_frame.select(
        *base, "frame_event", "pos", "_k.rank", "_k.kind",
        *[F.when(fix, F.col(c)).alias(c) for c in ("e", "n", "u")], F.when(baro, F.col("altitude_m")).alias("altitude_m"),
    )
    return imu_rows.unionByName(at_frame, allowMissingColumns=True)


EVENT_ORDER = ["timestamp_s", "frame_event", "pos", "rank"]
