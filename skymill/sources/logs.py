"""Flight-log sources: CSV with tidy or untidy headers, blank-separated logs, session documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skymill.operators.ordered import row_index
from skymill.operators.telemetry import gyro_onto_accel
from skymill.sources.lines import data_lines, numbered

MICROS = 1e6


def flight_log(spark: SparkSession, path: str) -> DataFrame:
    """``timestamp_s, lat, lon, alt_m``; ordering is left to whoever needs it."""
    df = spark.read.csv(path, header=True)
    return df.select(*[F.col(c).cast("double").alias(c) for c in ("timestamp_s", "lat", "lon", "alt_m")])


def tolerant_csv(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Header names trimmed, all-blank rows dropped, nameless trailing columns ignored, everything as trimmed text.

    With ``ordered`` a column ``_order`` numbers the lines, over several files in order of their names.
    """
    df = spark.read.csv(path, header=True)
    first = spark.read.csv(path).first() or ()
    nameless = {f"_c{i}" for i, cell in enumerate(first) if not (cell or "").strip()}  # the reader's names for empty header cells
    names = [c for c in df.columns if c.strip() and c not in nameless]
    cols = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in names]
    if ordered:
        df = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
        df = numbered(df, "_order", per_file=False)
        cols.append(F.col("_order"))
    return df.select(*cols).dropna("all", subset=[c.strip() for c in names])


def _seconds(c: str) -> Column:
    return F.col(c).cast("double") / MICROS


def multi_log_session(spark: SparkSession, folder: str, images: DataFrame, session_id: str, chunk_s: float = 60.0) -> dict[str, DataFrame]:
    """One recording made of separate CSV logs.

    ``images`` lists ``image_filename`` whose stem is the image id. The last GPS row of an image id wins, images
    without GPS are left out, gyro is brought onto accelerometer times, checkpoints keep only retained frames. ``seq`` of
    each log is its line order; of repeated gyro times the last line counts.
    """
    sid = F.lit(session_id).alias("session_id")
    gps_rows = tolerant_csv(spark, f"{folder}/OnboardGPS.csv", ordered=True)
    last = gps_rows.groupBy(F.col("imgid").cast("long").alias("imgid")).agg(F.max_by(F.struct("Timpstemp", "lat", "lon", "alt", "_order"), "_order").alias("_r"))
    gps = last.select(
        sid, "imgid", F.col("_r._order").alias("seq"), (F.col("_r.Timpstemp").cast("double") / MICROS).alias("timestamp_s"),
        F.col("_r.lat").cast("double").alias("lat"), F.col("_r.lon").cast("double").alias("lon"), F.col("_r.alt").cast("double").alias("alt_m"),
    )
    listed = images.select("image_filename", F.regexp_extract("image_filename", r"(\d+)\.[^.]+$", 1).cast("long").alias("imgid"))
    frames = listed.join(gps.select("session_id", "imgid", "timestamp_s"), "imgid")
    # image ids are dense counters, so a slice of ids holds a bounded number of frames
    frames = row_index(frames, ["session_id"], ["imgid"], 100_000.0, "frame_idx")
    accel, gyro = (
        tolerant_csv(spark, f"{folder}/{name}.csv", ordered=True).select(sid, F.col("_order").alias("seq"), _seconds("Timpstemp").alias("timestamp_s"), *[F.col(a).cast("double").alias(f"{p}{a}") for a in "xyz"])
        for name, p in (("RawAccel", "a"), ("RawGyro", "g"))
    )
    imu = gyro_onto_accel(accel, gyro, chunk_s)
    baro = tolerant_csv(spark, f"{folder}/BarometricPressure.csv", ordered=True).select(
        sid, F.col("_order").alias("seq"), _seconds("Timpstemp").alias("timestamp_s"), F.col("Pressure").cast("double").alias("pressure_hpa"), F.col("Altitude").cast("double").alias("altitude_m")
    )
    truth = tolerant_csv(spark, f"{folder}/GroundTruthAGL.csv").withColumn("imgid", F.col("imgid").cast("double").cast("long"))
    checkpoints = truth.join(frames.select("imgid"), "imgid", "left_semi").select(
        sid, F.format_string("%05d.jpg", "imgid").alias("image_filename"),
        *[F.col(f"{a}_gt").cast("double").alias(f"utm_{a}") for a in "xyz"],
    )
    return {
        "frames": frames.select("session_id", "frame_idx", "timestamp_s", "image_filename"),
        "gps_fixes": gps.drop("imgid"),
        "imu": imu,
        "baro": baro,
        "checkpoints": checkpoints,
    }


def image_list(spark: SparkSession, path: str) -> DataFrame:
    """``id timestamp name`` lines; ``seq`` is their order."""
    p = F.col("parts")
    return numbered(data_lines(spark, path), "seq", per_file=False).select("seq", p[0].cast("long").alias("id"), p[1].cast("double").alias("timestamp_s"), p[2].alias("image_filename"))


def imu_list(spark: SparkSession, path: str) -> DataFrame:
    """``timestamp wx wy wz ax ay az`` lines; ``seq`` is their order."""
    p = F.col("parts")
    names = ("timestamp_s", "gx", "gy", "gz", "ax", "ay", "az")
    lines = numbered(data_lines(spark, path), "seq", per_file=False)
    return lines.select("seq", *[p[i].cast("double").alias(n) for i, n in enumerate(names)])


def probe_fixes(table: DataFrame) -> DataFrame:
    """Fixes under any of the usual header spellings; altitude defaults to 0, rows without position are dropped."""

    def first_of(*names: str) -> Column:
        have = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in table.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    df = table.select(
        first_of("lat", "latitude", "Latitude").cast("double").alias("lat"),
        first_of("lon", "longitude", "Longitude").cast("double").alias("lon"),
        F.coalesce(first_of("alt", "altitude", "Altitude").cast("double"), F.lit(0.0)).alias("alt_m"),
    )
    return df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


SESSION_SCHEMA = """session_id string, provenance string, crs_epsg int, origin_lla array<double>,
 frames array<struct<frame_idx:bigint,timestamp:double,image_filename:string>>,
 gps_fixes array<struct<timestamp:double,latitude:double,longitude:double,altitude_m:double>>,
 imu_measurements array<struct<timestamp:double,accel_xyz:array<double>,gyro_xyz:array<double>>>,
 barometer_measurements array<struct<timestamp:double,pressure_hpa:double,altitude_m:double>>"""


def read_sessions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Session documents (one JSON object per line) into flat tables; ``seq`` is a row's place in its log."""
    docs = spark.read.schema(SESSION_SCHEMA).json(path)

    def rows(field: str) -> DataFrame:
        return docs.select("session_id", F.posexplode(field).alias("_at", "_x")).withColumn("seq", F.col("_at").cast("long"))

    def xyz(field: str, p: str) -> list[Column]:
        return [F.get(F.col(f"_x.{field}"), F.lit(i)).alias(f"{p}{a}") for i, a in enumerate("xyz")]

    o = F.col("origin_lla")
    return {
        "sessions": docs.select("session_id", "provenance", F.coalesce("crs_epsg", F.lit(4326)).alias("crs_epsg"), o[0].alias("origin_lat"), o[1].alias("origin_lon"), o[2].alias("origin_alt")),
        "frames": rows("frames").select("session_id", "_x.frame_idx", F.col("_x.timestamp").alias("timestamp_s"), "_x.image_filename"),
        "gps_fixes": rows("gps_fixes").select("session_id", "seq", F.col("_x.timestamp").alias("timestamp_s"), F.col("_x.latitude").alias("lat"), F.col("_x.longitude").alias("lon"), "_x.altitude_m"),
        "imu": rows("imu_measurements").select("session_id", "seq", F.col("_x.timestamp").alias("timestamp_s"), *xyz("accel_xyz", "a"), *xyz("gyro_xyz", "g")),
        "baro": rows("barometer_measurements").select("session_id", "seq", F.col("_x.timestamp").alias("timestamp_s"), "_x.pressure_hpa", "_x.altitude_m"),
    }


def session_documents(sessions: DataFrame, frames: DataFrame, gps: DataFrame, imu: DataFrame, baro: DataFrame) -> DataFrame:
    """S6, the other way: one document row per session, as the format demands; write with ``write.json``.

    A document holds a whole session by definition. Sessions too long for one document belong in the flat tables.
    """

    def packed(df: DataFrame, name: str, item: Column) -> DataFrame:
        return df.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias(name))

    t = F.col("timestamp_s").alias("timestamp")
    parts = (
        packed(frames, "frames", F.struct("frame_idx", t, "image_filename")),
        packed(gps, "gps_fixes", F.struct(t, F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("alt_m").alias("altitude_m"))),
        packed(imu, "imu_measurements", F.struct(t, F.array("ax", "ay", "az").alias("accel_xyz"), F.array("gx", "gy", "gz").alias("gyro_xyz"))),
        packed(baro, "barometer_measurements", F.struct(t, "pressure_hpa", "altitude_m")),
    )
    df = sessions.select(F.col("session_id"), "provenance", "crs_epsg", F.array("origin_lat", "origin_lon", "origin_alt").alias("origin_lla"))
    for p in parts:
        df = df.join(p, "session_id", "left")
    return df.withColumn("session_id", F.col("session_id").cast("string"))
