"""Registered streaming queries: test tables written as files, read as a stream, run to the end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skymill.operators import frames as fr
from skymill.operators import telemetry as tm
from skymill.plans.fixtures import load
from skymill.plans.frame_queries import keyframe_tables
from skymill.plans.registry import query, rounded
from skymill.plans.telemetry_queries import _synced
from skymill.runtime import cut, scratch_path
from skymill.streaming import stateful as sf_


def _clock(column: str):
    """Event time from the compressed test clock: one day of it per second."""
    return F.timestamp_micros((F.col(column) * 1e9).cast("long"))


PIECES = 4


def run_stream(spark, table, build, sort: str):
    """Write ``table`` in time slices, stream each through ``build`` as it arrives, return everything that came out.

    Every slice is a run of its own that goes on from the state of the run before, as after a restart. Closing rows far in the
    future move the watermark past all real events.
    """
    source, sink, point = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    table = cut(table)
    lo, hi, end = table.agg(F.min(sort), F.max(sort), F.max("event_time")).first()
    width = (hi - lo) / PIECES or 1.0
    piece = F.least(F.lit(PIECES - 1), F.floor((F.col(sort) - lo) / width))
    sessions = table.select("session_id").distinct()
    for k in range(PIECES + 1):
        if k < PIECES:
            arriving = table.where(piece == k)
        else:
            blank = [F.lit(None).cast(t).alias(c) for c, t in table.dtypes if c not in ("session_id", "event_time")]
            arriving = sessions.select("session_id", (F.lit(end) + F.expr("interval 1 day")).alias("event_time"), *blank).select(*table.columns)
        arriving.write.mode("append").parquet(source)
        stream = spark.readStream.schema(table.schema).parquet(source)
        q = build(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", point).outputMode("append").trigger(availableNow=True).queryName(f"q{uuid.uuid4().hex}").start()
        q.awaitTermination()
    return spark.read.parquet(sink)


@query("ST1_stream_trajectory")
def _st1(spark, sf):
    synced = _synced(spark, sf).withColumn("altitude_m", F.col("altitude_m") - F.col("origin_alt"))
    ev = tm.event_stream(load(spark, sf, "imu"), synced).withColumn("event_time", _clock("timestamp_s"))
    return rounded(run_stream(spark, ev, lambda s: sf_.stream_trajectory(s, "10 minutes"), "timestamp_s"))


@query("ST2_stream_keyframes")
def _st2(spark, sf):
    rows = fr.keyframe_inputs(*keyframe_tables(spark, sf)).withColumn("event_time", _clock("timestamp_s"))
    return rounded(run_stream(spark, rows, lambda s: sf_.stream_keyframes(s, "10 minutes"), "timestamp_s"))
