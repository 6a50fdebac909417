"""The streams give the rows of the batch jobs, whatever the order in which events arrive."""

import numpy as np
from pyspark.sql import functions as F

from skymill.operators import frames as fr
from skymill.operators import telemetry as tm
from skymill.operators import trajectory as tj
from skymill.plans.registry import rounded
from skymill.plans.stream_queries import run_stream
from skymill.streaming import stateful


def shuffled_within(delay_s):
    """Rows are dealt to slices by a time that is off by less than the watermark's delay."""
    return F.col("timestamp_s") + (F.pmod(F.xxhash64("timestamp_s", "pos"), F.lit(1000)) / 1000.0 - 0.5) * delay_s * 0.9


def test_stream_trajectory_equals_batch(spark):
    rng = np.random.default_rng(3)
    imu = [(s, i, i * 0.1, *map(float, rng.normal(0, 0.3, 2)), 9.8, *map(float, rng.normal(0, 0.05, 3))) for s in (1, 2) for i in range(120)]
    imu = spark.createDataFrame(imu, "session_id long, seq long, timestamp_s double, ax double, ay double, az double, gx double, gy double, gz double")
    frames = [(s, i, 0.35 + i * 0.5, *((float(i), float(-i), 2.0) if i % 3 else (None, None, None)), 2.0 + 0.1 * i if s == 1 else None, 0.0) for s in (1, 2) for i in range(22)]
    frames = spark.createDataFrame(frames, "session_id long, frame_idx long, timestamp_s double, e double, n double, u double, altitude_m double, origin_alt double")
    want = rounded(tj.estimate_trajectory(imu, frames, 2.0))
    events = tm.event_stream(imu, frames).withColumn("event_time", F.timestamp_micros(((F.col("timestamp_s") + 1000) * 1e6).cast("long")))
    late = events.withColumn("arrives", shuffled_within(2.0))
    got = rounded(run_stream(spark, late, lambda s: stateful.stream_trajectory(s.drop("arrives"), "2 seconds"), "arrives"))
    key = lambda df: sorted(tuple(r) for r in df.select(*sorted(want.columns)).collect())
    assert key(got) == key(want) and got.count() == 44


def test_stream_keyframes_equal_batch(spark):
    rng = np.random.default_rng(4)
    rows = [(s, i, i * 0.5, float(rng.uniform(30, 400)), float(rng.uniform(0.3, 1)), 0.5, None if i % 7 else float(i), 0.0, 0.0, None if i % 5 else 2.0) for s in (1, 2) for i in range(50)]
    metrics = spark.createDataFrame(rows, "session_id long, frame_idx long, timestamp_s double, sharpness double, exposure double, feature_quality double, e double, n double, u double, speed double")
    pairs = [(s, j, i, float(rng.uniform(0.5, 1)), 0.4, float(rng.uniform(0, 40))) for s in (1, 2) for i in range(50) for j in range(max(0, i - 6), i)]
    pairs = spark.createDataFrame(pairs, "session_id long, prev_idx long, frame_idx long, overlap double, parallax double, motion_px double")
    want = fr.select_keyframes(metrics, pairs, 9).drop("composite_score")
    rows = fr.keyframe_inputs(metrics, pairs).withColumn("event_time", F.timestamp_micros(((F.col("timestamp_s") + 1000) * 1e6).cast("long")))
    late = rows.withColumn("arrives", shuffled_within(4.0).alias("arrives")) if "pos" in rows.columns else rows.withColumn("pos", F.col("frame_idx")).withColumn("arrives", shuffled_within(4.0)).drop("pos")
    got = run_stream(spark, late, lambda s: stateful.stream_keyframes(s.drop("arrives"), "4 seconds"), "arrives")
    key = lambda df: sorted((tuple(r) for r in df.select(*sorted(want.columns)).collect()), key=str)
    assert key(got) == key(want) and got.where("is_selected").count() > 4


def test_waiting_events_lie_in_lists_of_their_span():
    """An arriving batch appends to the list of its span and sets one timer for it; a timer empties that list alone."""

    class Kept:
        def __init__(self):
            self.rows = []

        def appendList(self, rows):
            self.rows += rows

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

    class Handle:
        def __init__(self):
            self.lists, self.timers = [], []

        def getListState(self, name, schema):
            self.lists.append(Kept())
            return self.lists[-1]

        def getValueState(self, name, schema):
            return Value()

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, t):
            self.timers.append(t)

    class Expired:
        def __init__(self, t):
            self.t = t

        def getExpiryTimeInMs(self):
            return self.t

    import pandas as pd

    add = lambda v, e: ({"sum": v["sum"] + e["x"]}, {"at": e["event_ms"], "sum": v["sum"] + e["x"]})
    steps = stateful.OrderedSteps("k", [("x", "double")], ["event_ms"], [("sum", "double")], lambda: {"sum": 0.0}, add, ["k", "at", "sum"], 100)
    handle = Handle()
    steps.init(handle)
    for start in (0, 150, 820):  # 820 shares the list of span 0
        assert not list(steps.handleInputRows((1,), iter([pd.DataFrame({"event_ms": [start + 30, start + 10], "x": [1.0, 2.0]})]), None))
    assert sorted(handle.timers) == [100, 200, 900] and sum(len(x.rows) for x in handle.lists) == 6
    first = pd.concat(steps.handleExpiredTimer((1,), None, Expired(100)))
    assert first["at"].tolist() == [10, 30] and first["sum"].tolist() == [2.0, 3.0] and len(handle.lists[0].rows) == 2
    assert pd.concat(steps.handleExpiredTimer((1,), None, Expired(200)))["sum"].tolist() == [5.0, 6.0]
    assert pd.concat(steps.handleExpiredTimer((1,), None, Expired(900)))["at"].tolist() == [830, 850] and not handle.lists[0].rows
