"""Sessions of a bucket share calls, lists and timers; each keeps its own running value."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skymill.operators import frames as fr
from skymill.plans.stream_queries import run_stream
from skymill.streaming import stateful


class Kept:
    def __init__(self):
        self.entries = []

    def appendValue(self, entry):
        self.entries.append(entry)

    def get(self):
        return iter(list(self.entries))

    def clear(self):
        self.entries = []


class Values(dict):
    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value


class Handle:
    def __init__(self):
        self.named, self.values, self.timers = {}, Values(), []

    def getListState(self, name, schema):
        return self.named.setdefault(name, Kept())

    def getMapState(self, name, key, schema):
        return self.values

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, t):
        self.timers.append(t)


class At:
    def __init__(self, t):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: t


def test_one_wake_up_applies_the_spans_that_are_over_for_all_keys_of_a_bucket():
    add = lambda v, e: (v, None) if e["x"] is None else ({"sum": v["sum"] + e["x"]}, {"at": e["event_ms"], "sum": v["sum"] + e["x"]})
    steps = stateful.SharedSteps("k", [("k", "long"), ("x", "double")], ["x"], [("sum", "double")], lambda: {"sum": 0.0}, add, ["k", "at", "sum"], 100)
    handle = Handle()
    steps.init(handle)
    rows = pd.DataFrame({"event_ms": [30, 10, 150, 155, 250, 820], "k": [1, 2, 1, 2, 1, 2], "x": [1.0, 2.0, 3.0, None, 5.0, 6.0]})
    assert not list(steps.handleInputRows((0,), iter([rows]), None))
    assert sorted(handle.timers) == [100, 200, 300, 900] and sum(len(x.entries) for x in handle.named.values()) == 4
    got = pd.concat(steps.handleExpiredTimer((0,), At(220), At(100)))
    assert got[["k", "at", "sum"]].values.tolist() == [[1, 30, 1.0], [2, 10, 2.0], [1, 150, 4.0]]
    assert not list(steps.handleExpiredTimer((0,), At(220), At(200)))  # was done with the timer before
    steps.init(handle)  # the next batch
    got = pd.concat(steps.handleExpiredTimer((0,), At(1000), At(300)))
    assert got[["k", "at", "sum"]].values.tolist() == [[1, 250, 9.0], [2, 820, 8.0]] and not any(x.entries for x in handle.named.values())


def test_many_sessions_and_the_null_one(spark):
    """More sessions than buckets, ids beyond 2**53, and a session without an id."""
    rng = np.random.default_rng(5)
    ids = [None, *(2**60 + i for i in range(40))]
    rows = [(s, i, i * 0.5, float(rng.uniform(30, 400)), 0.5, 0.5, float(i), 0.0, 0.0, 1.0) for s in ids for i in range(6)]
    metrics = spark.createDataFrame(rows, "session_id long, frame_idx long, timestamp_s double, sharpness double, exposure double, feature_quality double, e double, n double, u double, speed double")
    pairs = spark.createDataFrame([(2**60, 0, 1, 0.9, 0.4, 3.0)], "session_id long, prev_idx long, frame_idx long, overlap double, parallax double, motion_px double")
    events = fr.keyframe_inputs(metrics, pairs).withColumn("event_time", F.timestamp_micros(((F.col("timestamp_s") + 1000) * 1e6).cast("long")))
    events = events.unionByName(events.where("session_id = %d" % 2**60).withColumn("session_id", F.lit(None).cast("long")))
    had, stateful.BUCKETS = stateful.BUCKETS, 7
    try:
        got = run_stream(spark, events, lambda s: stateful.stream_keyframes(s, "4 seconds"), "timestamp_s").collect()
    finally:
        stateful.BUCKETS = had
    by_id = {}
    for r in got:
        by_id.setdefault(r["session_id"], []).append(r["frame_idx"])
    want = events.groupBy("session_id").agg(F.sort_array(F.collect_list("frame_idx"))).collect()
    assert {s: sorted(f) for s, f in by_id.items()} == {s: f for s, f in want} and None in by_id
