"""The two sequential estimators on event streams: same step functions as in batch, keyed state with timers.

Events may arrive out of order within the watermark. They wait in lists, one for each span of event time, and a timer
set at the end of a span wakes it once the watermark has passed: its events are then applied in time order, so a stream
gives the rows that the batch job gives. Event times have to lie after 1970-01-01, where every watermark starts. What waits for a session is bounded by the watermark's delay times the rate of its
events; an arriving batch appends to the lists and never rewrites them. The running estimate is one small value beside
them.

Sessions wait in buckets: calls and look-ups for every session, span and event cost far more than the steps themselves. Lists and
timers are those of a bucket, a batch's events for a span are one entry, and of the spans that are over a wake-up applies as
many as there are lists, one after the other. Only the running values are kept by session.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from skymill.functions.camera import euler_rotation
from skymill.operators import frames as fr
from skymill.operators import trajectory as tj
from skymill.operators.telemetry import EVENT_ORDER

LISTS = 8  # spans of event time that wait in lists of their own; a farther span shares the list of another
SPANS_OF_DELAY = 4
BUCKETS = 1_024  # of sessions; part of a stream's state, so a stream has to go on with the number that it began with


class OrderedSteps(StatefulProcessor):
    """Applies ``step`` to the events of a key in time order, one span of event time after the other.

    ``fields`` (name, type) of an event are kept while it waits. ``step(value, event)`` takes the running value and an event,
    as dictionaries, and returns the value after it and a row to emit, or none. Nulls come first in the order.
    """

    def __init__(self, key: str, fields: list[tuple[str, str]], order: list[str], value: list[tuple[str, str]], start: Callable[[], dict], step: Callable[[dict, dict], tuple[dict, dict | None]], out: list[str], span_ms: int):
        self.key, self.fields, self.order, self.value, self.start, self.step, self.out, self.span_ms = key, fields, order, value, start, step, out, span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ddl = ", ".join(f"{n} {t}" for n, t in [("event_ms", "bigint"), *self.fields])
        self.handle = handle
        self.waiting = [handle.getListState(f"waiting{k}", ddl) for k in range(LISTS)]
        self.now = handle.getValueState("now", ", ".join(f"{n} {t}" for n, t in self.value))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        names, timers = ["event_ms", *[n for n, _ in self.fields]], set()
        for pdf in rows:
            pdf = pdf[names].astype(object)
            pdf = pdf.where(pd.notnull(pdf), None)
            span = (pdf["event_ms"] // self.span_ms).astype("int64")
            for b, part in pdf.groupby(span):
                self._wait(int(b), [tuple(v.tolist() if isinstance(v, np.ndarray) else v for v in r) for r in part.itertuples(index=False, name=None)])
                timers.add((int(b) + 1) * self.span_ms)
        for t in timers - set(self.handle.listTimers()):
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        names, values, made = ["event_ms", *[n for n, _ in self.fields]], {}, []
        for end in self._over(key, expiredTimerInfo.getExpiryTimeInMs(), timerValues):
            events = [dict(zip(names, e)) for e in self._take(end)]
            for e in sorted(events, key=lambda e: [(e[c] is not None, e[c]) for c in self.order]):
                who = self._who(key, e)
                if who not in values:
                    held = self._held(who)
                    values[who] = self.start() if held is None else dict(zip([n for n, _ in self.value], held))
                values[who], row = self.step(values[who], e)
                if row is not None:
                    made.append({self.key: who} | row)
        for who, value in values.items():
            self._hold(who, tuple(value[n] for n, _ in self.value))
        # not a generator: by the time its rows are drawn, the state may stand at another key
        return iter([pd.DataFrame(made, columns=self.out)] if made else [])

    def _over(self, key: tuple, end: int, timerValues: TimerValues) -> Iterator[int]:
        """The ends of the spans to apply when the timer of ``end`` expires."""
        return iter([end])

    def _wait(self, span: int, events: list[tuple]) -> None:
        self.waiting[span % LISTS].appendList(events)

    def _take(self, end: int) -> list[tuple]:
        """The events before ``end`` from the list of its span; what is later stays."""
        waiting = self.waiting[(end // self.span_ms - 1) % LISTS]
        events = list(waiting.get())
        later = [e for e in events if e[0] >= end]
        if later:
            waiting.put(later)
        else:
            waiting.clear()
        return [e for e in events if e[0] < end]

    def _who(self, key: tuple, event: dict):
        return key[0]

    def _held(self, who) -> tuple | None:
        return self.now.get() if self.now.exists() else None

    def _hold(self, who, value: tuple) -> None:
        self.now.update(value)

    def close(self) -> None:
        pass


class SharedSteps(OrderedSteps):
    """The same where a group is a bucket of keys and ``key`` is one of the fields."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.done = handle, {}
        self.waiting = [handle.getListState(f"waiting{k}", "events binary") for k in range(LISTS)]
        self.now = handle.getMapState("now", f"{self.key} {dict(self.fields)[self.key]}", "held binary")

    def _over(self, key: tuple, end: int, timerValues: TimerValues) -> Iterator[int]:
        """All spans that the watermark has passed, as far as each has a list of its own; what their timers find is done."""
        if end <= self.done.get(key, -1):  # by an earlier timer of this batch: all its rows came before its timers
            return iter([])
        over = timerValues.getCurrentWatermarkInMs() // self.span_ms * self.span_ms
        self.done[key] = max(end, min(over, end + (LISTS - 1) * self.span_ms))
        return iter(range(end, self.done[key] + 1, self.span_ms))

    def _wait(self, span: int, events: list[tuple]) -> None:
        self.waiting[span % LISTS].appendValue((pickle.dumps(events),))

    def _take(self, end: int) -> list[tuple]:
        waiting = self.waiting[(end // self.span_ms - 1) % LISTS]
        events = [e for (entry,) in waiting.get() for e in pickle.loads(entry)]
        if events:
            waiting.clear()
            later = [e for e in events if e[0] >= end]
            if later:
                waiting.appendValue((pickle.dumps(later),))
        return [e for e in events if e[0] < end]

    def _who(self, key: tuple, event: dict):
        return event[self.key]

    def _held(self, who) -> tuple | None:
        held = self.now.getValue((who,))
        return None if held is None else pickle.loads(held[0])

    def _hold(self, who, value: tuple) -> None:
        self.now.updateValue((who,), (pickle.dumps(value),))


def _ordered(events: DataFrame, delay: str, fields: list[str], order: list[str], value: list[tuple[str, str]], start: Callable[[], dict], step: Callable, out: str) -> DataFrame:
    """``step`` over the events of each session; the state needs the RocksDB provider."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    types = dict(events.dtypes)
    delay_ms = spark.sql(f"SELECT CAST(unix_millis(timestamp'1970-01-02 00:00:00' + INTERVAL {delay}) - unix_millis(timestamp'1970-01-02 00:00:00') AS BIGINT)").first()[0]
    names = ["session_id", *[c.split()[0] for c in out.split(", ")]]
    # ids as text: beside a null, pandas holds long ones as floats
    kept = [("session_id", "string"), *[(f, types[f]) for f in fields]]
    steps = SharedSteps("session_id", kept, order, value, start, step, names, max(delay_ms // SPANS_OF_DELAY, 1))
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int")
    marked = events.withWatermark("event_time", delay).withColumns({"event_ms": F.unix_millis("event_time"), "_bucket": bucket, "session_id": F.col("session_id").cast("string")})
    made = marked.groupBy("_bucket").transformWithStateInPandas(steps, f"session_id string, {out}", "Append", "EventTime")
    return made.withColumn("session_id", F.col("session_id").cast(types["session_id"]))


# --- trajectory ---------------------------------------------------------------------------------

_POSE = ["frame_idx", "timestamp_s", "roll", "pitch", "yaw", *tj._OUT]
_FILTER = [*tj._STATE, "roll", "pitch", "yaw", "last_s"]


def _start_filter() -> dict:
    state = tj._pack_state(*tj.start_state()).tolist()
    return dict(zip(_FILTER, [*state, 0.0, 0.0, 0.0, None])) | {"fixed": False}


def _rotation(roll: float, pitch: float, yaw: float) -> np.ndarray:
    (cr, cp, cy), (sr, sp, sy) = np.cos([roll, pitch, yaw]), np.sin([roll, pitch, yaw])
    return np.array(
        [
            [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr],
            [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
            [-sp, cp * sr, cp * cr],
        ]
    )


def _step_filter(at: dict, e: dict) -> tuple[dict, dict | None]:
    m, p = tj._unpack_state(np.array([at[c] for c in tj._STATE]))
    turn, last, fixed, made = [at["roll"], at["pitch"], at["yaw"]], at["last_s"], at["fixed"], None
    if e["kind"] == "IMU":
        dt = None if last is None else e["timestamp_s"] - last
        last = e["timestamp_s"]
        if dt is not None and 0 < dt <= tj.MAX_STEP_S:
            acc = _rotation(*turn) @ np.array([e["ax"], e["ay"], e["az"]]) - np.array([0.0, 0.0, tj.GRAVITY])
            tj.predict(m, p, dt, acc)
            turn = [a + g * dt for a, g in zip(turn, (e["gx"], e["gy"], e["gz"]))]
    elif e["kind"] == "GPS":
        z = np.array([e["e"], e["n"], e["u"]])
        if fixed:
            tj.update(m, p, slice(0, 3), z, tj.GPS_VARIANCE)
        else:
            tj.place(m, p, z)
            fixed = True
    elif e["kind"] == "BARO":
        tj.update(m, p, slice(2, 3), np.array([e["altitude_m"]]), np.array([tj.BARO_VARIANCE]))
    elif e["kind"] == "FRAME":
        made = dict(zip(_POSE, [int(e["pos"]), e["timestamp_s"], *turn, *m[:, 0], *m[:, 1], *p[:, 0, 0]]))
    return dict(zip(_FILTER, [*tj._pack_state(m, p).tolist(), *turn, last])) | {"fixed": fixed}, made


def stream_trajectory(events: DataFrame, delay: str = "2 seconds") -> DataFrame:
    """ST1: the event stream of ``event_stream`` plus ``event_time`` -> state at every frame, as frames become final.

    Barometer readings are expected relative to the session's origin. Events of no known kind only move the clock. A
    session is never known to stay without fixes and IMU, so one that does has the filter's start values, not those at rest.
    """
    fields = [*EVENT_ORDER, "kind", "ax", "ay", "az", "gx", "gy", "gz", "e", "n", "u", "altitude_m"]
    value = [*((c, "double") for c in _FILTER), ("fixed", "boolean")]
    out = "frame_idx bigint, " + ", ".join(f"{c} double" for c in _POSE[1:])
    states = _ordered(events, delay, fields, EVENT_ORDER, value, _start_filter, _step_filter, out)
    return euler_rotation(states, "roll", "pitch", "yaw").drop("roll", "pitch", "yaw")


# --- keyframes ----------------------------------------------------------------------------------

_LAST = ["frame_idx", "timestamp_s", "e", "n", "u"]


def _step_keyframe(last: dict, e: dict) -> tuple[dict, dict | None]:
    if e["frame_idx"] is None:
        return last, None
    state, pair = None if last["frame_idx"] is None else last, (0.0, 0.0, 0.0)
    if state is not None:
        for prev, *metrics in zip(*(e[c] or () for c in ("prev_ids", "overlaps", "parallaxes", "motions"))):
            if prev == state["frame_idx"]:
                pair = tuple(metrics)
    state, verdict = fr.step_keyframes(state, {k: e[k] for k in (*_LAST, "speed", "gate")}, pair)
    return state or last, {"frame_idx": int(e["frame_idx"])} | verdict


def stream_keyframes(frames: DataFrame, delay: str = "2 seconds") -> DataFrame:
    """ST2: rows of ``keyframe_inputs`` plus ``event_time`` -> verdict per frame. Rows without a frame only move the clock."""
    fields = [*_LAST, "speed", "gate", "prev_ids", "overlaps", "parallaxes", "motions"]
    value = [("frame_idx", "bigint"), *((c, "double") for c in _LAST[1:])]
    return _ordered(frames, delay, fields, ["frame_idx"], value, lambda: dict.fromkeys(_LAST), _step_keyframe, f"frame_idx bigint, {fr._V_COLS}")
