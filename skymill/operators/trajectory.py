"""Sensor-fused flight trajectories: an extended Kalman filter that does not run one session in one task.

Attitude is integrated from the gyro alone, so it is a prefix sum. With attitude known, each axis is a
two-state (position, velocity) linear filter with known input, and linear Kalman steps compose associatively:
the effect of a slice of events is five small terms (A, b, C, eta, J), whatever state it starts from
(Sarkka and Garcia-Fernandez, 2021). So every (session, chunk) slice is summarised in parallel, the short list of
summaries is folded to the state at each slice's start, and every slice is filtered in parallel from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymill.functions.camera import R_NAMES, euler_rotation
from skymill.operators.ordered import CHUNK, in_order, previous_row, running_sum
from skymill.operators.telemetry import EVENT_ORDER, event_stream
from skymill.runtime import cut

SESSION = ["session_id"]
AXES = ("e", "n", "u")

# --- fixed values: noise model ------------------------------------------------------------------
ACCEL_NOISE = 0.2
GPS_ACCURACY_M = 1.0
BARO_ACCURACY_M = 0.5
GRAVITY = 9.80665
MAX_STEP_S = 1.0
START_VARIANCE = (4.0, 1.0)
# --- end of fixed values ------------------------------------------------------------------------

GPS_VARIANCE = np.array([1.0, 1.0, 2.0]) * GPS_ACCURACY_M**2
BARO_VARIANCE = BARO_ACCURACY_M**2

_ELEMENT = [f"{n}{a}" for n in ("a00", "a01", "a10", "a11", "b0", "b1", "c00", "c01", "c11", "h0", "h1", "j00", "j01", "j11") for a in AXES]
_STATE = [f"{n}{a}" for n in ("p", "v", "ppp", "ppv", "pvv") for a in AXES]


def start_state() -> tuple[np.ndarray, np.ndarray]:
    """Mean (axis, 2) and covariance (axis, 2, 2) before any event."""
    return np.zeros((3, 2)), np.tile(np.diag(START_VARIANCE), (3, 1, 1))


def process_noise(dt: float) -> np.ndarray:
    return np.array([(0.5 * ACCEL_NOISE * dt * dt) ** 2, (ACCEL_NOISE * dt) ** 2])


def predict(m: np.ndarray, p: np.ndarray, dt: float, acc: np.ndarray) -> None:
    """Advance all axes in place under constant world acceleration."""
    m[:, 0] += m[:, 1] * dt + 0.5 * acc * dt * dt
    m[:, 1] += acc * dt
    q = process_noise(dt)
    p[:, 0, 0] += dt * (p[:, 0, 1] + p[:, 1, 0]) + dt * dt * p[:, 1, 1] + q[0]
    p[:, 0, 1] += dt * p[:, 1, 1]
    p[:, 1, 0] = p[:, 0, 1]
    p[:, 1, 1] += q[1]


def update(m: np.ndarray, p: np.ndarray, axes: slice, z: np.ndarray, r: np.ndarray) -> None:
    """Position measurement on the given axes, in place."""
    s = p[axes, 0, 0] + r
    k = p[axes, :, 0] / s[:, None]
    m[axes] += k * (z - m[axes, 0])[:, None]
    p[axes] -= k[:, :, None] * p[axes, 0:1, :]


def place(m: np.ndarray, p: np.ndarray, z: np.ndarray) -> None:
    """First fix: position and its variance are set, velocity is left alone."""
    m[:, 0] = z
    p[:, 0, 0] = GPS_VARIANCE


def _identity() -> dict[str, np.ndarray]:
    return {
        "A": np.tile(np.eye(2), (3, 1, 1)), "b": np.zeros((3, 2)), "C": np.zeros((3, 2, 2)),
        "h": np.zeros((3, 2)), "J": np.zeros((3, 2, 2)),
    }


def _observe(el: dict[str, np.ndarray], axes: slice, z: np.ndarray, r: np.ndarray) -> None:
    a0 = el["A"][axes, 0, :].copy()
    s = el["C"][axes, 0, 0] + r
    miss = z - el["b"][axes, 0]
    el["J"][axes] += a0[:, :, None] * a0[:, None, :] / s[:, None, None]
    el["h"][axes] += a0 * (miss / s)[:, None]
    k = el["C"][axes, :, 0] / s[:, None]
    el["A"][axes] -= k[:, :, None] * a0[:, None, :]
    el["b"][axes] += k * miss[:, None]
    el["C"][axes] -= k[:, :, None] * el["C"][axes, 0:1, :]


def _advance(el: dict[str, np.ndarray], dt: float, acc: np.ndarray) -> None:
    step = np.array([[1.0, dt], [0.0, 1.0]])
    el["A"] = step @ el["A"]
    el["b"] = el["b"] @ step.T
    el["b"][:, 0] += 0.5 * acc * dt * dt
    el["b"][:, 1] += acc * dt
    el["C"] = step @ el["C"] @ step.T + np.diag(process_noise(dt))


def _apply(el: dict[str, np.ndarray], m: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gain = np.linalg.inv(np.eye(2) + p @ el["J"])
    m1 = np.einsum("aij,aj->ai", gain, m + np.einsum("aij,aj->ai", p, el["h"]))
    p1 = gain @ p
    return np.einsum("aij,aj->ai", el["A"], m1) + el["b"], el["A"] @ p1 @ np.swapaxes(el["A"], 1, 2) + el["C"]


def _pack(el: dict[str, np.ndarray]) -> np.ndarray:
    a, c, j = el["A"], el["C"], el["J"]
    return np.concatenate(
        [a[:, 0, 0], a[:, 0, 1], a[:, 1, 0], a[:, 1, 1], el["b"][:, 0], el["b"][:, 1], c[:, 0, 0], c[:, 0, 1], c[:, 1, 1],
         el["h"][:, 0], el["h"][:, 1], j[:, 0, 0], j[:, 0, 1], j[:, 1, 1]]
    )


def _unpack(v: np.ndarray) -> dict[str, np.ndarray]:
    g = v.reshape(14, 3)
    sym = lambda x, y, z: np.stack([np.stack([x, y], 1), np.stack([y, z], 1)], 1)
    return {
        "A": np.stack([np.stack([g[0], g[1]], 1), np.stack([g[2], g[3]], 1)], 1), "b": np.stack([g[4], g[5]], 1),
        "C": sym(g[6], g[7], g[8]), "h": np.stack([g[9], g[10]], 1), "J": sym(g[11], g[12], g[13]),
    }


def _pack_state(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.concatenate([m[:, 0], m[:, 1], p[:, 0, 0], p[:, 0, 1], p[:, 1, 1]])


def _unpack_state(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = v.reshape(5, 3)
    return np.stack([g[0], g[1]], 1), np.stack([np.stack([g[2], g[3]], 1), np.stack([g[3], g[4]], 1)], 1)


# Rows arrive sorted by slice and event order, in Arrow batches; a slice may span batches, and a task holds one batch
# and one running slice, never a group.


def _events(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, dict[str, Any], int]]:
    """(slice key, the batch's columns as arrays, row index), in order."""
    for pdf in batches:
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        cols["acc"] = pdf[["we", "wn", "wu"]].to_numpy(float)
        cols["z"] = pdf[["z_e", "z_n", "z_u"]].to_numpy(float)
        for i, key in enumerate(zip(cols["session_id"], cols["phase"], cols[CHUNK])):
            yield key, cols, i


def _summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["session_id", "phase", CHUNK, *_ELEMENT, "f_e", "f_n", "f_u"]
    done: list[list] = []
    now, el, fix = None, _identity(), [np.nan] * 3
    for key, cols, i in _events(batches):
        if key != now:
            if now is not None:
                done.append([*now, *_pack(el), *fix])
                if len(done) >= 2000:
                    yield pd.DataFrame(done, columns=names)
                    done = []
            now, el, fix = key, _identity(), [np.nan] * 3
        kind = cols["kind"][i]
        if kind == "IMU":
            dt = cols["dt"][i]
            if dt == dt:
                _advance(el, dt, cols["acc"][i])
        elif kind == "GPS":
            if cols["is_first_fix"][i]:
                fix = list(cols["z"][i])
            else:
                _observe(el, slice(0, 3), cols["z"][i], GPS_VARIANCE)
        elif kind == "BARO":
            _observe(el, slice(2, 3), cols["z"][i, 2:3], np.array([BARO_VARIANCE]))
    if now is not None:
        done.append([*now, *_pack(el), *fix])
    yield pd.DataFrame(done, columns=names)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slice summaries in order -> state at the start of every slice."""
    now, (m, p) = None, start_state()
    for pdf in batches:
        elements, fixes = pdf[_ELEMENT].to_numpy(float), pdf[["f_e", "f_n", "f_u"]].to_numpy(float)
        out = []
        for session, v, z in zip(pdf["session_id"], elements, fixes):
            if session != now:
                now, (m, p) = session, start_state()
            out.append(_pack_state(m, p))
            m, p = _apply(_unpack(v), m, p)
            if not np.isnan(z).any():
                place(m, p, z)
        yield pd.concat([pdf[["session_id", "phase", CHUNK]].reset_index(drop=True), pd.DataFrame(out, columns=_STATE)], axis=1)


def _filter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["session_id", "frame_idx", "timestamp_s", "roll", "pitch", "yaw", *_OUT]
    out: list[list] = []
    now, m, p = None, None, None
    for key, cols, i in _events(batches):
        if key != now:
            now = key
            m, p = _unpack_state(np.array([cols[c][i] for c in _STATE], dtype=float))
        kind = cols["kind"][i]
        if kind == "IMU":
            dt = cols["dt"][i]
            if dt == dt:
                predict(m, p, dt, cols["acc"][i])
        elif kind == "GPS":
            if cols["is_first_fix"][i]:
                place(m, p, cols["z"][i])
            else:
                update(m, p, slice(0, 3), cols["z"][i], GPS_VARIANCE)
        elif kind == "BARO":
            update(m, p, slice(2, 3), cols["z"][i, 2:3], np.array([BARO_VARIANCE]))
        else:
            head = [cols[c][i] for c in ("session_id", "pos", "timestamp_s", "roll", "pitch", "yaw")]
            out.append([*head, *m[:, 0], *m[:, 1], *p[:, 0, 0]])
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=names)
                out = []
    yield pd.DataFrame(out, columns=names)


_OUT = ["e", "n", "u", "ve", "vn", "vu", "var_e", "var_n", "var_u"]


def prepared_events(imu: DataFrame, frames: DataFrame, chunk_s: float) -> DataFrame:
    """The event stream with IMU step, attitude, world acceleration, measurement, and slice keys.

    All of it is prefix sums and lags over (session, chunk): no Python and no session-wide window.
    """
    steps = previous_row(imu, SESSION, ["timestamp_s", "seq"], ["timestamp_s"], chunk_s)
    dt = F.col("timestamp_s") - F.col("prev.timestamp_s")
    steps = cut(steps.withColumn("dt", F.when((dt > 0) & (dt <= MAX_STEP_S), dt)).drop("prev"))
    ev = event_stream(steps, frames)
    ev = cut(ev.join(steps.select(*SESSION, F.col("seq").cast("long").alias("pos"), F.lit(0).alias("rank"), "dt"), [*SESSION, "pos", "rank"], "left"))

    def turned(c: str):
        return F.coalesce(F.col(c) * F.col("dt"), F.lit(0.0))

    ev = running_sum(ev, SESSION, EVENT_ORDER, {"roll": turned("gx"), "pitch": turned("gy"), "yaw": turned("gz")}, chunk_s)
    ev = euler_rotation(ev, "roll", "pitch", "yaw")
    body = [F.col(c) for c in ("ax", "ay", "az")]
    acc = [sum((F.col(f"r{i}{j}") * body[j] for j in range(1, 3)), F.col(f"r{i}0") * body[0]) for i in range(3)]
    ev = ev.withColumns({"we": acc[0], "wn": acc[1], "wu": acc[2] - GRAVITY}).drop(*R_NAMES)
    order = F.struct(*EVENT_ORDER)
    first = ev.where(F.col("kind") == "GPS").groupBy(*SESSION).agg(F.min(order).alias("_first"))
    ev = ev.join(first, SESSION, "left")
    return ev.select(
        *SESSION,
        CHUNK,
        *EVENT_ORDER,
        "kind",
        "dt",
        "we",
        "wn",
        "wu",
        F.col("e").alias("z_e"),
        F.col("n").alias("z_n"),
        F.coalesce("u", "altitude_m").alias("z_u"),
        "roll",
        "pitch",
        "yaw",
        F.coalesce((F.col("kind") == "GPS") & (order == F.col("_first")), F.lit(False)).alias("is_first_fix"),
        F.when(F.col("_first").isNull() | (order <= F.col("_first")), 0).otherwise(1).alias("phase"),
    )


def estimate_trajectory(
    imu: DataFrame,
    frames: DataFrame,
    chunk_s: float = 60.0,
    baro_datum: str = "origin",
) -> DataFrame:
    """Position, velocity, rotation and position variance at every frame of every session.

    ``frames`` are synchronised frames with ``e, n, u`` (NULL without GPS), ``altitude_m`` and ``origin_alt``. Barometric
    altitude is taken relative to the origin unless ``baro_datum`` is ``absolute``. Sessions with neither fixes nor IMU pass
    through at rest.
    """
    if baro_datum == "origin":
        frames = frames.withColumn("altitude_m", F.col("altitude_m") - F.coalesce("origin_alt", F.lit(0.0)))
    frames = cut(frames)
    moving = imu.select(*SESSION).unionByName(frames.where(F.col("e").isNotNull()).select(*SESSION)).distinct()
    fused = frames.join(moving, SESSION, "left_semi")
    events = cut(prepared_events(imu.join(frames.select(*SESSION).distinct(), SESSION, "left_semi"), fused, chunk_s))
    key = {f.name: f.dataType.simpleString() for f in events.schema}["session_id"]
    keys = [*SESSION, "phase", CHUNK]
    el_schema = f"session_id {key}, phase int, {CHUNK} bigint, " + ", ".join(f"{c} double" for c in (*_ELEMENT, "f_e", "f_n", "f_u"))
    elements = cut(in_order(events, keys, EVENT_ORDER).mapInPandas(_summarise, el_schema))
    st_schema = f"session_id {key}, phase int, {CHUNK} bigint, " + ", ".join(f"{c} double" for c in _STATE)
    # one row per slice is left: folding them streams through a session in order
    starts = cut(in_order(elements, SESSION, ["phase", CHUNK]).mapInPandas(_fold, st_schema))
    out_schema = f"session_id {key}, frame_idx bigint, timestamp_s double, roll double, pitch double, yaw double, " + ", ".join(f"{c} double" for c in _OUT)
    states = in_order(events.join(starts, keys), keys, EVENT_ORDER).mapInPandas(_filter, out_schema)
    states = euler_rotation(states, "roll", "pitch", "yaw").select(*SESSION, "frame_idx", "timestamp_s", *_OUT, *R_NAMES)
    zero = {c: F.lit(0.0) for c in ("ve", "vn", "vu")} | {c: F.lit(1.0) for c in ("var_e", "var_n", "var_u")}
    unit = {f"r{i}{j}": F.lit(1.0 if i == j else 0.0) for i in range(3) for j in range(3)}
    still = frames.join(moving, SESSION, "left_anti").select(
        *SESSION, F.col("frame_idx").cast("long").alias("frame_idx"), "timestamp_s", *[F.coalesce(a, F.lit(0.0)).alias(a) for a in AXES]
    )
    return states.unionByName(still.withColumns(zero | unit))


