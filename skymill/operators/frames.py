"""Frame selection: sampling, quality gates, duplicates and keyframes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skymill.operators.ordered import in_order
from skymill.runtime import cut, renew

SESSION = ["session_id"]
FRAME = ["session_id", "frame_idx"]


def sample_at_rate(frames: DataFrame, fps: str = "fps", target_fps: float = 2.0) -> DataFrame:
    """every n-th frame so that about ``target_fps`` remain, with its time."""
    n = F.greatest(F.lit(1), F.rint(F.col(fps) / target_fps).cast("long"))
    return frames.where(F.col("frame_idx") % n == 0).withColumn("timestamp_s", F.col("frame_idx") / F.col(fps))


def blur_gate(threshold: float = 100.0, score: str = "blur_score") -> Column:
    """drop reason of the first gate; a frame without a score was unreadable."""
    return F.when(F.col(score).isNull(), "unreadable_file").when(F.col(score) < threshold, "blurry")


def keyframe_gate(min_sharpness: float = 50.0, min_exposure: float = 0.40) -> Column:
    """F3 and F4 as keyframe selection applies them."""
    return F.when(F.col("sharpness") < min_sharpness, "blur_detected").when(F.col("exposure") < min_exposure, "poor_exposure")


def motion_blur_pct(metrics: DataFrame, keys: list[str] = SESSION, digits: int = 1) -> DataFrame:
    """Share of motion blur implied by mean sharpness (120 where nothing was sampled)."""
    mean = F.coalesce(F.avg("sharpness"), F.lit(120.0))
    pct = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (1.0 - F.least(mean / 150.0, F.lit(1.0))) * 25.0))
    return metrics.groupBy(*keys).agg(F.bround(mean, digits).alias("blur_score"), F.bround(pct, digits).alias("motion_blur_pct"))


# --- near duplicates ----------------------------------------------------------------------------


def _hash_keys(hashes: DataFrame, threshold: int, bits: int, bands: int | None, hot: int) -> DataFrame:
    """``session_id, frame_idx, phash, _key``: any two hashes of a session within ``threshold`` bits share a key.

    The hash is cut into bands; a pair within the threshold must agree on all but ``threshold`` of them, so every choice
    of the remaining bands is a blocking key, and none is missed. Keys that still gather more than ``hot`` hashes are split
    further by the other bits in the same way. Keys of one hash are left out.
    """
    n = bands or min(bits, threshold + 2)
    edges = [bits * i // n for i in range(n + 1)]

    def key(h: Column, lo: int, hi: int) -> Column:
        return F.shiftrightunsigned(h, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1))

    h = F.col("phash")
    choices = list(combinations(range(n), n - threshold))
    blocks = F.array(*[F.xxhash64(F.lit(c), *[key(h, edges[i], edges[i + 1]) for i in pick]) for c, pick in enumerate(choices)])
    # the number of the choice that made the block, kept for splitting hot ones by the bits it left open
    base = hashes.select(*FRAME, "phash", F.posexplode(blocks).alias("_c", "_k"))
    sizes = base.groupBy(*SESSION, "_c", "_k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    tagged = base.join(sizes, [*SESSION, "_c", "_k"])
    light = tagged.where(F.col("_n") <= hot).select(*FRAME, "phash", F.xxhash64("_c", "_k").alias("_key"))
    # bits a choice left open, dealt into threshold + 1 strands: within the threshold one strand is equal
    masks = []
    for pick in choices:
        left = [b for i in range(n) if i not in pick for b in range(edges[i], edges[i + 1])]
        strands = [sum(1 << b for b in left[s :: threshold + 1]) for s in range(threshold + 1)]
        masks.append(F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long") for m in strands]))
    heavy = tagged.where(F.col("_n") > hot).select(*FRAME, "phash", "_c", "_k", F.posexplode(F.get(F.array(*masks), F.col("_c"))).alias("_s", "_m"))
    heavy = heavy.select(*FRAME, "phash", F.xxhash64("_c", "_k", "_s", F.col("phash").bitwiseAND(F.col("_m"))).alias("_key"))
    return light.unionByName(heavy)


def hash_pairs(hashes: DataFrame, threshold: int, bits: int = 64, bands: int | None = None, hot: int = 2000) -> DataFrame:
    """Pairs of distinct hashes of a session that differ in at most ``threshold`` bits: ``a`` first seen before ``b``."""
    keyed = _hash_keys(hashes, threshold, bits, bands, hot)
    a = keyed.select(*SESSION, "_key", F.col("frame_idx").alias("a"), F.col("phash").alias("ha"))
    b = keyed.select(*SESSION, "_key", F.col("frame_idx").alias("b"), F.col("phash").alias("hb"))
    close = a.join(b, [*SESSION, "_key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) <= threshold))
    return close.select(*SESSION, "a", "b").distinct()


def _settled(rows: DataFrame, threshold: int) -> DataFrame:
    """``session_id, _slice, phash`` of the hashes that stay when each slice is walked on its own: those that are not
    ``blocked`` and not within ``threshold`` bits of one that stayed before in the slice."""
    names = [*SESSION, "_slice", "phash"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def walk_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, n = None, np.zeros(64, np.uint64), 0
        for pdf in batches:
            stays = np.zeros(len(pdf), dtype=bool)
            hashes = pdf["phash"].to_numpy(np.int64).view(np.uint64)
            for i, (session, part, blocked) in enumerate(zip(pdf["session_id"], pdf["_slice"], pdf["blocked"])):
                if (session, part) != now:
                    now, n = (session, part), 0
                if blocked or (np.bitwise_count(held[:n] ^ hashes[i]) <= threshold).any():
                    continue
                if n == len(held):
                    held = np.concatenate([held, held])
                held[n] = hashes[i]
                n += 1
                stays[i] = True
            yield pdf.loc[stays, names]

    ordered = in_order(rows.select(*names, "frame_idx", "blocked"), [*SESSION, "_slice"], ["frame_idx", "phash"])
    return ordered.mapInPandas(walk_slices, ", ".join(f"{c} {kinds[c]}" for c in names))


def drop_near_duplicates(frames: DataFrame, threshold: int = 5, bits: int = 64, slice_frames: int = 2000) -> DataFrame:
    """Greedy in frame order: a frame within ``threshold`` bits of an earlier kept frame is dropped and names the
    first such frame. Frames without a hash are kept.

    Equal hashes share their first frame's fate, so only distinct hashes are compared (in the order of frame, then hash).
    A session is cut into slices of ``slice_frames``. Every slice is walked as if no earlier slice kept anything;
    then each looks up, through the blocking keys, which of its hashes are close to one that an earlier slice keeps, and is
    walked again if that set has changed, until none does. The first slice is right at once and each right slice
    settles the next, so there are at most as many rounds as slices, and a chain of close frames costs no round of its own.
    Close pairs are never written: the look-ups are semi-joins, and a dropped hash has few kept ones near it, since
    these are apart from each other.
    """
    part = F.floor(F.col("frame_idx") / slice_frames).cast("long").alias("_slice")
    known = frames.where(F.col("phash").isNotNull())
    first = cut(known.groupBy(*SESSION, "phash").agg(F.min("frame_idx").alias("frame_idx")).select("*", part))
    index = cut(_hash_keys(first.select(*FRAME, "phash"), threshold, bits, None, 2000).select("*", part))
    of_hash, of_slice = [*SESSION, "phash"], [*SESSION, "_slice"]
    met = (F.col("session_id") == F.col("_session")) & (F.col("_key") == F.col("_kept_key"))
    met = met & (F.bit_count(F.col("phash").bitwiseXOR(F.col("_kept_hash"))) <= threshold)

    def kept_keys(kept: DataFrame) -> DataFrame:
        rows = index.join(renew(kept.select(*of_hash)), of_hash, "left_semi")
        return rows.select(
            F.col("session_id").alias("_session"), F.col("_key").alias("_kept_key"), F.col("phash").alias("_kept_hash"),
            F.col("_slice").alias("_kept_slice"), F.col("frame_idx").alias("_kept_frame"),
        )

    kept = cut(_settled(first.withColumn("blocked", F.lit(False)), threshold))
    blocked = cut(first.select(*of_slice, "phash").where(F.lit(False)))
    start = cut(first.groupBy(*SESSION).agg(F.min("_slice").alias("_from")))  # later slices are looked at again
    while True:
        later = lambda df: df.join(start, SESSION).where(F.col("_slice") > F.col("_from")).drop("_from")  # noqa: B023, E731
        now = later(index).join(kept_keys(kept), met & (F.col("_kept_slice") < F.col("_slice")), "left_semi")
        now = cut(now.select(*of_slice, "phash").distinct())
        both = now.withColumn("_d", F.lit(1)).unionByName(later(blocked).withColumn("_d", F.lit(-1)))
        changed = cut(both.groupBy(*of_slice, "phash").agg(F.sum("_d").alias("_d")).where("_d <> 0").select(*of_slice).distinct())
        if changed.isEmpty():
            break
        earlier = blocked.join(start, SESSION, "left").where(F.col("_from").isNull() | (F.col("_slice") <= F.col("_from"))).drop("_from")
        blocked = cut(earlier.unionByName(now))
        flags = blocked.select(*of_hash).withColumn("_b", F.lit(True))
        again = first.join(changed, of_slice, "left_semi").join(flags, of_hash, "left").withColumn("blocked", F.coalesce("_b", F.lit(False)))
        kept = cut(kept.join(changed, of_slice, "left_anti").unionByName(_settled(again, threshold)))
        start = cut(changed.groupBy(*SESSION).agg(F.min("_slice").alias("_from")))
    gone = index.join(renew(kept.select(*of_hash)), of_hash, "left_anti")
    before = F.struct("_kept_frame", "_kept_hash") < F.struct("frame_idx", "phash")
    origin = gone.join(kept_keys(kept), met & before).groupBy(*of_hash).agg(F.min("_kept_frame").alias("_anchor"))
    decided = first.select(*of_hash, F.col("frame_idx").alias("_first")).join(cut(origin), of_hash, "left")
    out = frames.join(decided, of_hash, "left")
    stays = F.col("_anchor").isNull() & F.coalesce(F.col("frame_idx") == F.col("_first"), F.lit(True))
    out = out.withColumn("kept", stays).withColumn("duplicate_of", F.when(~stays, F.coalesce("_anchor", "_first")))
    return out.drop("_first", "_anchor")


def filter_frames(frames: DataFrame, blur_threshold: float = 100.0, threshold: int = 5, bits: int = 64) -> DataFrame:
    """Blur gate, then duplicates among the sharp frames; every frame comes back with its drop reason."""
    gated = frames.withColumn("drop_reason", blur_gate(blur_threshold))
    sharp = drop_near_duplicates(gated.where(F.col("drop_reason").isNull()).drop("drop_reason"), threshold, bits)
    sharp = sharp.withColumn("drop_reason", F.when(~F.col("kept"), "near_duplicate"))
    rest = gated.where(F.col("drop_reason").isNotNull()).withColumns({"kept": F.lit(False), "duplicate_of": F.lit(None).cast("long")})
    return sharp.unionByName(rest.select(*sharp.columns))


def filter_report(filtered: DataFrame) -> DataFrame:
    """Frames in, kept, dropped for blur, dropped as duplicates."""
    return filtered.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("n_input_frames"),
        F.count_if("kept").alias("n_kept"),
        F.count_if(F.col("drop_reason") == "blurry").alias("n_dropped_blur"),
        F.count_if(F.col("drop_reason") == "near_duplicate").alias("n_dropped_duplicate"),
    )


def selection_manifest(report: DataFrame, gaps: DataFrame) -> DataFrame:
    """Selection counts beside the flight-path check, and one summary line."""
    df = report.join(gaps, SESSION, "left")
    line = F.format_string(
        "of %d frames %d stay; %d were blurry, %d near duplicates", "n_input_frames", "n_kept", "n_dropped_blur", "n_dropped_duplicate"
    )
    return df.withColumn("summary", line)


# --- keyframes ----------------------------------------------------------------------------------

# --- fixed values: keyframe policy --------------------------------------------------------------
MAX_OVERLAP = 0.85
MIN_BASELINE_M = 0.5
FLOW_PX_TO_M = 0.02
# --- end of fixed values ------------------------------------------------------------------------


def composite_score(sharpness, exposure, features, parallax, baseline_m, stability):
    """W7 on columns."""
    return (
        0.20 * F.least(F.lit(1.0), sharpness / 500.0)
        + 0.10 * exposure
        + 0.20 * features
        + 0.20 * parallax
        + 0.15 * F.least(F.lit(1.0), baseline_m / (MIN_BASELINE_M * 3.0))
        + 0.15 * stability
    )


def baseline(last: dict, row: dict, motion_px: float) -> tuple[float, str]:
    """Distance flown since the last keyframe, from the best source there is."""
    if row["e"] is not None and last["e"] is not None:
        gap = sum((row[a] - last[a]) ** 2 for a in ("e", "n", "u")) ** 0.5
        return gap, "GPS"
    if row["speed"] is not None:
        return row["speed"] * max(row["timestamp_s"] - last["timestamp_s"], 0.0), "IMU_VELOCITY"
    return motion_px * FLOW_PX_TO_M, "OPTICAL_FLOW"


def step_keyframes(state: dict | None, row: dict, pair: tuple[float, float, float]) -> tuple[dict | None, dict]:
    """One frame against the last keyframe: new state and the frame's verdict."""
    verdict = {"overlap": 1.0, "parallax": 0.0, "baseline_m": 0.0, "baseline_source": "NONE", "is_selected": False, "rejection_reason": None}
    if row["gate"] is not None:
        return state, verdict | {"rejection_reason": row["gate"]}
    here = {k: row[k] for k in ("frame_idx", "timestamp_s", "e", "n", "u")}
    if state is None:
        return here, verdict | {"baseline_source": "INITIAL_ANCHOR", "is_selected": True}
    overlap, parallax, motion = pair
    dist, source = baseline(state, row, motion)
    seen = {"overlap": overlap, "parallax": parallax, "baseline_m": dist, "baseline_source": source}
    if overlap > MAX_OVERLAP and dist < MIN_BASELINE_M:
        return state, verdict | seen | {"rejection_reason": "redundant_overlap"}
    if row["e"] is None:
        here |= {a: state[a] for a in ("e", "n", "u")}
    return here, verdict | seen | {"is_selected": True}


_STATE = ["frame_idx", "timestamp_s", "e", "n", "u"]
_S_COLS = [f"s_{c}" for c in _STATE]
_V_COLS = "overlap double, parallax double, baseline_m double, baseline_source string, is_selected boolean, rejection_reason string"


def _none(v):
    return None if v is None or v != v else v


def read_state(rec: dict) -> dict | None:
    s = {c: _none(rec.get(f"s_{c}")) for c in _STATE}
    return None if s["frame_idx"] is None else s | {"frame_idx": int(s["frame_idx"])}


def walk(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[dict, dict | None, dict]]:
    """(frame record, state after it, verdict) for rows sorted by slice and frame; a slice starts from its ``s_*`` columns."""
    now, state = None, None
    for pdf in batches:
        for r in pdf.to_dict("records"):
            key = (r["session_id"], r["_chunk"])
            if key != now:
                now, state = key, read_state(r)
            row = {k: _none(r.get(k)) for k in ("timestamp_s", "e", "n", "u", "speed", "gate")} | {"frame_idx": int(r["frame_idx"])}
            pair = (0.0, 0.0, 0.0)
            if state is not None and r["prev_ids"] is not None:
                at = np.flatnonzero(r["prev_ids"] == state["frame_idx"])
                if len(at):
                    pair = (float(r["overlaps"][at[0]]), float(r["parallaxes"][at[0]]), float(r["motions"][at[0]]))
            state, verdict = step_keyframes(state, row, pair)
            yield r, state, verdict


def _end_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["session_id", "_chunk", *_S_COLS]
    ends: list[list] = []
    for r, state, _ in walk(batches):
        s = state or dict.fromkeys(_STATE)
        row = [r["session_id"], r["_chunk"], *[s[c] for c in _STATE]]
        if ends and ends[-1][:2] == row[:2]:
            ends[-1] = row
        else:
            ends.append(row)
    yield pd.DataFrame(ends, columns=names).astype({"s_frame_idx": "Int64"})


def _verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: list[dict] = []
    for r, _, verdict in walk(batches):
        out.append({"session_id": r["session_id"], "frame_idx": int(r["frame_idx"])} | verdict)
        if len(out) >= 5000:
            yield pd.DataFrame(out)
            out = []
    if out:
        yield pd.DataFrame(out)


def keyframe_inputs(metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """Frames with their gate and the metrics of the frames they may be compared with, in look-back order.

    ``pairs``: session_id, prev_idx, frame_idx, overlap, parallax, motion_px, within a bounded look-back.
    """
    near = pairs.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("prev_idx", "overlap", "parallax", "motion_px"))).alias("_p"))
    df = metrics.withColumn("gate", keyframe_gate()).join(near, FRAME, "left")
    for c, t in (("e", "double"), ("n", "double"), ("u", "double"), ("speed", "double")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    return df.select(
        *FRAME, "timestamp_s", "gate", "e", "n", "u", "speed",
        F.col("_p.prev_idx").alias("prev_ids"), F.col("_p.overlap").alias("overlaps"),
        F.col("_p.parallax").alias("parallaxes"), F.col("_p.motion_px").alias("motions"),
    )


def select_keyframes(metrics: DataFrame, pairs: DataFrame, chunk_frames: int = 2000) -> DataFrame:
    """Greedy keyframes against the last selected frame, for sessions of any length.

    A session is cut into slices of ``chunk_frames``. Every slice first runs from a guess (no keyframe yet), then
    again from the state its predecessor ended in, until no slice's starting state changes any more. Selections made from
    different starts meet again within a few frames, so this takes a few rounds rather than one per slice,
    and its end is exactly the sequential result: the first slice's start is known, and each settled slice settles the next.
    """
    df = cut(keyframe_inputs(metrics, pairs).withColumn("_chunk", F.floor(F.col("frame_idx") / chunk_frames).cast("long")))
    key = {f.name: f.dataType.simpleString() for f in df.schema}["session_id"]
    ck = [*SESSION, "_chunk"]
    state_ddl = "s_frame_idx bigint, s_timestamp_s double, s_e double, s_n double, s_u double"
    order = cut(df.select(*ck).distinct())
    prior = cut(_previous_chunk(order))
    none = [F.lit(None).cast("bigint" if c == "frame_idx" else "double").alias(f"s_{c}") for c in _STATE]
    starts = cut(order.select(*ck, *none))
    todo, ends = order, None
    while True:
        rows = df.join(todo, ck, "left_semi").join(starts, ck)
        new = in_order(rows, ck, ["frame_idx"]).mapInPandas(_end_states, f"session_id {key}, _chunk bigint, {state_ddl}")
        ends = cut(new if ends is None else ends.join(todo, ck, "left_anti").unionByName(new))
        handed = prior.join(ends.withColumnRenamed("_chunk", "_prev"), [*SESSION, "_prev"], "left").select(*ck, *_S_COLS)
        was = starts.select(*ck, F.struct(*_S_COLS).alias("_was"))
        changed = cut(renew(handed).join(was, ck).where(~F.struct(*_S_COLS).eqNullSafe(F.col("_was"))).select(*ck))
        starts = cut(handed)
        if changed.isEmpty():
            break
        todo = changed
    out = in_order(df.join(starts, ck), ck, ["frame_idx"]).mapInPandas(_verdicts, f"session_id {key}, frame_idx bigint, {_V_COLS}")
    scored = out.join(metrics, FRAME)
    stability = F.col("semantic_stability") if "semantic_stability" in metrics.columns else F.lit(1.0)
    score = composite_score(F.col("sharpness"), F.col("exposure"), F.col("feature_quality"), F.col("parallax"), F.col("baseline_m"), stability)
    gated = F.col("rejection_reason").isin("blur_detected", "poor_exposure")
    anchor = F.col("baseline_source") == "INITIAL_ANCHOR"
    return scored.select(
        *FRAME, "overlap", "parallax", "baseline_m", "baseline_source", "is_selected", "rejection_reason",
        F.when(gated, 0.0).when(anchor, 1.0).otherwise(score).alias("composite_score"),
    )


def _previous_chunk(order: DataFrame) -> DataFrame:
    """Each slice with the one before it in its session (one row per slice, so a plain window is small)."""
    return order.withColumn("_prev", F.lag("_chunk").over(Window.partitionBy(*SESSION).orderBy("_chunk")))
