"""Similarity alignment per session: moments in Spark, 3x3 factorisations in one vectorised function per row.

No correspondence set is ever gathered: a session of any size is reduced by mergeable moments first, and only
the moment row reaches numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skymill.functions.camera import R_NAMES, apply_similarity, cols, norm3, rot
from skymill.operators.ordered import row_index
from skymill.operators.quantiles import exact_percentiles
from skymill.runtime import cut, shuffled, spread

SESSION = ["session_id"]
SRC, DST = ("sx", "sy", "sz"), ("dx", "dy", "dz")
T_NAMES = ("t0", "t1", "t2")
TRANSFORM = ("s", *R_NAMES, *T_NAMES)
_SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in TRANSFORM])
MOMENTS = (
    *(f"ms{i}" for i in range(3)),
    *(f"md{i}" for i in range(3)),
    "var_s",
    *(f"c{i}{j}" for i in range(3) for j in range(3)),
)


def _solve(m: np.ndarray) -> np.ndarray:
    """Rows of moments -> rows of (s, R, t); NaN where the source has no spread."""
    out = np.full((len(m), 13), np.nan)
    ok = np.isfinite(m).all(axis=1) & (m[:, 6] > 0)
    if ok.any():
        g = m[ok]
        u, d, vt = np.linalg.svd(g[:, 7:16].reshape(-1, 3, 3))
        flip = np.ones((len(g), 3))
        flip[np.linalg.det(u) * np.linalg.det(vt) < 0, 2] = -1.0
        r = np.einsum("nij,nj,njk->nik", u, flip, vt)
        s = (d * flip).sum(axis=1) / g[:, 6]
        t = g[:, 3:6] - s[:, None] * np.einsum("nij,nj->ni", r, g[:, 0:3])
        out[ok] = np.column_stack([s, r.reshape(-1, 9), t])
    return out


@F.pandas_udf(_SCHEMA)
def _similarity(m: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(_solve(m.to_numpy(dtype=float)), columns=list(TRANSFORM))


def with_transform(moments: DataFrame) -> DataFrame:
    """Adds ``s, r00..r22, t0..t2``; NULL where no transform exists."""
    df = moments.withColumn("_tf", _similarity(F.struct(*MOMENTS)))
    return df.withColumns({c: F.nanvl(F.col(f"_tf.{c}"), F.lit(None).cast("double")) for c in TRANSFORM}).drop("_tf")


def alignment_moments(pairs: DataFrame, keys: list[str] = SESSION, *more: Column) -> DataFrame:
    """G1, first half: means, spread and the nine cross-moments in one map-side-combined pass.

    ``covar_pop`` merges centred partials, so large coordinates lose nothing and no second pass is needed. ``more``:
    further aggregates of the same pass.
    """
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        *[F.avg(c).alias(f"ms{i}") for i, c in enumerate(SRC)],
        *[F.avg(c).alias(f"md{i}") for i, c in enumerate(DST)],
        sum((F.var_pop(c) for c in SRC[1:]), F.var_pop(SRC[0])).alias("var_s"),
        *[F.covar_pop(DST[i], SRC[j]).alias(f"c{i}{j}") for i in range(3) for j in range(3)],
        *more,
    )


def umeyama(pairs: DataFrame, keys: list[str] = SESSION, min_pairs: int = 3) -> DataFrame:
    """G1: least-squares scale, rotation and translation taking ``sx, sy, sz`` to ``dx, dy, dz``."""
    moments = alignment_moments(pairs, keys).where(F.col("n_pairs") >= min_pairs)
    return with_transform(moments).select(*keys, "n_pairs", *TRANSFORM)


def residual(prefix: str = "") -> Column:
    """Distance between a transformed source and its target on one row."""
    moved = apply_similarity(F.col(f"{prefix}s"), rot(prefix), cols(*[f"{prefix}{t}" for t in T_NAMES]), cols(*SRC))
    return norm3([m - d for m, d in zip(moved, cols(*DST))])


def with_residuals(pairs: DataFrame, transforms: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """``residual_m`` per pair."""
    return pairs.join(shuffled(transforms.select(*keys, *TRANSFORM)), keys).withColumn("residual_m", residual()).drop(*TRANSFORM)


def residual_summary(pairs: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """Mean, median, max, population deviation, target extent and relative error."""
    extent = F.sqrt(sum(((F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in DST), F.lit(0.0)))
    stats = pairs.groupBy(*keys).agg(
        F.avg("residual_m").alias("mean_residual_m"),
        F.max("residual_m").alias("max_residual_m"),
        F.stddev_pop("residual_m").alias("std_residual_m"),
        extent.alias("extent_m"),
    )
    return (
        stats.join(exact_percentiles(pairs, keys, "residual_m", {"median_residual_m": 0.5}), keys)
        .withColumn("relative_error_pct", F.try_divide(F.col("mean_residual_m") * 100.0, F.col("extent_m")))
    )


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def match_by_name(poses: DataFrame, fixes: DataFrame, min_matches: int = 3) -> DataFrame:
    """Poses and fixes of a session with the same file name; ``enough`` says whether the session may be aligned."""
    named = fixes.withColumn("_name", basename(F.col("frame_name"))).drop("frame_name")
    matched = poses.withColumn("_name", basename(F.col("name"))).join(named, [*SESSION, "_name"]).drop("_name")
    counts = matched.groupBy(*SESSION).agg((F.count(F.lit(1)) >= min_matches).alias("enough"))
    return matched.join(counts, SESSION)


# --- robust fit ---------------------------------------------------------------------------------

SLICE = 100_000  # pairs of a session that meet its hypotheses in one task


def _draw(n: Column, seed: int, k: int) -> Column:
    return F.pmod(F.xxhash64(F.col("session_id"), F.col("trial"), F.lit(seed), F.lit(k)), n)


def sample_triples(sizes: DataFrame, trials: int, seed: int) -> DataFrame:
    """``trials`` seeded triples of distinct indices below ``n_pairs`` per session, as rows (session, trial, idx)."""
    df = sizes.select(*SESSION, "n_pairs", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    n = F.col("n_pairs")
    df = df.withColumns({"_a": _draw(n, seed, 1), "_b": _draw(n - 1, seed, 2), "_c": _draw(n - 2, seed, 3)})
    df = df.withColumn("_b", F.when(F.col("_b") >= F.col("_a"), F.col("_b") + 1).otherwise(F.col("_b")))
    df = df.withColumns({"_lo": F.least("_a", "_b"), "_hi": F.greatest("_a", "_b")})
    df = df.withColumn("_c", F.when(F.col("_c") >= F.col("_lo"), F.col("_c") + 1).otherwise(F.col("_c")))
    df = df.withColumn("_c", F.when(F.col("_c") >= F.col("_hi"), F.col("_c") + 1).otherwise(F.col("_c")))
    return df.select(*SESSION, "trial", F.explode(F.array("_a", "_b", "_c")).alias("idx"))


def _hypotheses(pairs: DataFrame, sizes: DataFrame, trials: int, seed: int, min_area: float, min_scale: float) -> DataFrame:
    # neither the pairs nor the draws, a row per session that becomes hundreds, are as small as the planner takes them for
    chosen = spread(sample_triples(sizes, trials, seed), *SESSION, "idx").join(shuffled(pairs), [*SESSION, "idx"])
    keys = [*SESSION, "trial"]
    # twice the triangle area from moments: |(p2-p1) x (p3-p1)|^2 = 27 (Vxx Vyy - Vxy^2 + ...)
    area2 = F.lit(0.0)
    for a, b in (("sx", "sy"), ("sx", "sz"), ("sy", "sz")):
        area2 = area2 + F.var_pop(a) * F.var_pop(b) - F.covar_pop(a, b) * F.covar_pop(a, b)
    models = with_transform(alignment_moments(chosen, keys, (area2 * 27.0).alias("_area2")))
    return models.where((F.col("_area2") >= min_area * min_area) & (F.col("s") > min_scale)).select(*keys, *TRANSFORM)


def ransac_similarity(
    pairs: DataFrame,
    order: list[str],
    threshold: str = "inlier_threshold_m",
    min_inliers: int = 3,
    trials: int = 300,
    seed: int = 42,
    chunk: float = 100_000.0,
) -> DataFrame:
    """Robust similarity per session, one row each.

    ``pairs`` carries the session's threshold on each row. Every session's hypotheses (at most ``trials`` short
    rows) travel as one array to each slice of ``SLICE`` of its pairs; scoring explodes them inside the task and combines before
    the shuffle, so a session with a third of all pairs is many tasks and sends few score rows from each. The winner has the most
    inliers, then the lowest mean residual, then the lowest trial. A final reweighting by Huber weights refines it.
    """
    pairs = cut(row_index(pairs, SESSION, order, chunk).select(*SESSION, "idx", threshold, *SRC, *DST))
    sizes = pairs.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n_pairs")).where(F.col("n_pairs") >= 3)
    exact = sizes.where(F.col("n_pairs") > 3)
    models = cut(_hypotheses(pairs, exact, trials, seed, 1e-5, 1e-4))
    packed = models.groupBy(*SESSION).agg(F.collect_list(F.struct("trial", *TRANSFORM)).alias("_h")).join(shuffled(exact), SESSION)
    packed = packed.select(*SESSION, "_h", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_pairs") - 1) / SLICE))).alias("_slice"))
    sliced = pairs.withColumn("_slice", F.floor(F.col("idx") / SLICE))
    tried = sliced.join(shuffled(packed), [*SESSION, "_slice"]).select(*SESSION, threshold, *SRC, *DST, F.explode("_h").alias("_m"))
    tried = tried.select(*SESSION, threshold, *SRC, *DST, "_m.*").withColumn("residual_m", residual())
    scores = (
        tried.where(F.col("residual_m") < F.col(threshold))
        .groupBy(*SESSION, "trial")
        .agg(F.count(F.lit(1)).alias("_in"), F.avg("residual_m").alias("_res"))
    )
    best = scores.groupBy(*SESSION).agg(
        F.max(F.struct(F.col("_in"), (-F.col("_res")).alias("_neg"), (-F.col("trial")).alias("_nt"))).alias("_b")
    )
    best = best.where(F.col("_b._in") >= min_inliers).select(*SESSION, (-F.col("_b._nt")).alias("trial"))
    winner = models.join(shuffled(best), [*SESSION, "trial"]).select(*SESSION, *[F.col(c).alias(f"w_{c}") for c in TRANSFORM])

    held = pairs.join(shuffled(winner), SESSION, "left")
    inlier = F.col("w_s").isNull() | (residual("w_") < F.col(threshold))
    inliers = cut(held.where(inlier).select(*SESSION, F.col("w_s").isNotNull().alias("robust"), *SRC, *DST))
    first = umeyama(inliers)
    scored = with_residuals(inliers, first)
    knees = exact_percentiles(scored, SESSION, "residual_m", {"_k": 0.5}).withColumn("_k", F.greatest("_k", F.lit(1e-3)))
    weighted = scored.join(shuffled(knees), SESSION).withColumn(
        "_w",
        F.when(F.col("robust"), F.least(F.lit(1.0), F.col("_k") / F.greatest(F.col("residual_m"), F.lit(1e-6)))).otherwise(1.0),
    )
    final = with_transform(weighted_moments(weighted, "_w")).select(*SESSION, *TRANSFORM)
    fit = with_residuals(inliers, final).groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("n_inliers"), F.avg("residual_m").alias("mean_residual_m"), F.bool_or("robust").alias("robust")
    )
    return final.join(shuffled(fit), SESSION)


def weighted_moments(pairs: DataFrame, weight: str, keys: list[str] = SESSION) -> DataFrame:
    """Moments under per-row weights, centred on the unweighted means so that large coordinates cancel first."""
    means = pairs.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_a{i}") for i, c in enumerate(SRC)], *[F.avg(c).alias(f"_b{i}") for i, c in enumerate(DST)]
    )
    df = pairs.join(shuffled(means), keys)
    df = df.withColumns(
        {**{f"_s{i}": F.col(c) - F.col(f"_a{i}") for i, c in enumerate(SRC)}, **{f"_d{i}": F.col(c) - F.col(f"_b{i}") for i, c in enumerate(DST)}}
    )
    w = F.col(weight)
    agg = df.groupBy(*keys).agg(
        F.sum(w).alias("_w"),
        *[F.first(f"_{x}{i}").alias(f"_{x}{i}") for x in "ab" for i in range(3)],
        *[F.sum(w * F.col(f"_{x}{i}")).alias(f"_m{x}{i}") for x in "sd" for i in range(3)],
        F.sum(w * sum((F.col(f"_s{i}") * F.col(f"_s{i}") for i in range(1, 3)), F.col("_s0") * F.col("_s0"))).alias("_ss"),
        *[F.sum(w * F.col(f"_d{i}") * F.col(f"_s{j}")).alias(f"_x{i}{j}") for i in range(3) for j in range(3)],
    )
    total = F.col("_w")
    ms = [F.col(f"_ms{i}") / total for i in range(3)]
    md = [F.col(f"_md{i}") / total for i in range(3)]
    return agg.select(
        *keys,
        *[(F.col(f"_a{i}") + ms[i]).alias(f"ms{i}") for i in range(3)],
        *[(F.col(f"_b{i}") + md[i]).alias(f"md{i}") for i in range(3)],
        (F.col("_ss") / total - sum((m * m for m in ms[1:]), ms[0] * ms[0])).alias("var_s"),
        *[(F.col(f"_x{i}{j}") / total - md[i] * ms[j]).alias(f"c{i}{j}") for i in range(3) for j in range(3)],
    )


def georeference_policy(quality: DataFrame, matches: DataFrame) -> DataFrame:
    """Mode, inlier threshold and frame per session; a session that may not be aligned stays LOCAL_METRIC.

    ``matches`` has ``n_matches`` and ``is_rtk`` per session.
    """
    df = matches.join(quality.select(*SESSION, "quality_tier", "estimated_noise_m"), SESSION, "left")
    tier, noise = F.col("quality_tier"), F.col("estimated_noise_m")
    local = (F.col("n_matches") < 3) | tier.isNull() | tier.isin("INSUFFICIENT_BASELINE", "LOCAL_METRIC")
    strong = tier == "STRONG_GPS"
    mode = F.when(local, "LOCAL_METRIC").when(F.col("is_rtk"), "RTK").when(strong, "STRONG_GPS").otherwise("WEAK_GPS")
    threshold = (
        F.when(local, F.lit(None).cast("double"))
        .when(F.col("is_rtk"), F.lit(0.5))
        .when(strong, F.greatest(2.5 * noise, F.lit(5.0)))
        .otherwise(F.greatest(3.5 * noise, F.lit(8.0)))
    )
    return df.select(
        *SESSION,
        "n_matches",
        "quality_tier",
        mode.alias("mode"),
        threshold.alias("inlier_threshold_m"),
        F.when(local, "LOCAL_METRIC").otherwise("ENU").alias("coordinate_frame"),
    )


def adaptive_georeference(pairs: DataFrame, policy: DataFrame, order: list[str], trials: int = 300) -> DataFrame:
    """G5 run end to end: robust fits where the policy allows, the identity with a NULL residual elsewhere."""
    allowed = policy.where(F.col("inlier_threshold_m").isNotNull()).select(*SESSION, "inlier_threshold_m")
    fits = ransac_similarity(pairs.join(allowed, SESSION), order, trials=trials)
    out = policy.join(fits, SESSION, "left")
    unit = {c: F.lit(1.0 if c in ("s", "r00", "r11", "r22") else 0.0) for c in TRANSFORM}
    return out.withColumns({c: F.coalesce(F.col(c), unit[c]) for c in TRANSFORM}).withColumn(
        "n_correspondences", F.coalesce("n_inliers", "n_matches")
    ).drop("n_inliers", "robust")


# --- camera centres pulled towards GPS ----------------------------------------------------------


def refine_centers(
    observations: DataFrame, cameras: DataFrame, gps_weight: float = 1.0, tolerance_m: float = 1e-7, max_rounds: int = 50
) -> DataFrame:
    """Per camera, the centre that balances pixel error against its GPS prior; rotations and points stay.

    ``observations``: image_id, u, v, x, y, z. ``cameras``: image_id, rotation, intrinsics, centre ``c0..c2``,
    nullable prior ``g0..g2``. Damped Gauss-Newton: each round is one join of the observations with the
    camera states and one map-side-combined sum of the 3x3 normal equations, so a camera with most of the
    observations is no bottleneck. A step that raises the cost is undone and the damping grows. A camera whose next step is shorter
    than ``tolerance_m`` is settled and takes no part in further rounds; ``converged`` is false for those that were not
    settled after ``max_rounds``. Cameras without observations stay where they are and count as settled.
    """
    fixed = ["image_id", *R_NAMES, "fx", "fy", "cx", "cy"]
    front = _camera_point(observations.join(cameras.select(*fixed, "c0", "c1", "c2"), "image_id"), "c")
    obs = cut(front.where(F.col("_z") > 0.01).select("image_id", "u", "v", "x", "y", "z"))
    state = cameras.withColumns(
        {
            **{f"p{i}": F.col(f"c{i}") for i in range(3)},
            "lam": F.lit(1e-3),
            "cost": F.lit(None).cast("double"),
            **{f"b{i}": F.col(f"c{i}") for i in range(3)},
        }
    )
    h_names = ("h00", "h01", "h02", "h11", "h12", "h22")
    kept = [f"k_{h}" for h in h_names] + [f"k_g{i}" for i in range(3)]
    state = state.withColumns({k: F.lit(None).cast("double") for k in kept})
    settled = None
    for _ in range(max_rounds + 1):
        trial = _camera_point(obs.join(state.select(*fixed, "p0", "p1", "p2"), "image_id"), "p")
        z = F.greatest(F.col("_z"), F.lit(1e-3))
        trial = trial.withColumns(
            {
                "_ru": F.col("fx") * F.col("_x") / z + F.col("cx") - F.col("u"),
                "_rv": F.col("fy") * F.col("_y") / z + F.col("cy") - F.col("v"),
            }
        )
        live = F.when(F.col("_z") > 1e-3, 1.0).otherwise(0.0)
        # d(camera point)/d(centre) = -R
        ju = [-(F.col("fx") / z) * (F.col(f"r0{j}") - live * F.col("_x") / z * F.col(f"r2{j}")) for j in range(3)]
        jv = [-(F.col("fy") / z) * (F.col(f"r1{j}") - live * F.col("_y") / z * F.col(f"r2{j}")) for j in range(3)]
        trial = trial.withColumns({**{f"_ju{j}": ju[j] for j in range(3)}, **{f"_jv{j}": jv[j] for j in range(3)}})
        sums = trial.groupBy("image_id").agg(
            F.sum(F.col("_ru") * F.col("_ru") + F.col("_rv") * F.col("_rv")).alias("n_cost"),
            *[
                F.sum(F.col(f"_ju{i}") * F.col(f"_ju{j}") + F.col(f"_jv{i}") * F.col(f"_jv{j}")).alias(f"n_h{i}{j}")
                for i in range(3)
                for j in range(i, 3)
            ],
            *[F.sum(F.col(f"_ju{i}") * F.col("_ru") + F.col(f"_jv{i}") * F.col("_rv")).alias(f"n_g{i}") for i in range(3)],
        )
        df = state.join(sums, "image_id", "left")
        w2 = gps_weight * gps_weight
        prior = F.col("g0").isNotNull()
        pull = [F.when(prior, (F.col(f"p{i}") - F.col(f"g{i}")) * w2).otherwise(0.0) for i in range(3)]
        pull_cost = F.when(
            prior, w2 * sum(((F.col(f"p{i}") - F.col(f"g{i}")) * (F.col(f"p{i}") - F.col(f"g{i}")) for i in range(3)), F.lit(0.0))
        ).otherwise(0.0)
        stiff = F.when(prior, F.lit(w2)).otherwise(0.0)
        df = df.withColumns(
            {
                "n_cost": F.col("n_cost") + pull_cost,
                **{f"n_h{i}{i}": F.col(f"n_h{i}{i}") + stiff for i in range(3)},
                **{f"n_g{i}": F.col(f"n_g{i}") + pull[i] for i in range(3)},
            }
        )
        better = F.col("n_cost").isNotNull() & (F.col("cost").isNull() | (F.col("n_cost") < F.col("cost")))
        df = df.withColumn("_ok", better)
        ok = F.col("_ok")
        df = df.withColumns(
            {
                **{f"b{i}": F.when(ok, F.col(f"p{i}")).otherwise(F.col(f"b{i}")) for i in range(3)},
                **{f"k_{h}": F.when(ok, F.col(f"n_{h}")).otherwise(F.col(f"k_{h}")) for h in h_names},
                **{f"k_g{i}": F.when(ok, F.col(f"n_g{i}")).otherwise(F.col(f"k_g{i}")) for i in range(3)},
                "cost": F.when(ok, F.col("n_cost")).otherwise(F.col("cost")),
                "lam": F.when(ok, F.col("lam") / 10.0).otherwise(F.col("lam") * 10.0),
            }
        ).drop(*[f"n_{h}" for h in h_names], *[f"n_g{i}" for i in range(3)], "n_cost", "_ok")
        moved = cut(_damped_step(df))
        still = norm3([F.col(f"p{i}") - F.col(f"b{i}") for i in range(3)]) < tolerance_m
        out = moved.where(still).withColumn("converged", F.lit(True))
        settled = out if settled is None else settled.unionByName(out)
        state = moved.where(~still)
        if state.isEmpty():
            break
    settled = settled.unionByName(state.withColumn("converged", F.lit(False)))
    done = cut(settled.select("image_id", *[F.col(f"b{i}").alias(f"c{i}") for i in range(3)], "g0", "g1", "g2", "converged"))
    err = _camera_point(obs.join(cameras.select(*fixed), "image_id").join(done.select("image_id", "c0", "c1", "c2"), "image_id"), "c")
    z = F.greatest(F.col("_z"), F.lit(1e-3))
    off = F.hypot(F.col("fx") * F.col("_x") / z + F.col("cx") - F.col("u"), F.col("fy") * F.col("_y") / z + F.col("cy") - F.col("v"))
    errors = err.groupBy("image_id").agg(F.avg(off).alias("mean_reprojection_error_px"), F.count(F.lit(1)).alias("n_observations"))
    gap = norm3([F.col(f"c{i}") - F.col(f"g{i}") for i in range(3)])
    return done.withColumn("gps_residual_m", gap).drop("g0", "g1", "g2").join(errors, "image_id", "left")


def _camera_point(df: DataFrame, center: str) -> DataFrame:
    d = [F.col("x") - F.col(f"{center}0"), F.col("y") - F.col(f"{center}1"), F.col("z") - F.col(f"{center}2")]
    m = rot()
    return df.withColumns({n: m[i][0] * d[0] + m[i][1] * d[1] + m[i][2] * d[2] for i, n in enumerate(("_x", "_y", "_z"))})


def _damped_step(df: DataFrame) -> DataFrame:
    """Next trial centre: best centre minus the damped 3x3 solve, by cofactors; cameras without observations stay."""
    lam = F.lit(1.0) + F.col("lam")
    df = df.withColumns(
        {
            "_a": F.col("k_h00") * lam, "_b": F.col("k_h01"), "_c": F.col("k_h02"),
            "_d": F.col("k_h11") * lam, "_e": F.col("k_h12"), "_f": F.col("k_h22") * lam,
        }
    )
    a, b, c, d, e, f = cols("_a", "_b", "_c", "_d", "_e", "_f")
    df = df.withColumns(
        {
            "_i00": d * f - e * e, "_i01": c * e - b * f, "_i02": b * e - c * d,
            "_i11": a * f - c * c, "_i12": b * c - a * e, "_i22": a * d - b * b,
        }
    )
    df = df.withColumn("_det", a * F.col("_i00") + b * F.col("_i01") + c * F.col("_i02"))
    g = cols("k_g0", "k_g1", "k_g2")
    rows = (("_i00", "_i01", "_i02"), ("_i01", "_i11", "_i12"), ("_i02", "_i12", "_i22"))
    step = {
        f"p{i}": F.coalesce(
            F.col(f"b{i}") - F.try_divide(sum((F.col(rows[i][j]) * g[j] for j in range(1, 3)), F.col(rows[i][0]) * g[0]), F.col("_det")),
            F.col(f"b{i}"),
        )
        for i in range(3)
    }
    return df.withColumns(step).drop(*[f"_{x}" for x in "abcdef"], *[f"_i{k}" for k in ("00", "01", "02", "11", "12", "22")], "_det")
