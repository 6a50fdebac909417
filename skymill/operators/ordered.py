"""Ordered-row operators that never hold one key in one task.

A window partitioned by session puts a whole session into one task. Everything here partitions by
``(key, chunk)`` instead, where the chunk is a fixed-width slice of the ordering column, and joins back a
one-row-per-chunk summary that carries what crosses chunk borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skymill.runtime import spread

CHUNK = "_chunk"


def add_chunk(df: DataFrame, order: str, width: float) -> DataFrame:
    return df.withColumn(CHUNK, F.floor(F.col(order) / F.lit(width)).cast("long"))


def _before(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of one key side by side in order within a task, ready for ``mapInPandas``.
    """
    return spread(df, *keys).sortWithinPartitions(*keys, *order)


def row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float, out: str = "idx"
) -> DataFrame:
    """Dense 0-based position of each row within its key, by ``order`` (whose first column is numeric)."""
    df = add_chunk(df, order[0], width)
    local = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*order)))
    sizes = df.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0))).drop("_n")
    return (
        local.join(offsets, [*keys, CHUNK])
        .withColumn(out, F.col("_off") + F.col("_rn") - 1)
        .drop("_off", "_rn", CHUNK)
    )


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], width: float, out: str = "prev"
) -> DataFrame:
    """Adds ``out``: the ``values`` of the row just before in the key's order, NULL for the first row."""
    df = add_chunk(df, order[0], width)
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    packed = F.struct(*values)
    local = df.withColumns({out: F.lag(packed).over(w), "_first": F.row_number().over(w) == 1})
    tails = df.groupBy(*keys, CHUNK).agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
    carry = tails.withColumn("_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy(CHUNK))).drop("_tail")
    return (
        local.join(carry, [*keys, CHUNK])
        .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col(out)))
        .drop("_first", "_carry", CHUNK)
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], width: float
) -> DataFrame:
    """Exclusive prefix sums (rows strictly before) of each expression, under the given names. Keeps ``_chunk``."""
    df = add_chunk(df, order[0], width).withColumns({f"_v_{k}": v for k, v in values.items()})
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumns({k: F.coalesce(F.sum(f"_v_{k}").over(w), F.lit(0.0)) for k in values})
    totals = df.groupBy(*keys, CHUNK).agg(*[F.coalesce(F.sum(f"_v_{k}"), F.lit(0.0)).alias(f"_t_{k}") for k in values])
    offs = totals.select(
        *keys, CHUNK, *[F.coalesce(F.sum(f"_t_{k}").over(_before(keys)), F.lit(0.0)).alias(f"_o_{k}") for k in values]
    )
    out = local.join(offs, [*keys, CHUNK])
    return out.withColumns({k: F.col(k) + F.col(f"_o_{k}") for k in values}).drop(
        *[f"_o_{k}" for k in values], *[f"_v_{k}" for k in values]
    )


def interpolate_at(
    targets: DataFrame,
    sensors: dict[str, tuple[DataFrame, Sequence[str]]],
    keys: Sequence[str],
    t: str = "timestamp_s",
    clamp: bool = False,
    max_outside_s: float | None = None,
    width: float = 60.0,
    prefixed: bool = False,
) -> DataFrame:
    """Linear interpolation of every sensor onto the target times, all sensors in one shuffle.

    Extrapolating mode continues the first or last segment without bound and needs two samples per
    sensor; clamp mode holds the end values. With ``max_outside_s`` targets further outside a
    sensor's range than that are dropped. Repeated sample times keep the row with the highest ``seq``.
    """
    names = list(sensors)
    target_cols = [c for c in targets.columns if c not in (*keys, t)]
    payload = F.struct(*[F.col(c) for c in target_cols]) if target_cols else F.struct(F.lit(1).alias("_none"))

    samples = {}
    for name, (df, values) in sensors.items():
        packed = F.struct(*[F.col(v).cast("double").alias(v) for v in values])
        if "seq" not in df.columns:
            raise ValueError(f"the {name} log needs seq, its line order, to settle repeated times")
        best = F.max_by(packed, F.col("seq"))
        samples[name] = (
            df.groupBy(*keys, t).agg(best.alias("_v")).select(*keys, t, F.struct(F.col(t).alias("t"), "_v").alias(f"s_{name}"))
        )
    merged = targets.select(*keys, t, payload.alias("_p"), F.lit(1).alias("_target"))
    for df in samples.values():
        merged = merged.unionByName(df.withColumn("_target", F.lit(0)), allowMissingColumns=True)
    merged = add_chunk(merged, t, width)

    part = Window.partitionBy(*keys, CHUNK)
    up = part.orderBy(F.col(t), F.col("_target")).rowsBetween(Window.unboundedPreceding, 0)
    down = part.orderBy(F.col(t).desc(), F.col("_target").desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = merged.withColumns(
        {f"prev_{n}": F.last(f"s_{n}", ignorenulls=True).over(up) for n in names}
    ).withColumns({f"next_{n}": F.last(f"s_{n}", ignorenulls=True).over(down) for n in names})
    local = local.where(F.col("_target") == 1).drop("_target", *[f"s_{n}" for n in names])

    heads = merged.groupBy(*keys, CHUNK).agg(
        *[F.min(f"s_{n}").alias(f"f_{n}") for n in names], *[F.max(f"s_{n}").alias(f"l_{n}") for n in names]
    )
    back = _before(keys)
    ahead = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = heads.select(
        *keys,
        CHUNK,
        *[F.last(f"l_{n}", ignorenulls=True).over(back).alias(f"cp_{n}") for n in names],
        *[F.last(f"f_{n}", ignorenulls=True).over(ahead).alias(f"cn_{n}") for n in names],
    )
    rows = local.join(carry, [*keys, CHUNK], "left")

    ends = heads.groupBy(*keys).agg(
        *[F.min(f"f_{n}").alias(f"f1_{n}") for n in names], *[F.max(f"l_{n}").alias(f"l1_{n}") for n in names]
    )
    if not clamp:
        inner = merged.where(F.col("_target") == 0).join(ends, list(keys))
        second = inner.groupBy(*keys).agg(
            *[F.min(F.when(F.col(f"s_{n}.t") > F.col(f"f1_{n}.t"), F.col(f"s_{n}"))).alias(f"f2_{n}") for n in names],
            *[F.max(F.when(F.col(f"s_{n}.t") < F.col(f"l1_{n}.t"), F.col(f"s_{n}"))).alias(f"l2_{n}") for n in names],
        )
        ends = ends.join(second, list(keys), "left")
    rows = rows.join(ends, list(keys), "left")

    now = F.col(t)
    out = [F.col(k) for k in keys] + [now] + [F.col(f"_p.{c}").alias(c) for c in target_cols]
    keep = F.lit(True)
    for n, (_, values) in sensors.items():
        lo = F.coalesce(F.col(f"prev_{n}"), F.col(f"cp_{n}"))
        hi = F.coalesce(F.col(f"next_{n}"), F.col(f"cn_{n}"))
        rows = rows.withColumns({f"_lo_{n}": lo, f"_hi_{n}": hi})
        lo, hi, first, last = (F.col(f"{p}_{n}") for p in ("_lo", "_hi", "f1", "l1"))
        if max_outside_s is not None:
            keep = keep & (now >= first["t"] - max_outside_s) & (now <= last["t"] + max_outside_s)
        if clamp:
            rows = rows.withColumns({f"_a_{n}": F.coalesce(lo, first), f"_b_{n}": F.coalesce(hi, last)})
            inside = lo.isNotNull() & hi.isNotNull()
        else:
            f2, l2 = F.col(f"f2_{n}"), F.col(f"l2_{n}")
            rows = rows.withColumns(
                {
                    f"_a_{n}": F.when(f2.isNull(), F.lit(None)).when(lo.isNull(), first).when(hi.isNull(), l2).otherwise(lo),
                    f"_b_{n}": F.when(f2.isNull(), F.lit(None)).when(lo.isNull(), f2).when(hi.isNull(), last).otherwise(hi),
                }
            )
            inside = F.lit(True)
        a, b = F.col(f"_a_{n}"), F.col(f"_b_{n}")
        share = F.when(inside & (b["t"] > a["t"]), (now - a["t"]) / (b["t"] - a["t"])).otherwise(
            F.when(hi.isNull(), F.lit(1.0)).otherwise(F.lit(0.0))
        )
        for v in values:
            value = a["_v"][v] + (b["_v"][v] - a["_v"][v]) * share
            out.append(value.alias(f"{n}_{v}" if prefixed else v))
    if max_outside_s is not None:
        rows = rows.where(keep)
    return rows.select(*out)
