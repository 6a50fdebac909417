"""Hard negatives by exact maximum-inner-product search with length buckets and coordinate pruning.

Rows are cut into buckets of similar vector length, and a bucket into blocks of bounded size. For an anchor q that looks for
scores of t or more, a bucket of vectors no longer than m matters only if |q| * m >= t, and there only vectors whose cosine
with q is c = t / (|q| * m) or more. Such a vector's coordinate f lies within q_f * c +- sqrt((1 - q_f^2) * (1 - c^2)), both
normalised. A block keeps its rows sorted by every coordinate, so the feasible range of each of the anchor's ``FOCUS`` largest
coordinates is a slice; rows in all slices are candidates, and only their scores are computed, exactly.

An anchor first searches one block (the longest vectors it may take); what it finds bounds the scores that it still needs
from all others, which it then searches in parallel. A block returns at most the asked number of rows for an anchor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skymill.runtime import cut

FOCUS = 4  # coordinates of an anchor whose feasible ranges are intersected
BLOCK = 4_096  # rows of a block
ANCHORS = 1_024  # anchors that search a block in one task
STEP = 1.1  # lengths within a bucket differ by this factor at most
GRIDS = 16  # parts of the list of blocks
PROBES = 64  # rows of a block scored before the others
SAFE = float(2**53)  # sums below this are exact in floating point
SLACK = 1e-9
NO_LENGTH = -1_000_000  # bucket of zero vectors
LAST = 2**63 - 1  # stands for a null id while rows are ordered


class Block:
    """Some rows' integer vectors, longest first, with a sorted list per coordinate."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        self.rows, self.ids, self.vectors, self.lengths = rows[order], ids[order], vectors[order], lengths[order]
        unit = self.vectors / np.maximum(self.lengths, 1e-300)[:, None]
        self.sorted = np.argsort(unit, axis=0, kind="stable").T
        self.values = np.take_along_axis(unit, self.sorted.T, axis=0).T

    def candidates(self, q: np.ndarray, least: float) -> np.ndarray:
        """Positions of all rows whose score with ``q`` may reach ``least``."""
        length = float(np.sqrt(q @ q))
        if least <= 0 or not len(self.rows):
            return np.arange(len(self.rows))  # a bound from lengths says nothing about scores up to zero
        if length == 0 or length * self.lengths[0] < least * (1 - SLACK):
            return np.zeros(0, np.int64)
        long = int(np.searchsorted(-self.lengths, -least * (1 - SLACK) / length, side="right"))  # shorter ones can't reach it
        cosine = min(1.0, least / (length * self.lengths[0])) * (1 - SLACK)
        unit = q / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        reach = np.sqrt(np.maximum(0.0, (1 - unit[focus] ** 2) * (1 - cosine**2))) + SLACK
        slices = []
        for f, x, r in zip(focus, unit[focus], reach):
            low = -2.0 if x <= -cosine else x * cosine - r  # the pole of the axis is inside the cone
            high = 2.0 if x >= cosine else x * cosine + r
            slices.append(self.sorted[f, np.searchsorted(self.values[f], low - SLACK) : np.searchsorted(self.values[f], high + SLACK, side="right")])
        hits = np.zeros(len(self.rows), np.int8)
        for s in slices:
            hits[s] += 1
        hits[long:] = 0
        return np.flatnonzero(hits == len(slices))

    def scores(self, q: np.ndarray, at: np.ndarray) -> list[int]:
        """Exact integer inner products; beyond the range of longs the nearest long."""
        if len(at) and float(np.sqrt(q @ q)) * self.lengths[at[0]] < SAFE:
            return (self.vectors[at] @ q).astype(np.int64).tolist()
        whole = [int(x) for x in q]
        return [max(-(2**63) + 1, min(2**63 - 1, sum(a * int(b) for a, b in zip(whole, v)))) for v in self.vectors[at]]


def best(block: Block, q: np.ndarray, count: int, low: int = 1 - 2**63, high: int = 2**63 - 1, but: int | None = None) -> list[tuple[int, int]]:
    """The first ``count`` rows of a block as ``(score, position)``: scores from ``low`` to ``high``, higher scores and then
    smaller ids first, row ``but`` left out. Some of the longest rows bound what the others have to reach."""
    seen = sorted(s for s, r in zip(block.scores(q, np.arange(min(PROBES, len(block.rows)))), block.rows) if r != but and low <= s <= high)
    at = block.candidates(q, float(max(low, seen[-count]) if len(seen) >= count else low))
    found = [(s, p) for s, p in zip(block.scores(q, at), at.tolist()) if low <= s <= high and block.rows[p] != but]
    return sorted(found, key=lambda x: (-x[0], block.ids[x[1]], block.rows[x[1]]))[:count]


def usable(table: DataFrame) -> DataFrame:
    """Written: ``row, vec_id, label, v, length`` (integers, as doubles) of the rows that take part.

    A null label or vector, or a component that is null or not finite, takes a row out. Labels of ids divisible by 7 move on
    by one; a null id moves nothing. Vectors may differ in size: missing components count as zero, and so does an empty vector.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    label = F.col("label").cast("long")
    whole = F.transform("embedding", lambda x: _floor(x.cast("double") * 256))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label")
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", moved, whole.alias("v")).withColumn("length", length))


def _floor(x: Column) -> Column:
    """As a double; beyond 2^52 doubles are whole, and their floor may not fit a long."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def blocks_of(rows: DataFrame) -> DataFrame:
    """Written: ``rows`` with ``block``, an id of label, bucket of length and part, and ``longest``, its bound of lengths."""
    bucket = F.when(F.col("length") > 0, F.floor(F.log("length") / float(np.log(STEP)))).otherwise(F.lit(NO_LENGTH)).cast("int")
    placed = rows.withColumn("bucket", bucket)
    sizes = placed.groupBy(F.col("label").alias("_l"), F.col("bucket").alias("_b")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_parts"))
    parted = placed.join(sizes, (F.col("label") == F.col("_l")) & (F.col("bucket") == F.col("_b")))
    block = F.concat_ws("/", "label", "bucket", F.pmod(F.xxhash64("row"), F.col("_parts")))
    longest = F.when(F.col("bucket") == NO_LENGTH, F.lit(0.0)).otherwise(F.pow(F.lit(STEP), F.col("bucket") + 1) * (1 + SLACK))
    return cut(parted.select("row", "vec_id", "label", "v", "length", block.alias("block"), longest.alias("longest")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search(asks: DataFrame, rows: DataFrame, count: int) -> DataFrame:
    """Written: ``anchor, positive, other, other_id, score``, the first ``count`` rows of each asked block for each band asked.

    ``asks``: ``block, anchor, q`` and, of equal length, the arrays ``of`` (a name for each band), ``low`` and ``high``. At most
    about ``ANCHORS`` anchors share a task: a block that more of them search is copied.
    """
    turns = asks.groupBy(F.col("block").alias("_block")).agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("_turns"))
    turns = cut(turns)
    keyed = asks.join(turns, F.col("block") == F.col("_block")).withColumn("turn", F.pmod(F.xxhash64("anchor"), F.col("_turns")).cast("int"))
    copies = rows.join(turns, F.col("block") == F.col("_block")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("_turns") - 1)))
    columns = ["anchor", "positive", "other", "other_id", "score"]

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            width = max(held["v"].map(len).max(), asked["q"].map(len).max(), 1)
            block = Block(held["row"].to_numpy(), held["vec_id"].fillna(LAST).to_numpy(dtype=np.int64), _matrix(held["v"], width))
            for anchor, q, names, lows, highs in zip(asked["anchor"], _matrix(asked["q"], width), asked["of"], asked["low"], asked["high"]):
                for name, low, high in zip(names, lows, highs):
                    out += [(anchor, name, block.rows[p], block.ids[p], s) for s, p in best(block, q, count, int(low), int(high), but=anchor)]
        return pd.DataFrame(out, columns=columns).astype("int64")

    asked = keyed.select("block", "turn", "anchor", "q", "of", "low", "high").groupBy("block", "turn")
    held = copies.select("block", "turn", "row", F.coalesce("vec_id", F.lit(LAST)).alias("vec_id"), "v").groupBy("block", "turn")
    return cut(asked.cogroup(held).applyInPandas(run, ", ".join(f"{c} long" for c in columns)))


def ranked(found: DataFrame, count: int) -> DataFrame:
    """The first ``count`` of each anchor and band, with ``rank``."""
    order = [F.desc("score"), F.asc("other_id"), F.asc("other")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(*order))).where(F.col("rank") <= count)


def searched(anchors: DataFrame, blocks: DataFrame, rows: DataFrame, same: bool, count: int) -> DataFrame:
    """Written: the first ``count`` rows of each anchor's bands, among rows of its own label or of all others.

    ``anchors``: ``anchor, label, q, q_length`` and the arrays ``of, low, high``. The stated set of anchors meets the list of
    blocks, cut into grids; a bound of lengths leaves out blocks that can't reach what is asked. Every anchor first searches
    the block with the longest vectors; where that gives ``count`` rows of a band, others have to reach the last of them.
    """
    far = F.array_min("low").cast("double")
    fits = (F.col("longest") * F.col("q_length") >= far * (1 - SLACK)) | (far <= 0)
    if same:
        pairs = anchors.join(blocks, F.col("label") == F.col("_label"))
    else:
        grids = blocks.withColumn("_grid", F.pmod(F.xxhash64("block"), F.lit(GRIDS)).cast("int"))
        pairs = anchors.withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(GRIDS - 1)))).join(grids, (F.col("grid") == F.col("_grid")) & (F.col("label") != F.col("_label")))
    pairs = pairs.where(fits).select("anchor", "block", "longest")
    starts = pairs.groupBy("anchor").agg(F.max(F.struct("longest", "block")).alias("_s")).select("anchor", "_s.block", "_s.longest", F.lit(True).alias("starts"))
    pairs = cut(pairs.join(starts, ["anchor", "block", "longest"], "left"))
    asks = anchors.select("anchor", "q", "q_length", "of", "low", "high")
    found = search(pairs.where("starts").join(asks, "anchor"), rows, count)
    full = found.groupBy("anchor", "positive").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_s")).where(F.col("_n") >= count)
    bounds = cut(full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("positive", "_s"))).alias("_reach")))
    raised = F.zip_with("of", "low", lambda name, low: F.greatest(low, F.element_at("_reach", name)))
    known = cut(asks.join(bounds, "anchor", "left").withColumn("low", F.when(F.col("_reach").isNull(), F.col("low")).otherwise(raised)).drop("_reach"))
    rest = search(pairs.where("starts IS NULL").join(known, "anchor").where(fits), rows, count)
    return cut(ranked(found.unionByName(rest), count))


def hard_negatives(table: DataFrame, positives: int = 5, negatives: int = 10, every: int = 100, least: int = 30, most: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are rows whose id is divisible by ``every``; an anchor's positives are its first ``positives`` other rows of the
    same label, and a positive's negatives the first ``negatives`` rows of other labels with
    least * positive_score <= 100 * negative_score <= most * positive_score, which nothing satisfies if the positive's score is
    below zero. Scores are exact integers; beyond the range of longs they count as the nearest long. Higher scores come
    first, ties by smaller id, null ids last, then by row. Repeated ids are rows of their own. Which rows take part:
    see ``usable``. An empty table gives no row; extra columns are left out.
    """
    rows = blocks_of(usable(table))
    blocks = cut(rows.groupBy("block", F.col("label").alias("_label"), "longest").agg(F.count(F.lit(1)).alias("_n")).drop("_n"))
    one = lambda x: F.array(F.lit(x).cast("long"))
    anchors = rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", F.col("v").alias("q"), F.col("length").alias("q_length"))
    anchors = cut(anchors.withColumns({"of": one(0), "low": one(1 - 2**63), "high": one(2**63 - 1)}))
    chosen = searched(anchors, blocks, rows, True, positives)
    chosen = cut(chosen.select("anchor", F.col("other").alias("positive"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))

    score = F.col("positive_score").cast("decimal(38,0)")
    low, high = F.ceil(score * least / 100).cast("long"), F.floor(score * most / 100).cast("long")
    bands = chosen.where("positive_score >= 0").groupBy("anchor").agg(F.collect_list(F.struct("positive", low.alias("low"), high.alias("high"))).alias("_b"))
    asking = anchors.drop("of", "low", "high").join(bands, "anchor").withColumns({"of": F.col("_b.positive"), "low": F.col("_b.low"), "high": F.col("_b.high")})
    found = searched(cut(asking.drop("_b")), blocks, rows, False, negatives)
    found = found.select("anchor", "positive", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.join(chosen, ["anchor", "positive"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    known = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return named.select("anchor_id", known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"), "positive_score", "negative_score")
