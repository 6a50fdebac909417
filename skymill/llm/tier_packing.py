"""Hierarchical packing: documents go to context-size tiers, every tier is packed, long windows fill up from shorter tiers.

The cuts depend on the document alone: whole windows from its start, then a rest shorter than the window. The rest is
routed to the smallest power-of-two tier that holds it. The plan is made from the histogram of rest lengths (at most
``window`` rows, however large the corpus). Each shorter tier gets sequences that two of its rests fill exactly, from up
to half of the rests; the others go to long windows, which open with the longest rests and whose gaps take the longest
rests of shorter tiers that fit. Rests whose window would keep a larger gap are cut once more, at powers of two, and these
parts close windows without a gap or stand as full sequences of a shorter tier. Documents then find their place by
their rank among the rests of the same length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skymill.llm.tables import bounded_batches, numbered, text_of
from skymill.llm.tokens import encoder, vocabulary
from skymill.runtime import cut

SMALLEST = 64  # tokens of the shortest tier; shorter remainders only fill gaps
SLACK = 16  # tokens a window may stay short of before its rests are cut

CUTS = "doc_id long, start long, length int, doc_tokens long, crcs array<long>"
PLAN = "length int, part int, cut_at int, part_length int, first long, last long, per_window int, sequence long, offset int, tier int, tier_rank long"


def parts_of(length: int, smallest: int = SMALLEST) -> list[int]:
    """Descending powers of two down to ``smallest``, then what is left."""
    parts, size = [], 1 << max(length.bit_length() - 1, 0)
    while size >= smallest:
        if length >= size:
            parts.append(size)
            length -= size
        size >>= 1
    return parts + [length] * (length > 0)


def cut_documents(docs: DataFrame, window: int = 1024, end_id: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode every text, append ``end_id`` and cut: ``doc_id, start, length, doc_tokens, crcs`` (and ``ids``).

    crcs: unsigned crc32 of the piece's ids as little-endian unsigned 32-bit integers, then of each of its
    ``parts_of``. Null texts count as empty, so every document gives at least one piece. Extra columns are left out.
    """
    at = path or vocabulary()
    schema = CUTS + (", ids array<int>" if with_ids else "")
    columns = [c.split()[0] for c in schema.split(", ")]

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(at)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for pdf in frames:
            for k in range(0, len(pdf), 500):
                part, rows = pdf.iloc[k : k + 500], []
                for doc_id, raw in zip(part["doc_id"], enc.encode(part["text"])):
                    ids = np.frombuffer(raw + end, dtype=enc.dtype).astype("<u4")
                    data, n = memoryview(ids.tobytes()), len(ids)
                    for a in range(0, n, window):
                        size = min(window, n - a)
                        crcs, b = [zlib.crc32(data[4 * a : 4 * (a + size)])], a
                        if size < window:
                            for p in parts_of(size):
                                crcs.append(zlib.crc32(data[4 * b : 4 * (b + p)]))
                                b += p
                        rows.append((doc_id, a, size, n, crcs) + ((ids[a : a + size].astype(np.int32),) if with_ids else ()))
                yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    return bounded_batches(docs).select("doc_id", text_of().alias("text")).mapInPandas(pieces, schema)


class _Pool:
    """How many items of each length are left, as stretches of ranks of a source."""

    def __init__(self):
        self.left: dict[int, list[list]] = {}

    def add(self, size: int, source: tuple, first: int, count: int) -> None:
        if count:
            self.left.setdefault(size, []).append([source, first, count])

    def sizes(self) -> list[int]:
        return sorted(self.left, reverse=True)

    def take(self, size: int, count: int) -> tuple[tuple, int]:
        """``count`` items of the stretch in front, which has at least that many."""
        stretch = self.left[size][0]
        source, first, _ = stretch
        stretch[1] += count
        stretch[2] -= count
        if not stretch[2]:
            self.left[size].pop(0)
            if not self.left[size]:
                del self.left[size]
        return source, first

    def front(self, size: int) -> int:
        return self.left[size][0][2]


def _windows(pool: _Pool, window: int) -> Iterator[tuple[int, list[tuple]]]:
    """Best-fit windows as ``(how many, [(size, source, first rank, items per window)])``."""
    while pool.left:
        sizes, gap, chosen = pool.sizes(), window, {}
        for size in sizes:  # longest first: each tier fills what the longer ones left
            have = sum(s[2] for s in pool.left[size])
            k = min(gap // size, have)
            if k:
                chosen[size] = k
                gap -= k * size
        times = min(pool.front(size) // k if pool.front(size) >= k else 0 for size, k in chosen.items())
        if times == 0:  # a stretch that holds less than one window's share: build one window from several stretches
            items = []
            for size, k in chosen.items():
                while k:
                    n = min(k, pool.front(size))
                    items.append((size, *pool.take(size, n), n))
                    k -= n
            yield 1, items
        else:
            yield times, [(size, *pool.take(size, k * times), k) for size, k in chosen.items()]


def _tier_sequences(pool: _Pool, window: int, smallest: int) -> Iterator[tuple[int, list[tuple]]]:
    """Full sequences of the tiers below ``window``: a rest routed to a tier and the shorter rest that closes its gap.

    Up to half of the rests of a length are used up, the others are left to fill the gaps of long windows.
    """
    have = lambda size: pool.front(size) // 2 if size in pool.left else 0
    tier = window // 2
    while tier >= smallest:
        for size in range(tier, tier // 2, -1):
            gap = tier - size
            times = min(have(size), have(gap)) if gap else have(size)
            if times:
                yield times, [(n, *pool.take(n, times), 1) for n in (size, gap) if n]
        tier //= 2


def plan(counts: dict[int, int], window: int = 1024, smallest: int = SMALLEST, slack: int = SLACK) -> list[tuple]:
    """Rows of ``PLAN`` for a histogram of piece lengths.

    A row says: the pieces of ``length`` with ranks ``first`` to ``last`` (exclusive) go, whole (part 0) or their part
    number ``part``, to windows from ``sequence`` on, ``per_window`` in each, from ``offset`` on. Ranks of one length are
    covered once by part 0 or once by each of its parts.
    """
    pool, parts, done = _Pool(), _Pool(), []
    for size in sorted(counts):
        pool.add(size, (size, 0, 0), 0, counts[size])
    done += _tier_sequences(pool, window, smallest)
    for times, items in _windows(pool, window):
        gap = window - sum(size * k for size, _, _, k in items)
        fill = window - gap
        if gap <= slack or (fill & (fill - 1) == 0 and fill >= smallest):
            done.append((times, items))
        else:
            for size, source, first, k in items:
                at = 0
                for j, p in enumerate(parts_of(size, smallest), 1):
                    parts.add(p, (size, j, at), first, times * k)
                    at += p
    done += _windows(parts, window)
    out, sequence, in_tier = [], 0, {}
    for times, items in done:
        fill = sum(size * k for size, _, _, k in items)
        tier = fill if fill & (fill - 1) == 0 else window
        offset = 0
        for size, (length, part, cut_at), first, k in items:
            out.append((length, part, cut_at, size, first, first + times * k, k, sequence, offset, tier, in_tier.get(tier, 0)))
            offset += size * k
        sequence += times
        in_tier[tier] = in_tier.get(tier, 0) + times
    return out


def pack(pieces: DataFrame, window: int = 1024, step_tokens: int = 65_536, buckets: int = 64) -> DataFrame:
    """Give every piece, or each part of it, a place: the piece's columns with ``start, length, ids_crc32`` of the part,
    ``sequence_id, offset, tier, step_group``.

    Offsets of a sequence start at 0 without gaps. tier: tokens of the sequence with padding; only sequences whose
    tokens are a power of two have a shorter one than ``window``. step_group: sequences of one tier in groups of
    ``step_tokens`` tokens, so that training steps are of equal weight whatever their context size. No piece, no row.
    The histogram (a row per length) and the plan (a few rows per length) pass through the driver.
    """
    spark: SparkSession = pieces.sparkSession
    placed = cut(numbered(cut(pieces), "length", ["doc_id", "start"], "_rank", buckets))
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = spark.createDataFrame(plan(counts, window), PLAN)
    where = ["part", "cut_at", "part_length", "first", "last", "per_window", "sequence", "offset", "tier", "tier_rank"]
    lines = rows.groupBy(F.col("length").alias("_length")).agg(F.collect_list(F.struct(*where)).alias("_lines"))
    found = placed.join(F.broadcast(lines), F.col("length") == F.col("_length")).withColumn(  # at most `window` rows
        "_line", F.explode(F.expr("filter(_lines, x -> _rank >= x.first and _rank < x.last)"))
    )
    line = lambda name: F.col(f"_line.{name}")
    nth = F.col("_rank") - line("first")
    window_no = F.floor(nth / line("per_window"))
    return found.select(
        *[c for c in pieces.columns if c not in ("start", "length", "crcs")],
        (F.col("start") + line("cut_at")).alias("start"),
        line("part_length").cast("long").alias("length"),
        F.element_at("crcs", line("part") + 1).alias("ids_crc32"),
        (line("sequence") + window_no).alias("sequence_id"),
        (line("offset") + (nth % line("per_window")) * line("part_length")).cast("long").alias("offset"),
        line("tier").alias("tier"),
        F.floor((line("tier_rank") + window_no) * line("tier") / step_tokens).alias("step_group"),
    )


def sequences(packed: DataFrame, pieces_with_ids: DataFrame, pad_id: int = 0, window: int = 1024) -> DataFrame:
    """The training rows: ``sequence_id, tier, step_group, ids, lengths``, padded with ``pad_id`` to the tier.

    ``pieces_with_ids`` comes from ``cut_documents(..., with_ids=True)``. A sequence holds at most a window of ids.
    """
    whole = pieces_with_ids.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("length").alias("_n"), "ids")
    inside = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.floor(F.col("start") / window) == F.floor(F.col("_s") / window))
    rows = packed.join(whole, inside).withColumn("_ids", F.slice("ids", (F.col("start") - F.col("_s") + 1).cast("int"), F.col("length").cast("int")))
    got = rows.groupBy("sequence_id", "tier", "step_group").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "_ids"))).alias("_p"))
    flat = F.flatten(F.transform("_p", lambda p: p["_ids"]))
    return got.select(
        "sequence_id", "tier", "step_group",
        F.concat(flat, F.array_repeat(F.lit(pad_id), F.col("tier") - F.size(flat))).alias("ids"),
        F.transform("_p", lambda p: p["length"]).alias("lengths"),
    )


def pack_documents(docs: DataFrame, window: int = 1024, end_id: int = 0, path: str | None = None, step_tokens: int = 65_536) -> DataFrame:
    """Cut and pack every document; rows with equal ids are packed on their own."""
    return pack(cut_documents(docs, window, end_id, path), window, step_tokens)
