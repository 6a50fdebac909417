"""SimHash fingerprints and exact search of near fingerprints through vantage-point trees.

A tree over a bounded sample of fingerprints cuts the Hamming space into shards: every inner node has a vantage point
and a radius, fingerprints within the radius go one way, the others the other way. Each fingerprint lives in one
shard, and by the triangle bound it also visits the shards across a boundary that is nearer than the link radius, so
every linked pair meets in a shard. Inside a shard the same kind of tree is built over all its fingerprints. A shard
returns a spanning forest of its links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymill.llm.bottom_k import near_groups as near_groups_of_sets
from skymill.llm.links import components
from skymill.llm.tables import bounded_batches, row_key, text_of
from skymill.runtime import cut

SAMPLE = 4_096  # fingerprints the shard tree is fitted on
HOME, VISITS = 32_768, 65_536  # fingerprints of a shard compared in one group: living there, visiting it
LEAF = 512
CHUNK = 65_536


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``shingle`` words, or of the whole text if it has fewer; none without words."""
    w = text.encode().lower().split()  # on bytes, both only know ASCII
    hashed = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return np.array([hashed(b" ".join(w), 42)] if w else [], dtype=np.uint64)
    return np.array([hashed(b" ".join(s), 42) for s in zip(*[w[i:] for i in range(shingle)])], dtype=np.uint64)


def fingerprint(text: str, shingle: int, words: int, distinct: bool = False) -> tuple[list[int], int, int]:
    """``words`` 64-bit integers (as signed), the number of shingles they are made of, and a digest of these.

    The first 64 bits are over the shingles' hashes, further ones over remixed hashes. A repeated shingle counts as
    often as it occurs, or once if ``distinct``. No words: zero.
    """
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return [0] * words, 0, 0
    if distinct:
        hashes = np.unique(hashes)
    out = []
    for k in range(words):
        h = hashes if k == 0 else _remix(hashes, k)
        counts = np.zeros(64, dtype=np.int64)
        for a in range(0, len(h), CHUNK):
            counts += np.unpackbits(h[a : a + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.packbits(2 * counts > len(h), bitorder="little")
        out.append(int(bits.view(np.int64)[0]))
    return out, len(hashes), int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64)) if distinct else 0


def _remix(h: np.ndarray, k: int) -> np.ndarray:
    x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = 3, bits: int = 64, distinct: bool = False) -> DataFrame:
    """``doc_id, _key, f0 (, f1 ...), size, digest`` of every row; null texts count as empty. Extra columns are left out."""
    n = bits // 64
    columns = [f"f{k}" for k in range(n)]

    @F.pandas_udf(", ".join(f"{c} long" for c in columns) + ", size int, digest long")
    def prints(texts: pd.Series) -> pd.DataFrame:
        rows = [fingerprint(t, shingle, n, distinct) for t in texts]
        out = pd.DataFrame([r[0] for r in rows], columns=columns, dtype="int64", index=texts.index)
        out["size"] = np.array([r[1] for r in rows], dtype="int32")
        out["digest"] = np.array([r[2] for r in rows], dtype="int64")
        return out

    got = bounded_batches(docs).select("doc_id", row_key().alias("_key"), prints(text_of()).alias("_f"))
    return got.select("doc_id", "_key", *[F.col(f"_f.{c}").alias(c) for c in columns], "_f.size", "_f.digest")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of ``a`` to rows of ``b``, each of shape (n, words)."""
    d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for k in range(1, a.shape[1]):
        d = d + np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return d


def build_tree(sample: np.ndarray, shards: int) -> list:
    """Nested ``[vantage, radius, inside, outside]``; a leaf is a shard number."""
    count = [0]

    def node(points: np.ndarray, want: int):
        if want > 1 and len(points) >= 2:
            d = distances(points[:1], points)[0]
            radius = int(np.median(d))
            if (d > radius).sum() == 0:
                radius = int(d.max()) - 1
            inside = d <= radius
            if radius >= 0 and inside.any() and not inside.all():
                left = max(1, round(want * inside.mean()))
                return [points[0], radius, node(points[inside], min(left, want - 1)), node(points[~inside], max(1, want - left))]
        count[0] += 1
        return count[0] - 1

    return node(sample, shards)


def route(tree, points: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of every shard that can hold a point within ``slack`` of the row."""
    rows, shards = [], []

    def go(node, index: np.ndarray) -> None:
        if not len(index):
            return
        if isinstance(node, int):
            rows.append(index)
            shards.append(np.full(len(index), node))
            return
        vantage, radius, inside, outside = node
        d = distances(vantage[None, :], points[index])[0].astype(np.int64)
        go(inside, index[d <= radius + slack])
        go(outside, index[d > radius - slack])

    go(tree, np.arange(len(points)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(shards)


class Forest:
    """Labels of rows joined so far; the label of a row is a row of its group."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                shorter = label[label]
                if (shorter == label).all():
                    break
                label[:] = shorter


def link_shard(points: np.ndarray, low: np.ndarray, high: np.ndarray, home: np.ndarray, asking: np.ndarray, radius: int, ratio: float) -> np.ndarray:
    """Label of every row after linking each row of ``asking`` with each row of ``home`` within ``radius``."""
    forest = Forest(len(points))

    def compare(h: np.ndarray, q: np.ndarray) -> None:
        if ratio > 0:
            h, q = h[np.argsort(low[h], kind="stable")], q[np.argsort(low[q], kind="stable")]
            reach = np.maximum.accumulate(high[h])
        for a in range(0, len(q), 1024):
            some = q[a : a + 1024]
            near = h
            if ratio > 0:  # sizes that differ more can't be as similar as asked
                near = h[np.searchsorted(reach, ratio * low[some].min()) : np.searchsorted(low[h], high[some].max() / ratio, side="right")]
            for b in range(0, len(near), 4096):
                block = near[b : b + 4096]
                x, y = np.nonzero(distances(points[some], points[block]) <= radius)
                x, y = some[x], block[y]
                if ratio > 0:
                    fits = (high[x] >= ratio * low[y]) & (high[y] >= ratio * low[x])
                    x, y = x[fits], y[fits]
                if len(x):
                    forest.join(x, y)

    def search(h: np.ndarray, q: np.ndarray) -> None:
        if not len(h) or not len(q):
            return
        if len(h) > LEAF:
            d = distances(points[h[:1]], points[h])[0].astype(np.int64)
            mid = int(np.median(d))
            inside = d <= mid
            if inside.any() and not inside.all():
                dq = distances(points[h[:1]], points[q])[0].astype(np.int64)
                into, out = dq <= mid + radius, dq > mid - radius
                if into.sum() + out.sum() < 1.8 * len(q):  # else a split prunes too little to pay
                    search(h[inside], q[into])
                    search(h[~inside], q[out])
                    return
        compare(h, q)

    search(home, asking)
    return forest.label


def size_bins(sizes: pd.Series, ratio: float) -> np.ndarray:
    """Sizes that differ by no more than ``ratio`` are in one bin or in neighbouring ones; without a ratio all are in one."""
    if ratio <= 0:
        return np.zeros(len(sizes), dtype=np.int64)
    return np.floor(np.log(np.maximum(sizes.to_numpy(), 1)) / -np.log(ratio) + 1e-9).astype(np.int64)


def routed(nodes: DataFrame, words: int, radius: int, ratio: float = 0.0) -> DataFrame:
    """``shard, visits, node, f0 .., low, high``: every node in its own shard and in those where it may have partners.

    ``nodes``: a written table ``node, f0 .., low, high`` of distinct fingerprints. The tree (at most ``SAMPLE``
    points) passes through the driver. With ``ratio`` shards are cut by size first, and the larger of two sizes is visited.
    """
    columns = [f"f{k}" for k in range(words)]
    total = nodes.count()
    sample = nodes.orderBy(F.xxhash64(*columns)).limit(SAMPLE).select(*columns).toPandas().to_numpy(dtype=np.int64).view(np.uint64)
    shards = max(1, min(-(-total // (HOME // 2)), SAMPLE // 8))
    tree = build_tree(sample, shards) if len(sample) else 0
    if len(sample) and len(route(tree, sample, radius)[0]) > len(sample) * shards / 2:
        tree, shards = 0, 1  # the radius is too wide for this space: shards would hold copies of nearly everything
    schema = ", ".join(["shard int", "visits boolean", "node long", *[f"{c} long" for c in columns], "low int", "high int"])

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            points = pdf[columns].to_numpy(dtype=np.int64).view(np.uint64)
            low, high = size_bins(pdf["low"], ratio), size_bins(pdf["high"], ratio)
            rows, leaf = route(tree, points, 0)
            home = np.empty(len(pdf), dtype=np.int64)
            home[rows] = leaf
            yield at_shard(pdf, np.arange(len(pdf)), low * shards + home, False)
            rows, leaf = route(tree, points, radius)
            keep = leaf > home[rows]  # the other of a pair of shards sees the same pair
            yield at_shard(pdf, rows[keep], low[rows[keep]] * shards + leaf[keep], True)
            for up in range(1, int((high - low).max(initial=-1)) + 2 if ratio > 0 else 1):
                some = rows[low[rows] + up <= high[rows] + 1]
                yield at_shard(pdf, some, (low[some] + up) * shards + leaf[low[rows] + up <= high[rows] + 1], True)

    def at_shard(pdf: pd.DataFrame, rows: np.ndarray, shard: np.ndarray, visits: bool) -> pd.DataFrame:
        return pdf.iloc[rows].assign(shard=shard, visits=visits)[[c.split()[0] for c in schema.split(", ")]]

    return cut(nodes.select("node", *columns, "low", "high").mapInPandas(spread, schema))


def grouped(routed: DataFrame, words: int, most_home: int, most_asking: int):
    """``routed`` in groups of rows that live in a shard and rows that ask there (``asks``), those that live there too.

    One count per shard passes through the driver; a shard with more rows than a group may hold is split by rows on
    both sides. Other columns of ``routed`` pass through; where it has ``may_ask``, only these rows ask.
    """
    if "may_ask" not in routed.columns:
        routed = routed.withColumn("may_ask", F.lit(True))
    sizes = {r["shard"]: (r["h"], r["n"]) for r in routed.groupBy("shard").agg(F.sum((~F.col("visits")).cast("int")).alias("h"), F.sum(F.col("may_ask").cast("int")).alias("n")).collect()}
    parts = [(s, -(-h // most_home), -(-n // most_asking)) for s, (h, n) in sizes.items() if h and n]
    split = routed.sparkSession.createDataFrame(parts, "_s int, _hs int, _qs int")
    rows = routed.join(F.broadcast(split), F.col("shard") == F.col("_s"))  # one row per shard
    part_h, part_q = F.pmod(F.xxhash64("node"), F.col("_hs")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("_qs"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    living = rows.where(~F.col("visits")).withColumn("_h", part_h.cast("int")).withColumn("_q", every("_qs")).withColumn("asks", F.lit(False))
    asking = rows.where("may_ask").withColumn("_q", part_q.cast("int")).withColumn("_h", every("_hs")).withColumn("asks", F.lit(True))
    return living.unionByName(asking).drop("visits", "may_ask", "_s", "_hs", "_qs").groupBy("shard", "_h", "_q")


def linked(nodes: DataFrame, words: int, radius: int, ratio: float = 0.0) -> DataFrame:
    """Links ``u, v`` whose components are those of all pairs within ``radius``; ``nodes`` as in ``routed``."""
    columns = [f"f{k}" for k in range(words)]

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.ascontiguousarray(pdf[columns].to_numpy(dtype=np.int64)).view(np.uint64)
        asks, node = pdf["asks"].to_numpy(), pdf["node"].to_numpy()
        label = link_shard(points, pdf["low"].to_numpy(), pdf["high"].to_numpy(), np.flatnonzero(~asks), np.flatnonzero(asks), radius, ratio)
        moved = np.flatnonzero(node[label] != node)
        return pd.DataFrame({"u": node[moved], "v": node[label[moved]]})

    return grouped(routed(nodes, words, radius, ratio), words, HOME, VISITS).applyInPandas(link, "u long, v long")


def near_groups(docs: DataFrame, shingle: int = 3, bits: int = 64, radius: int = 3) -> DataFrame:
    """``doc_id, _key, f0 .., component_id`` of every row: fingerprints link at ``radius`` or fewer differing bits, and
    component_id is the smallest doc_id reachable (null ids count as larger than any; a group of null ids has null).

    Equal fingerprints are one node, however many rows share them. Repeated rows stay rows; an empty table gives no row.
    """
    n = bits // 64
    columns = [f"f{k}" for k in range(n)]
    prints = cut(fingerprints(docs, shingle, bits))
    nodes = prints.groupBy(*columns).agg(F.min("doc_id").alias("least"), F.min("size").alias("low"), F.max("size").alias("high"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    roots = cut(components(linked(nodes, n, radius)).withColumnRenamed("node", "_node"))
    rooted = nodes.join(roots, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node"))
    rooted = cut(rooted.select("root", "least", *[F.col(c).alias(f"_{c}") for c in columns]))
    least = cut(rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id")))
    named = cut(rooted.join(least, F.col("root") == F.col("_root")).select("component_id", *[f"_{c}" for c in columns]))
    same = [F.col(c) == F.col(f"_{c}") for c in columns]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return prints.join(named, on).select("doc_id", "_key", *columns, "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint (16 hex digits), component_id``: 3-word shingles, 64 bits, linked at 3 bits."""
    groups = near_groups(docs)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of a set of 64-bit hashes, as a signed number."""
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[a : a + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def one_per_group(docs: DataFrame, shingle: int = 5, radius: int = 3, percent: int = 80) -> DataFrame:
    """One row of each group of near copies, with its columns: the one with the smallest id.

    Nulls count as larger than any id; of rows with the same id any one stays. Two texts are near copies if their
    sets of shingles have a Jaccard similarity of ``percent`` hundredths or more, which is counted on the sets; repeated shingles
    count once. Texts without words have no set and stay. An empty table gives no row.

    Fingerprints of the sets that differ in ``radius`` bits or fewer meet through vantage-point trees; they join most
    copies. A fingerprint says too little about a pair at the limit, so the rest is completed by ``bottom_k``, which loses none.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    close = lambda nodes: linked(nodes.select("node", "f0", F.col("n").alias("low"), F.col("n").alias("high")), 1, radius)
    groups = cut(near_groups_of_sets(numbered, shingle, percent, row, majority, close))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("_first")
    stays = groups.where("root IS NOT NULL").groupBy(F.col("root").alias("_root")).agg(first).select("_root", F.col("_first.row").alias("_stays"))
    gone = groups.join(cut(stays), F.col("root") == F.col("_root")).where(F.col("row") != F.col("_stays")).select(F.col("row").alias("_gone"))
    return numbered.join(cut(gone), F.col(row) == F.col("_gone"), "left_anti").drop(row)
