"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymill.runtime import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each linked node reaches. ``edges`` has long columns ``u, v``, in any
    direction, repeated or not; links of a node to itself say nothing. Nodes without links are not returned.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest of them; the number of
    rounds grows with the logarithm of the longest path. Minima are combined before the shuffle, and both sides of
    each join are written tables, so a node with very many links is split like any hot key.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy(F.col("u").alias("_n")).agg(F.min("v").alias("_m")))
        large = both.join(least, F.col("u") == F.col("_n")).where(F.col("v") > F.col("u"))
        e = cut(large.select(F.col("v").alias("u"), F.least("u", "_m").alias("v")).distinct())
        least = cut(e.groupBy(F.col("u").alias("_n")).agg(F.min("v").alias("_m")))
        small = e.join(least, F.col("u") == F.col("_n")).where(F.col("v") != F.col("_m")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        e = cut(small.unionByName(least.select(F.col("_n").alias("u"), F.col("_m").alias("v"))).distinct())
        now = _state(e)
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
