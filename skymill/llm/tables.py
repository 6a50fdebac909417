"""Small helpers the operators share: reading tables, safe columns, rows that must not sit in one task."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skymill.runtime import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TEXT_ROWS = 250  # texts handed to a Python worker at once
SET_ROWS = 200  # the same where a worker also gives back whole sets of shingles


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``TEXT_ROWS`` rows: whole texts are long, and a worker holds a
    batch several times over (Arrow, pandas, words)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What is written inside hands texts to Python workers ``SET_ROWS`` rows at a time; afterwards the session is as before."""
    conf, key = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(SET_ROWS))
    try:
        yield
    finally:
        conf.set(key, before)


def text_of(column: str = "text") -> Column:
    """The text, with null counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(column: str = "text") -> Column:
    """Tells rows that repeat a document id with another text apart."""
    return F.xxhash64(text_of(column))


def without_rows(docs: DataFrame, gone: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose id and text are not in ``gone`` (written; ``doc_id, _key``), with their columns.

    Ids alone say nothing: they may be null or repeat with other texts. With ``once``, one row stays of those that repeat
    both id and text.
    """
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("_key").alias("_gone_key"))
    same = lambda i, k: F.col("doc_id").eqNullSafe(F.col(i)) & (row_key() == F.col(k))
    left = docs.join(gone, same("_gone_id", "_gone_key"), "left_anti")
    if not once:
        return left
    counted = docs.groupBy(F.col("doc_id").alias("_twice_id"), row_key().alias("_twice_key")).agg(F.count(F.lit(1)).alias("_times"))
    twice = cut(counted.where(F.col("_times") > 1).drop("_times"))
    if twice.isEmpty():
        return left
    rest = left.join(twice, same("_twice_id", "_twice_key"), "left_anti")
    some = left.join(twice, same("_twice_id", "_twice_key"), "left_semi")
    one = some.groupBy("doc_id", row_key().alias("_one_key")).agg(F.any_value(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_one_row"))
    return rest.unionByName(one.select("_one_row.*"))


def numbered(df: DataFrame, group: str, order: list[str], out: str, buckets: int = 64) -> DataFrame:
    """Dense 0-based rank ``out`` of each row within ``group``, ordered by a hash bucket and then by ``order``.

    A group may hold any share of the rows: it is ranked in ``buckets`` parts, and only one count per part is
    summed in one place.
    """
    from pyspark.sql import Window

    df = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = df.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy(group, "_part").orderBy(*order)
    ranked = df.withColumn("_within", F.row_number().over(within) - 1)
    joined = ranked.join(starts, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(out, F.col("_start") + F.col("_within")).drop("_g", "_p", "_part", "_start", "_within")


class Sieve:
    """A bitmap of 64-bit hashes, to leave out rows without a partner before they are shuffled; some may slip through.

    It holds 16 bits for each hash, but ``MOST`` (16 MB) at most: with more hashes more rows slip through, none is lost.
    """

    MOST = 1 << 27

    def __init__(self, hashes: DataFrame, column: str):
        sc = hashes.sparkSession.sparkContext
        self.bits = min(self.MOST, max(1 << 15, 1 << (16 * hashes.count()).bit_length()))
        place = F.col(column).bitwiseAND(F.lit(self.bits - 1)) + 1  # the bitmap functions count from one
        maps = hashes.groupBy(F.bitmap_bucket_number(place).alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_m"))
        found = {r["_b"]: r["_m"] for r in maps.collect()}  # at most MOST / 32768 rows of 4 KB
        blank = bytes(4096)
        self.map = sc.broadcast(b"".join(bytes(found.get(b, blank)) for b in range(1, self.bits // 32768 + 1)))

    def test(self):
        """A function for Python workers: which of an array of hashes pass."""
        sent, mask = self.map, self.bits - 1

        def passes(hashes: np.ndarray) -> np.ndarray:
            at = hashes & mask
            return np.frombuffer(sent.value, dtype=np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1

        return passes

    def close(self) -> None:
        self.map.destroy()


def sifted(df: DataFrame, column: str, hashes: DataFrame, of: str) -> DataFrame:
    """Written: the rows of ``df`` whose ``column`` may be among the column ``of`` of ``hashes`` (written)."""
    sieve = Sieve(hashes, of)
    passes = sieve.test()

    @F.pandas_udf("boolean")
    def may(column: pd.Series) -> pd.Series:
        return pd.Series(passes(column.to_numpy(dtype=np.int64)), index=column.index)

    out = cut(df.where(may(column)))
    sieve.close()
    return out
