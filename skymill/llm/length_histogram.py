"""Exact histogram of encoded lengths, and what follows from it for every context limit."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skymill.llm.tables import bounded_batches, text_of
from skymill.llm.tokens import encoder, vocabulary
from skymill.runtime import cut

CHUNK = 1024


def encoded_lengths(docs: DataFrame, path: str | None = None, extra: int = 0, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``: ids of each whole text plus ``extra``. Null or empty texts count ``extra``."""
    at = path or vocabulary()

    @F.pandas_udf("long")
    def lengths(texts: pd.Series) -> pd.Series:
        enc = encoder(at)
        width = enc.dtype.itemsize
        return pd.Series([len(x) // width + extra for x in enc.encode(texts)], dtype="int64")

    return bounded_batches(docs).withColumn("n_tokens", lengths(text_of(text)))


def histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens, n_docs``: counted before the shuffle, so a length that a third of the documents share is no hot key."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row per distinct length L: the answers for the context limit L, exact.

    n_docs, n_tokens_at: documents of that length and their tokens. docs_reaching, tokens_reaching: documents of
    length L or more and their tokens. truncated_tokens: all documents cut to L tokens. lost_tokens: what that cut
    drops. docs_within: documents of length L or less; within_share: that as a share, so the q-quantile is the first
    length whose share is q or more. An empty histogram gives no row.

    Lengths are summed in chunks of 1,024; only one row per chunk is summed in one place.
    """
    h = cut(hist.withColumn("_chunk", F.floor(F.col("n_tokens") / CHUNK)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs")))
    up = Window.partitionBy("_chunk").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    chunks = h.groupBy("_chunk").agg(F.sum("n_docs").alias("_cd"), F.sum("_tokens").alias("_ct"))
    later = Window.orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chunks = chunks.select(
        "_chunk",
        F.coalesce(F.sum("_cd").over(later), F.lit(0)).alias("_od"),
        F.coalesce(F.sum("_ct").over(later), F.lit(0)).alias("_ot"),
        F.sum("_cd").over(every).alias("_alld"),
        F.sum("_ct").over(every).alias("_allt"),
    )
    local = h.withColumns({"_ld": F.sum("n_docs").over(up), "_lt": F.sum("_tokens").over(up)})
    reach, reach_t = F.col("_ld") + F.col("_od"), F.col("_lt") + F.col("_ot")
    below, below_t = F.col("_alld") - reach, F.col("_allt") - reach_t
    truncated = below_t + F.col("n_tokens") * reach
    within = below + F.col("n_docs")
    return local.join(chunks, "_chunk").select(
        "n_tokens",
        "n_docs",
        F.col("_tokens").alias("n_tokens_at"),
        reach.alias("docs_reaching"),
        reach_t.alias("tokens_reaching"),
        truncated.alias("truncated_tokens"),
        (F.col("_allt") - truncated).alias("lost_tokens"),
        within.alias("docs_within"),
        (within / F.col("_alld")).alias("within_share"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``limit, docs_over, truncated_tokens, total_tokens`` for any limits, also ones that no document has as length.

    With L' the least length above the limit: documents over it are those reaching L', and cutting to the limit keeps
    all tokens below L' plus the limit for each document that reaches L'.
    """
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    over = F.col("n_tokens") > F.col("limit")
    total = F.max(F.col("truncated_tokens") + F.col("lost_tokens"))
    asked = F.array(*[F.lit(int(x)) for x in limits])
    rows = sums.withColumn("limit", F.explode(asked)).groupBy("limit").agg(
        F.coalesce(F.max(F.when(over, F.col("docs_reaching"))), F.lit(0)).alias("docs_over"),
        F.coalesce(F.max(F.when(over, F.col("tokens_reaching"))), F.lit(0)).alias("_over_t"),
        total.alias("total_tokens"),
    )
    return wanted.join(rows, "limit").select(
        "limit", "docs_over", (F.col("total_tokens") - F.col("_over_t") + F.col("limit") * F.col("docs_over")).alias("truncated_tokens"), "total_tokens"
    )
