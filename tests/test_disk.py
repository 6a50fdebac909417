"""What a finished step needs no more is deleted: its shuffles, and tables written for it."""

import os

from pyspark.sql import functions as F

from skymill import runtime
from skymill.operators import neighbours as nb


def _files(df):
    return [f.removeprefix("file://") for f in df.inputFiles()]


def _shuffles(spark):
    ids = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().iterator()
    n = 0
    while ids.hasNext():
        n += ids.next().name().startswith("shuffle_")
    return n


def test_a_written_table_leaves_no_shuffle_behind(spark):
    before = _shuffles(spark)
    table = runtime.cut(spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).count())
    assert _shuffles(spark) <= before and table.count() == 1000
    assert spark.conf.get(runtime._CLEANUP, None) in (None, "false")


def test_only_the_named_table_is_discarded(spark):
    one, two = (runtime.cut(spark.range(n).toDF("id")) for n in (3, 4))
    gone = _files(one)
    runtime.discard(one)
    assert not any(os.path.exists(f) for f in gone) and two.count() == 4


def test_a_search_keeps_only_its_answers(spark):
    locs = spark.range(600).select(F.lit(1).alias("mission_id"), F.col("id").alias("loc_id"), *[(F.xxhash64("id", F.lit(c)) % 1000 / 7.0).alias(c) for c in "xyz"], F.lit(1).alias("w"), F.lit(4).alias("_k"))
    before = set(runtime._WRITTEN)
    out = nb.nearest(locs, True, "mean")
    assert out.count() == 600
    assert len(set(runtime._WRITTEN) - before) == 1
