"""Rows made by explosion are joined by their true size."""

from itertools import product

from pyspark.sql import functions as F

from skymill.operators import alignment as al
from skymill.operators import spatial as sp


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _limited(spark, limit, make):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        return make()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_draws_of_many_sessions_are_not_broadcast(spark):
    spots = [(F.xxhash64("id", F.lit(k)) % 1000 / 7.0).alias(c) for k, c in enumerate((*al.SRC, *al.DST))]
    pairs = spark.range(10_000).select((F.col("id") % 50).alias("session_id"), F.floor(F.col("id") / 50).alias("idx"), *spots)
    sizes = pairs.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    plan = _limited(spark, "100k", lambda: _final_plan(al._hypotheses(pairs, sizes, 300, 42, 1e-5, 1e-4)))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_cells_around_are_not_broadcast_and_each_pair_comes_once(spark, tmp_path):
    path = f"{tmp_path}/cells"
    spots = spark.range(1000).select(F.lit(1).alias("mission_id"), *[F.floor(F.col("id") / 10**k % 10).cast("long").alias(g) for k, g in enumerate(sp.G)], F.col("id").alias("node"))
    spots.write.parquet(path)
    cells = spark.read.parquet(path)
    plan = _limited(spark, "150k", lambda: _final_plan(sp._neighbour_cells(cells, cells.withColumnRenamed("node", "b"), 2).drop("b")))
    assert "Exchange hashpartitioning(mission_id" in plan
    got = [tuple(sorted([(r["gx"], r["gy"], r["gz"]), (r["hx"], r["hy"], r["hz"])])) for r in sp._neighbour_cells(cells, cells.withColumnRenamed("node", "b"), 2).collect()]
    want = {tuple(sorted([a, b])) for a in product(range(10), repeat=3) for d in product(range(-2, 3), repeat=3) for b in [tuple(x + y for x, y in zip(a, d))] if a != b and all(0 <= x < 10 for x in b)}
    assert len(got) == len(set(got)) and set(got) == want
