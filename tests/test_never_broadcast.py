"""Tables that grow with the input are not broadcast, however small their files pass for."""

from pyspark.sql import functions as F

from skymill.operators import alignment as al
from skymill.operators import quantiles as qt
from skymill.operators import spatial as sp
from skymill.runtime import cut


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _pairs(spark):
    spots = [(F.xxhash64("id", F.lit(k)) % 1000 / 7.0).alias(c) for k, c in enumerate((*al.SRC, *al.DST))]
    return cut(spark.range(600).select((F.col("id") % 5).alias("session_id"), F.floor(F.col("id") / 5).alias("idx"), F.lit(1.5).alias("inlier_threshold_m"), *spots))


def test_pairs_and_draws_of_the_robust_fit(spark):
    pairs = _pairs(spark)
    sizes = pairs.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    assert "BroadcastHashJoin" not in _plan(al._hypotheses(pairs, sizes, 20, 42, 1e-5, 1e-4))
    assert "BroadcastHashJoin" not in _plan(al.with_residuals(pairs, cut(al.umeyama(pairs))))


def test_a_session_of_many_slices_is_fitted_like_one_of_one(spark, monkeypatch):
    fit = lambda: [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in al.ransac_similarity(_pairs(spark), ["idx"], trials=20).orderBy("session_id").collect()]
    whole = fit()
    monkeypatch.setattr(al, "SLICE", 7)
    assert len(whole) == 5 and fit() == whole


def test_values_of_many_intervals(spark, monkeypatch):
    vals = cut(spark.range(50_000).select((F.col("id") % 9).alias("k"), (F.col("id") % 2).cast("double").alias("_v")))
    asked = vals.groupBy("k").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.lit(0).alias("_start"))
    few = qt._values(vals, asked, ["k"])
    assert "BroadcastHashJoin" in _plan(few) and few.count() == 50_000
    monkeypatch.setattr(qt, "SPANS", 8)
    many = qt._values(vals, asked, ["k"])
    assert "SortMergeJoin" in _plan(many) and "BroadcastHashJoin" not in _plan(many) and many.count() == 50_000


def test_cells_and_locations_looked_up_around(spark):
    cells = cut(spark.range(500).select(F.lit(1).alias("mission_id"), *[F.floor(F.col("id") / 10**k % 10).cast("long").alias(g) for k, g in enumerate(sp.G)], F.col("id").alias("a"), *[F.lit(0.0).alias(f"a_{c}") for c in sp.BOX]))
    met = sp._neighbour_cells(cells, cells.withColumnsRenamed({"a": "b"} | {f"a_{c}": f"b_{c}" for c in sp.BOX}), 2)
    assert {"a", "b", "a_lo_x", "b_hi_z"} <= set(met.columns)
    assert "BroadcastHashJoin" not in _plan(met)
    at = cut(spark.range(3000).select(F.lit(1).alias("mission_id"), F.col("id").alias("loc_id"), *[(F.col("id") % m / 4.0).alias(c) for m, c in ((7, "x"), (11, "y"), (13, "z"))], F.lit(1).alias("w")))
    at = cut(sp._with_grid(at, 0.5))
    assert "BroadcastHashJoin" not in _plan(sp.reached(at, at, 1.0, ["w"], F.sum))
