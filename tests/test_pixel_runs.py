"""Pixels travel packed: the same pixels, the same classes, the same mosaic as from rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skymill.operators import raster as rs
from skymill.operators import semantics as sm
from skymill.operators.pixels import TILE, pixel_runs


def _table(spark):
    px = spark.range(5000).select((F.col("id") % 3).alias("image_id"), F.floor(F.col("id") / 900).cast("long").alias("row"), (F.floor(F.col("id") / 3) % 300).cast("long").alias("col"), F.when(F.col("id") % 11 > 0, F.col("id") % 8).cast("int").alias("class_id"))
    return px.unionByName(px.where("col < 5")).orderBy(F.xxhash64("image_id", "row", "col"))


def test_runs_hold_every_pixel_and_stay_within_tiles(spark):
    for px in (_table(spark), _table(spark).coalesce(1).sortWithinPartitions("image_id", "row", "col")):
        runs = pixel_runs(px, "class_id")
        back = runs.select("image_id", "row", "lo", F.posexplode("run")).select("image_id", "row", (F.col("lo") + F.col("pos")).alias("col"), F.col("col").alias("class_id"))
        assert sorted(map(str, back.collect())) == sorted(map(str, px.collect()))
        assert runs.where(F.floor((F.col("lo") + 1) / TILE) != F.floor((F.col("lo") + F.size("run")) / TILE)).count() == 0


def test_observations_take_their_class_from_runs(spark):
    obs = spark.range(2000).select((F.col("id") % 4).alias("image_id"), F.col("id").alias("obs_idx"), (F.col("id") % 613 / 2.0 - 1).alias("u"), (F.col("id") % 17 / 2.0 - 1).alias("v"))
    px = _table(spark)
    got = sm.observed_classes(obs, px)
    want = obs.withColumns({"row": F.rint("v").cast("long"), "col": F.rint("u").cast("long")}).join(px, ["image_id", "row", "col"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 500
    assert "MapInArrow" in got._jdf.queryExecution().toString()


def test_mosaic_of_pictures_of_several_tiles(spark):
    h, w, gsd = 270, 300, 3.0
    poses = pd.DataFrame([{"session_id": 1, "image_id": i, "r00": 1.0, "r01": 0.0, "r02": 0.0, "r10": 0.0, "r11": -1.0, "r12": 0.0, "r20": 0.0, "r21": 0.0, "r22": -1.0, "tx": -10.0 * i, "ty": 5.0 * i, "tz": 60.0, "fx": 64.0, "fy": 64.0, "cx": 150.0, "cy": 135.0, "width": w, "height": h} for i in range(3)])
    canvas = pd.DataFrame([{"session_id": 1, "x_min": -160.0, "x_max": 190.0, "y_min": -140.0, "y_max": 160.0, "z_ref": 1.5}])
    rng = np.random.default_rng(3)
    gray, held = rng.integers(0, 256, (2, h, w)), rng.random((2, h, w)) < 0.9  # the third picture is missing
    at = np.argwhere(held)
    px = pd.DataFrame({"image_id": at[:, 0], "row": at[:, 1], "col": at[:, 2], "gray": gray[held].astype(np.int32)})
    mosaic = rs.orthomosaic(spark.createDataFrame(poses), spark.createDataFrame(px), spark.createDataFrame(canvas), gsd)
    got = {(r["row"], r["col"]): (r["gray"], r["coverage"]) for r in mosaic.collect()}
    padded = np.zeros((2, h + 2, w + 2))
    padded[:, 1:-1, 1:-1] = np.where(held, gray, 0)
    want = {}
    for row in range(100):
        for col in range(117):
            found = []
            for i in range(2):
                u, v = 64.0 * (-160.0 + col * gsd - 10.0 * i) / 58.5 + 150.0, 64.0 * (-(160.0 - row * gsd) + 5.0 * i) / 58.5 + 135.0
                if 0 <= np.rint(u) <= w - 1 and 0 <= np.rint(v) <= h - 1:
                    a, b = int(np.floor(v)), int(np.floor(u))
                    found.append(sum((1 - abs(v - a - p)) * (1 - abs(u - b - q)) * padded[i, a + 1 + p, b + 1 + q] for p in (0, 1) for q in (0, 1)))
            if found:
                want[row, col] = (int(np.floor(np.mean(found) + 1e-9)), len(found))
    assert got == want and len(want) > 5000
    assert "MapInArrow" in mosaic._jdf.queryExecution().toString()
