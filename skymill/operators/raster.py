"""Grids over point clouds and stencils over pixel tables; a missing cell means unknown."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skymill.functions.camera import R_NAMES, camera_center, cols, rot
from skymill.functions.taxonomy import GROUND_LIKE_IDS
from skymill.operators.confidence import confidence_tier
from skymill.operators.quantiles import exact_percentiles
from skymill.operators.pixels import TILE, pixel_runs
from skymill.runtime import shuffled, spread

MISSION = ["mission_id"]


def cloud_bounds(points: DataFrame, cell: float, keys: list[str] = MISSION) -> DataFrame:
    """One row per mission: extent and grid shape."""
    b = points.groupBy(*keys).agg(
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max")
    )
    return b.withColumns(
        {
            "n_cols": F.greatest(F.lit(1), F.ceil((F.col("x_max") - F.col("x_min")) / cell)).cast("long"),
            "n_rows": F.greatest(F.lit(1), F.ceil((F.col("y_max") - F.col("y_min")) / cell)).cast("long"),
        }
    )


def with_cells(points: DataFrame, bounds: DataFrame, cell: float, north_up: bool) -> DataFrame:
    """Adds ``row, col``: truncated, held to the last cell; row 0 is north in elevation rasters, south otherwise."""
    df = points.join(bounds, MISSION)
    col = F.floor((F.col("x") - F.col("x_min")) / cell).cast("long")
    up = F.floor((F.col("y") - F.col("y_min")) / cell).cast("long")
    row = F.col("n_rows") - 1 - up if north_up else up

    def hold(i: Column, n: str) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(i, F.col(n) - 1))

    return df.withColumns({"row": hold(row, "n_rows"), "col": hold(col, "n_cols")})


def grid_elevation(points: DataFrame, cell: float, agg: str, bounds: DataFrame | None = None) -> DataFrame:
    """O1: highest (``max``) or lowest (``min``) point per cell."""
    bounds = cloud_bounds(points, cell) if bounds is None else bounds
    fn = {"max": F.max, "min": F.min}[agg]
    return with_cells(points, bounds, cell, True).groupBy(*MISSION, "row", "col").agg(fn("z").alias("z"))


def surface_and_terrain(points: DataFrame, cell: float = 1.0) -> DataFrame:
    """O2: surface and terrain height per cell in one pass; ``dtm`` is NULL where no ground-like point fell."""
    bounds = cloud_bounds(points, cell)
    ground = F.col("class_id").isin(*GROUND_LIKE_IDS)
    return (
        with_cells(points, bounds, cell, True)
        .groupBy(*MISSION, "row", "col", "n_rows", "n_cols")
        .agg(
            F.max("z").alias("dsm"),
            F.min(F.when(ground, F.col("z"))).alias("dtm"),
            F.count_if(ground).alias("n_ground"),
        )
    )


def volumetrics(surfaces: DataFrame, cell: float = 1.0, min_height_m: float = 0.5) -> DataFrame:
    """A10: volume, area and heights above terrain; zeros when nothing stands above it."""
    h = F.col("dsm") - F.col("dtm")
    up = F.when(h > min_height_m, h)

    def or_zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return surfaces.groupBy(*MISSION).agg(
        or_zero(F.sum(up) * (cell * cell)).alias("total_above_ground_volume_m3"),
        (F.count(up) * F.lit(cell * cell)).alias("elevated_surface_area_m2"),
        or_zero(F.avg(up)).alias("mean_elevated_height_m"),
        or_zero(F.max(up)).alias("max_height_m"),
    )


def elevation_stats(surfaces: DataFrame) -> DataFrame:
    """O2 statistics: grid shape, ground points used, unknown share of the terrain raster."""
    cells = F.first("n_rows") * F.first("n_cols")
    return surfaces.groupBy(*MISSION).agg(
        F.first("n_rows").alias("n_rows"),
        F.first("n_cols").alias("n_cols"),
        F.sum("n_ground").alias("n_ground_points"),
        ((cells - F.count("dtm")) / cells * 100.0).alias("pct_dtm_cells_unknown"),
    )


def region_grid(points: DataFrame, cell: float = 5.0) -> DataFrame:
    """O3: point count and mean confidence tier per cell, row 0 in the south."""
    tiers = points.withColumn("_tier", confidence_tier().cast("double"))
    return (
        with_cells(tiers, cloud_bounds(points, cell), cell, False)
        .groupBy(*MISSION, "row", "col", "n_rows", "n_cols")
        .agg(F.count(F.lit(1)).alias("point_count"), F.avg("_tier").alias("mean_tier"))
    )


def dense_grid(grid: DataFrame, shape: DataFrame) -> DataFrame:
    """Every cell of each mission's grid, with NULL where nothing was observed."""
    rows = shape.select(*MISSION, "n_cols", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)).alias("row"))
    cells = rows.select(*MISSION, "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_cols") - 1)).alias("col"))
    return cells.join(grid.drop("n_rows", "n_cols"), [*MISSION, "row", "col"], "left")


def unobserved_share(grid: DataFrame) -> DataFrame:
    """Cells of the cloud's own box that hold no point, in percent."""
    cells = F.first("n_rows") * F.first("n_cols")
    return grid.groupBy(*MISSION).agg(((cells - F.count(F.lit(1))) / cells * 100.0).alias("pct_grid_cells_unobserved"))


def ground_reference(points: DataFrame) -> DataFrame:
    """Median height of ground-like points, of all points where there is none."""
    ground = F.when(F.col("class_id").isin(*GROUND_LIKE_IDS), F.col("z"))
    df = points.select(*MISSION, "z", ground.alias("_g"))
    on_ground = exact_percentiles(df, MISSION, "_g", {"_zg": 0.5})
    overall = exact_percentiles(df, MISSION, "z", {"_za": 0.5})
    return overall.join(on_ground, MISSION, "left").select(*MISSION, F.coalesce("_zg", "_za").alias("z_ref"))


# --- pixel stencils -----------------------------------------------------------------------------

IMAGE = ["image_id"]


def _beside(df: DataFrame, names: list[str], line: list[str], along: str) -> DataFrame:
    """Adds ``<name>_a`` and ``<name>_b``: the pixels before and after on the line, mirrored about its ends.

    A line is one image row or column, so a window never holds more than an image side.
    """
    w = Window.partitionBy(*line).orderBy(along)
    df = df.withColumns({f"{n}_a": F.lag(n).over(w) for n in names}).withColumns({f"{n}_b": F.lead(n).over(w) for n in names})
    return df.withColumns(
        {
            **{f"{n}_a": F.coalesce(f"{n}_a", f"{n}_b", n) for n in names},
            **{f"{n}_b": F.coalesce(f"{n}_b", f"{n}_a", n) for n in names},
        }
    )


def laplacian(pixels: DataFrame, value: str = "gray") -> DataFrame:
    """Four-neighbour Laplacian per pixel with mirrored borders."""
    px = pixels.select(*IMAGE, "row", "col", F.col(value).cast("double").alias("_c"))
    px = _beside(px, ["_c"], [*IMAGE, "row"], "col")
    px = px.withColumn("_h", F.col("_c_a") + F.col("_c_b") - F.lit(4.0) * F.col("_c")).drop("_c_a", "_c_b")
    px = _beside(px, ["_c"], [*IMAGE, "col"], "row")
    return px.select(*IMAGE, "row", "col", (F.col("_h") + F.col("_c_a") + F.col("_c_b")).alias("lap"))


def sobel(pixels: DataFrame, value: str = "gray") -> DataFrame:
    """3x3 Sobel gradients, separated into a pass along rows and a pass along columns."""
    px = pixels.select(*IMAGE, "row", "col", F.col(value).cast("double").alias("_c"))
    px = _beside(px, ["_c"], [*IMAGE, "row"], "col")
    px = px.select(
        *IMAGE,
        "row",
        "col",
        (F.col("_c_b") - F.col("_c_a")).alias("_d"),
        (F.col("_c_a") + 2.0 * F.col("_c") + F.col("_c_b")).alias("_s"),
    )
    px = _beside(px, ["_d", "_s"], [*IMAGE, "col"], "row")
    return px.select(
        *IMAGE,
        "row",
        "col",
        (F.col("_d_a") + 2.0 * F.col("_d") + F.col("_d_b")).alias("gx"),
        (F.col("_s_b") - F.col("_s_a")).alias("gy"),
    )


def sharpness(pixels: DataFrame, value: str = "gray") -> DataFrame:
    """Variance of the Laplacian per image."""
    return laplacian(pixels, value).groupBy(*IMAGE).agg(F.var_pop("lap").alias("sharpness"))


def gradient_confidence(pixels: DataFrame, value: str = "gray") -> DataFrame:
    """Sobel magnitude over 100, held to [0.4, 0.95], per pixel."""
    mag = F.hypot(F.col("gx"), F.col("gy")) / 100.0
    return sobel(pixels, value).select(
        *IMAGE, "row", "col", F.least(F.lit(0.95), F.greatest(F.lit(0.4), mag)).alias("depth_confidence")
    )


def exposure_score(pixels: DataFrame, value: str = "gray") -> DataFrame:
    """One minus the share of crushed (<5) or blown (>252) pixels."""
    clipped = (F.col(value) < 5) | (F.col(value) > 252)
    return pixels.groupBy(*IMAGE).agg((1.0 - F.count_if(clipped) / F.count(F.lit(1))).alias("exposure"))


# --- footprints and the orthomosaic -------------------------------------------------------------


def with_footprint(poses: DataFrame, z_lo: str, z_hi: str, box: tuple[str, str, str, str]) -> DataFrame:
    """Adds ``f_x0, f_x1, f_y0, f_y1``: an x-y box that holds everything the camera can see with z in the given span.

    The view pyramid is cut by two planes. Where a corner ray does not descend, the whole scene box stands in,
    so the result never leaves anything out.
    """
    c = camera_center(rot(), cols("tx", "ty", "tz"))
    df = poses.withColumns({f"_k{i}": c[i] for i in range(3)})
    m = rot()
    rays = []
    for u in (F.lit(0.0), F.col("width")):
        for v in (F.lit(0.0), F.col("height")):
            d = [(u - F.col("cx")) / F.col("fx"), (v - F.col("cy")) / F.col("fy"), F.lit(1.0)]
            rays.append([m[0][j] * d[0] + m[1][j] * d[1] + m[2][j] * d[2] for j in range(3)])
    df = df.withColumns({f"_d{r}{j}": rays[r][j] for r in range(4) for j in range(3)})
    top = F.least(F.col(z_hi), F.col("_k2"))
    ok = F.lit(True)
    xs, ys = [], []
    for r in range(4):
        dz = F.col(f"_d{r}2")
        ok = ok & (dz < -1e-9)
        for plane in (F.col(z_lo), top):
            reach = F.greatest(F.lit(0.0), (plane - F.col("_k2")) / dz)
            xs.append(F.col("_k0") + F.col(f"_d{r}0") * reach)
            ys.append(F.col("_k1") + F.col(f"_d{r}1") * reach)
    x0, x1, y0, y1 = (F.col(b) for b in box)
    slack = 1e-6
    df = df.withColumns(
        {
            "f_x0": F.when(ok, F.greatest(x0, F.least(*xs) - slack)).otherwise(x0),
            "f_x1": F.when(ok, F.least(x1, F.greatest(*xs) + slack)).otherwise(x1),
            "f_y0": F.when(ok, F.greatest(y0, F.least(*ys) - slack)).otherwise(y0),
            "f_y1": F.when(ok, F.least(y1, F.greatest(*ys) + slack)).otherwise(y1),
        }
    )
    return df.drop("_k0", "_k1", "_k2", *[f"_d{r}{j}" for r in range(4) for j in range(3)])


def orthomosaic(
    poses: DataFrame, pixels: DataFrame, canvas: DataFrame, gsd: float = 0.2, keys: list[str] = ["session_id"]
) -> DataFrame:
    """Mean colour and cover count per canvas cell.

    ``canvas`` has one row per session: ``x_min, x_max, y_min, y_max, z_ref``. Every frame looks only at the cells
    under its own footprint, so work follows covered area times overlap and no frame meets every cell. Pictures come to their
    frames as tiles of packed runs of pixels; a cell is coloured where the tile lies, and only sums by cell are shuffled.
    """
    shaped = canvas.withColumns(
        {
            "n_cols": F.greatest(F.lit(1), F.ceil((F.col("x_max") - F.col("x_min")) / gsd)).cast("long"),
            "n_rows": F.greatest(F.lit(1), F.ceil((F.col("y_max") - F.col("y_min")) / gsd)).cast("long"),
        }
    )
    placed = poses.join(shaped, keys)
    placed = placed.withColumns(
        {"_bx1": F.col("x_min") + F.col("n_cols") * gsd, "_by0": F.col("y_max") - F.col("n_rows") * gsd}
    )
    # a tile of the picture is a camera of its own, with the part of the footprint that its pixels see
    whole = [f"_o_{c}" for c in ("cx", "cy")]
    imaged = placed.join(shuffled(pixels.select("image_id").distinct()), "image_id", "left_semi")
    tiles = imaged.withColumns({o: F.col(o[3:]) for o in whole})
    for t, n in (("_tv", "height"), ("_tu", "width")):
        tiles = tiles.withColumn(t, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(n) / TILE).cast("long"))))
    low = {c: F.greatest(F.lit(-0.5), F.col(t) * float(TILE) - 1.0) for c, t in (("cx", "_tu"), ("cy", "_tv"))}
    high = {c: F.least(F.col(n) - 0.5, F.col(t) * float(TILE) + (TILE - 1.0)) for c, t, n in (("cx", "_tu", "width"), ("cy", "_tv", "height"))}
    tiles = tiles.withColumns({"_pw": F.col("width"), "_ph": F.col("height")} | {"width": high["cx"] - low["cx"], "height": high["cy"] - low["cy"]} | {c: F.col(c) - low[c] for c in low})
    tiles = spread(tiles.where("width >= 0 AND height >= 0"), "image_id", "_tv", "_tu")  # also keeps the generated code small
    seen = with_footprint(tiles, "z_ref", "z_ref", ("x_min", "_bx1", "_by0", "y_max"))

    def ends(lo: Column, hi: Column, n: str) -> list[Column]:
        return [F.greatest(F.lit(0).cast("long"), F.floor(lo).cast("long")), F.least(F.col(n) - 1, F.ceil(hi).cast("long"))]

    r0, r1 = ends((F.col("y_max") - F.col("f_y1")) / gsd, (F.col("y_max") - F.col("f_y0")) / gsd, "n_rows")
    k0, k1 = ends((F.col("f_x0") - F.col("x_min")) / gsd, (F.col("f_x1") - F.col("x_min")) / gsd, "n_cols")
    camera = [F.col(c).cast("double").alias(c) for c in (*R_NAMES, "tx", "ty", "tz", "fx", "fy")]
    seen = seen.select(
        *keys, "image_id", F.col("_tv").alias("tv"), F.col("_tu").alias("tu"), *camera, F.col("_o_cx").cast("double").alias("cx"), F.col("_o_cy").cast("double").alias("cy"), F.col("_pw").cast("long").alias("width"),
        F.col("_ph").cast("long").alias("height"), "x_min", "y_max", F.col("z_ref").cast("double").alias("z_ref"), r0.alias("r0"), r1.alias("r1"), k0.alias("k0"), k1.alias("k1"),
    )
    # the lower neighbour of a tile's last line or column lies in the tile itself: both border lines are held twice
    runs = pixel_runs(pixels, "gray")
    last = F.col("lo") + F.size("run") - 1
    over = lambda a, b: F.explode(F.sequence(F.floor(a / TILE).cast("long"), F.floor((b + 1) / TILE).cast("long")))
    runs = runs.withColumn("_tv", over(F.col("row"), F.col("row"))).withColumn("_tu", over(F.col("lo"), last))
    packed = runs.groupBy("image_id", F.col("_tv").alias("tv"), F.col("_tu").alias("tu")).agg(F.collect_list(F.struct("row", "lo", "run")).alias("runs"))
    met = seen.join(shuffled(packed), ["image_id", "tv", "tu"], "left")
    kinds = dict(seen.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", row long, col long, _g double, _n long"
    sums = met.mapInPandas(lambda parts: _sampled(parts, keys, gsd), schema)
    return sums.groupBy(*keys, "row", "col").agg(
        F.floor(F.sum("_g") / F.sum("_n") + 1e-9).cast("int").alias("gray"), F.sum("_n").alias("coverage")
    )


CELLS = 1_000_000  # canvas cells looked at together


def _sampled(parts: Iterator[pd.DataFrame], keys: list[str], gsd: float) -> Iterator[pd.DataFrame]:
    """Sums of colour and covers of the canvas cells under each tile, added up as far as they lie in one batch."""
    for pdf in parts:
        held, size = [], 0
        spans = ["r0", "r1", "k0", "k1"]
        pdf = pdf.dropna(subset=spans).astype({c: np.int64 for c in spans})  # a pose that is not known sees nothing
        for t in pdf[(pdf["r0"] <= pdf["r1"]) & (pdf["k0"] <= pdf["k1"])].itertuples(index=False):
            gray = _tile(t)
            step = max(1, CELLS // (t.k1 - t.k0 + 1))
            for r in range(t.r0, t.r1 + 1, step):
                row, col, g = _hits(t, gray, np.arange(r, min(r + step, t.r1 + 1)), gsd)
                held.append(pd.DataFrame({k: getattr(t, k) for k in keys} | {"row": row, "col": col, "_g": g, "_n": np.int64(1)}, index=range(len(row))))
                size += len(row)
                if size > CELLS:
                    yield _added(held, keys)
                    held, size = [], 0
        if held:
            yield _added(held, keys)


def _added(held: list[pd.DataFrame], keys: list[str]) -> pd.DataFrame:
    return pd.concat(held).groupby([*keys, "row", "col"], as_index=False, dropna=False).sum()


def _tile(t) -> np.ndarray:
    """The pixels of a tile, its last line and column those of the next; unknown ones count as black."""
    gray = np.zeros((TILE + 1, TILE + 1))
    for line in t.runs if t.runs is not None else ():
        v, u = line["row"] + 1 - t.tv * TILE, line["lo"] + 1 - t.tu * TILE
        run = np.array([0.0 if x is None else x for x in line["run"]], float)
        a, b = max(0, -u), min(len(run), TILE + 1 - u)
        if a < b:
            gray[v, u + a : u + b] += run[a:b]
    return gray


def _hits(t, gray: np.ndarray, rows: np.ndarray, gsd: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and colour of the cells on the given canvas lines whose upper left pixel lies in the tile."""
    row, col = (a.ravel() for a in np.meshgrid(rows, np.arange(t.k0, t.k1 + 1), indexing="ij"))
    x, y, z = t.x_min + col * gsd, t.y_max - row * gsd, t.z_ref
    c = [getattr(t, f"r{i}0") * x + getattr(t, f"r{i}1") * y + getattr(t, f"r{i}2") * z + getattr(t, f"t{a}") for i, a in enumerate("xyz")]
    with np.errstate(all="ignore"):
        pu, pv = t.fx * c[0] / c[2] + t.cx, t.fy * c[1] / c[2] + t.cy
        inside = (c[2] > 1e-6) & (np.rint(pu) >= 0) & (np.rint(pu) <= t.width - 1) & (np.rint(pv) >= 0) & (np.rint(pv) <= t.height - 1)
    row, col, pu, pv = row[inside], col[inside], pu[inside], pv[inside]
    v, u = np.floor(pv), np.floor(pu)
    i, j = (v + 1).astype(np.int64) - t.tv * TILE, (u + 1).astype(np.int64) - t.tu * TILE
    own = (i >= 0) & (i < TILE) & (j >= 0) & (j < TILE)
    row, col, pu, pv, v, u, i, j = (a[own] for a in (row, col, pu, pv, v, u, i, j))
    g = np.zeros(len(row))
    for dv in (0, 1):
        for du in (0, 1):
            g += (1.0 - np.abs(pv - v - dv)) * (1.0 - np.abs(pu - u - du)) * gray[i + dv, j + du]
    return row, col, g
