"""Neighbourhoods, clusters and shapes of point clouds.

Common ground of everything here:

* copies of one position are merged into one weighted location first, so a pile of copies costs one row;
* positions meet through equi-joins on grid cells whose size follows from the radius or the local density;
* cell summaries (count and tight box) settle most of the work, and individual points are compared only where
  a box straddles the radius, which keeps the number of compared pairs linear in the number of points even
  when one cell holds most of them.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skymill.functions.taxonomy import BUILDING_ID, ELEVATED_CLASS_IDS
from skymill.operators import neighbours
from skymill.operators.quantiles import exact_percentiles
from skymill.runtime import cut, shuffled, spread

MISSION = ["mission_id"]
G = ["gx", "gy", "gz"]
K = ["kx", "ky", "kz"]
XYZ = ["x", "y", "z"]
BOX = [f"{m}{c}" for m in ("lo_", "hi_") for c in XYZ]


def locations(points: DataFrame) -> DataFrame:
    """Distinct positions with their number of copies ``w`` and smallest point id ``loc_id``."""
    return points.groupBy(*MISSION, *XYZ).agg(F.count(F.lit(1)).alias("w"), F.min("point_id").alias("loc_id"))


def _with_grid(df: DataFrame, side: float) -> DataFrame:
    return df.withColumns({g: F.floor(F.col(c) / F.lit(side)).cast("long") for g, c in zip(G, XYZ)})


def _offsets(reach: int) -> Column:
    span = range(-reach, reach + 1)
    return F.array(
        *[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip("ijk", o)]) for o in product(span, span, span)]
    )


def _boxes() -> list[Column]:
    return [F.min(c).alias(f"lo_{c}") for c in XYZ] + [F.max(c).alias(f"hi_{c}") for c in XYZ]


def _gap2(to: str = "") -> Column:
    """Squared distance from a point to a box (zero inside)."""
    parts = [F.greatest(F.col(f"{to}lo_{c}") - F.col(c), F.lit(0.0), F.col(c) - F.col(f"{to}hi_{c}")) for c in XYZ]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def _far2(to: str = "") -> Column:
    """Squared distance from a point to the farthest corner of a box."""
    parts = [F.greatest(F.abs(F.col(f"{to}lo_{c}") - F.col(c)), F.abs(F.col(f"{to}hi_{c}") - F.col(c))) for c in XYZ]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def _dist2(a: str, b: str) -> Column:
    d = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in XYZ]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _neighbour_cells(cells: DataFrame, others: DataFrame, reach: int) -> DataFrame:
    """(cell, each existing other cell within ``reach``), one row per pair: the columns of both, keys ``g*`` of the first, ``h*`` of the second.

    Only the later half of the offsets is looked up; the opposite ones are the same pairs from the other side. The look-ups
    count as few as the cells that they come from, so the join says that they are not to be broadcast.
    """
    offsets = _offsets(reach)
    half = ((2 * reach + 1) ** 3 + 1) // 2
    out = cells.select(*cells.columns, F.explode(F.slice(offsets, half + 1, half - 1)).alias("_o"))
    out = out.select(*cells.columns, *[(F.col(g) + F.col(f"_o.{n}")).alias(f"h{g[1]}") for g, n in zip(G, "ijk")])
    renamed = others.withColumnsRenamed({g: f"h{g[1]}" for g in G})
    at = [*MISSION, "hx", "hy", "hz"]
    return spread(out, *at).join(shuffled(renamed), at)


CROWDED = 512


def _coarse(df: DataFrame) -> DataFrame:
    """Adds the radius-wide cell ``k*`` that holds the half-radius cell ``g*``."""
    return df.withColumns({k: F.floor(F.col(g) / 2).cast("long") for k, g in zip(K, G)})


def _looking(asks: DataFrame) -> DataFrame:
    """Each asking location once for every radius-wide cell it has to look into."""
    keep = [c for c in asks.columns if c not in K]
    out = asks.select(*keep, *K, F.explode(_offsets(1)).alias("_o"))
    return out.select(*keep, *[(F.col(k) + F.col(f"_o.{n}")).alias(k) for k, n in zip(K, "ijk")])


def reached(asks: DataFrame, items: DataFrame, radius: float, values: list[str], combine: Callable[[str], Column]) -> DataFrame:
    """For every asking location, its items within ``radius`` combined: ``mission_id, loc_id`` and one column per value.

    Both sides carry ``g*``, the half-radius cell. Items of thinly filled neighbourhoods are compared one by one.
    In crowded ones their half-radius cells stand in: a cell whose box lies within the radius counts as a whole, one
    outside is skipped, and only the cells that the sphere cuts are opened. ``combine`` must give the same over cells
    as over their items (sum, min). Askers per cell are few by construction (see the callers), so they are what is
    copied to the cells around, and the work stays linear in the number of items.
    """
    r2 = radius * radius
    key = [*MISSION, *K]
    asks = spread(_looking(_coarse(asks).select(*MISSION, *K, "loc_id", *XYZ)), *key)
    items = _coarse(items).select(*MISSION, *K, *G, *[F.col(c).alias(f"o_{c}") for c in XYZ], *values)
    crowd = cut(items.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWDED).select(*key))
    some = not crowd.isEmpty()
    single = items.join(crowd, key, "left_anti") if some else items
    met = asks.join(shuffled(single.drop(*G)), key).where(_dist2("", "o_") <= r2)
    out = met.select(*MISSION, "loc_id", *values)
    if some:
        dense = items.join(crowd, key, "left_semi")
        cells = dense.groupBy(*key, *G).agg(
            *[combine(v).alias(v) for v in values], *[F.min(f"o_{c}").alias(f"lo_{c}") for c in XYZ], *[F.max(f"o_{c}").alias(f"hi_{c}") for c in XYZ]
        )
        looks = asks.join(shuffled(cells), key).where(_gap2() <= r2)
        whole = looks.where(_far2() <= r2).select(*MISSION, "loc_id", *values)
        opened = looks.where(_far2() > r2).select(*MISSION, *G, "loc_id", *XYZ)
        part = opened.join(shuffled(dense.drop(*K)), [*MISSION, *G]).where(_dist2("", "o_") <= r2).select(*MISSION, "loc_id", *values)
        out = out.unionByName(whole).unionByName(part)
    return out.groupBy(*MISSION, "loc_id").agg(*[combine(v).alias(v) for v in values])


def within_radius(locs: DataFrame, radius: float, need: int) -> DataFrame:
    """Adds ``dense``: at least ``need`` points (copies and itself included) within ``radius``. Keeps the cells ``g*``.

    A half-radius cell has a diagonal below the radius: one with enough points settles all of them without a
    comparison. Only points of thinner cells ask around, and there are fewer than ``need`` of those per cell.
    """
    at = cut(_with_grid(locs, radius / 2.0 * (1.0 + 1e-9)))
    full = at.groupBy(*MISSION, *G).agg(F.sum("w").alias("_s")).where(F.col("_s") >= need).select(*MISSION, *G, F.lit(True).alias("_full"))
    at = at.join(full, [*MISSION, *G], "left")
    counts = reached(at.where(F.col("_full").isNull()), at, radius, ["w"], F.sum).withColumnRenamed("w", "_c")
    return (
        at.join(shuffled(counts), [*MISSION, "loc_id"], "left")
        .withColumn("dense", F.coalesce("_full", F.lit(False)) | (F.coalesce("_c", F.lit(0)) >= need))
        .drop("_full", "_c")
    )


def remove_radius_outliers(points: DataFrame, nb_points: int = 8, radius: float = 2.0, include_self: bool = True) -> DataFrame:
    """Keep points with more than ``nb_points`` neighbours within ``radius`` (the point itself counts by default)."""
    need = nb_points + (1 if include_self else 2)
    kept = within_radius(locations(points), radius, need).where("dense").select(*MISSION, *XYZ)
    return points.join(kept, [*MISSION, *XYZ], "left_semi")


# --- k nearest ----------------------------------------------------------------------------------


def _asking(points: DataFrame, k: int, include_self: bool, shrink: bool) -> DataFrame:
    """The distinct positions with ``_k``: at most what the mission has, with ``shrink`` its points less one, at least three."""
    locs = locations(points)
    total = locs.groupBy(*MISSION).agg(F.sum("w").alias("_total"))
    want = F.least(F.lit(k).cast("long"), F.greatest(F.lit(3).cast("long"), F.col("_total") - 1)) if shrink else F.lit(k).cast("long")
    available = F.col("_total") if include_self else F.col("_total") - 1
    return locs.join(total.select(*MISSION, F.least(want, available).alias("_k")), MISSION)


def nearest(points: DataFrame, k: int, include_self: bool = True, shrink: bool = False) -> DataFrame:
    """Exact k nearest neighbours of every distinct position.

    Returns ``mission_id, loc_id, x, y, z, w`` of the position, ``n_id, n_x, n_y, n_z`` of a neighbour, its
    ``dist`` and ``take``: how many of the k it fills (copies fill several). Missions with fewer than k points give all
    they have; with ``shrink`` k is at most the mission's points less one, and at least three.
    """
    return neighbours.nearest(_asking(points, k, include_self, shrink), include_self)


def mean_neighbour_distance(points: DataFrame, k: int, include_self: bool = True) -> DataFrame:
    """Mean distance to the k nearest, per distinct position."""
    return neighbours.nearest(_asking(points, k, include_self, False), include_self, "mean")


def remove_statistical_outliers(
    points: DataFrame, nb_neighbors: int = 20, std_ratio: float = 2.0, include_self: bool = True
) -> DataFrame:
    """Drop points whose mean neighbour distance is not below mission mean + ``std_ratio`` sample deviations.

    The search counts the point itself, and a mean distance of zero (a pile of at least k copies) is
    never kept: both follow the library whose filter this reproduces.
    """
    means = mean_neighbour_distance(points, nb_neighbors, include_self)
    w, d = F.col("w"), F.col("mean_dist")
    stats = means.groupBy(*MISSION).agg(F.sum("w").alias("_n"), (F.sum(w * d) / F.sum("w")).alias("_m"))
    spread = (
        means.join(stats, MISSION)
        .where(d > 0)
        .groupBy(*MISSION, "_n", "_m")
        .agg(F.sum(w * (d - F.col("_m")) * (d - F.col("_m"))).alias("_ss"))
    )
    limit = F.col("_m") + std_ratio * F.sqrt(F.try_divide(F.col("_ss"), F.col("_n") - 1))
    kept = means.join(spread.select(*MISSION, limit.alias("_limit")), MISSION).where((d > 0) & (d < F.col("_limit")))
    return points.join(kept.select(*MISSION, *XYZ), [*MISSION, *XYZ], "left_semi")


def clean_cloud(
    points: DataFrame,
    nb_neighbors: int = 20,
    std_ratio: float = 2.0,
    radius_filter: bool = False,
    radius_nb_points: int = 8,
    radius: float | None = None,
) -> DataFrame:
    """Statistical removal, then radius removal if asked; its radius defaults to twice the survivors' median
    nearest-neighbour distance, per mission."""
    kept = remove_statistical_outliers(points, nb_neighbors, std_ratio)
    if not radius_filter:
        return kept
    kept = cut(kept)
    if radius is not None:
        return remove_radius_outliers(kept, radius_nb_points, radius)
    # scaling each mission by its own radius lets one pass with radius 1 serve all missions
    nn = mean_neighbour_distance(kept, 1, include_self=False)
    spread = nn.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("w"))))
    radii = exact_percentiles(spread, MISSION, "mean_dist", {"_r": 0.5}).withColumn("_r", F.greatest(F.col("_r") * 2.0, F.lit(1e-12)))
    scaled = kept.join(radii, MISSION).withColumns({f"_k{c}": F.col(c) for c in XYZ}).withColumns({c: F.col(c) / F.col("_r") for c in XYZ})
    out = remove_radius_outliers(scaled, radius_nb_points, 1.0)
    return out.withColumns({c: F.col(f"_k{c}") for c in XYZ}).select(*kept.columns)


def flat_normals(cov: DataFrame) -> DataFrame:
    """Adds ``abs_nz``: |z| of the direction of least spread of the symmetric matrix ``xx, xy, xz, yy, yz, zz``, in closed form.

    The eigenvalues are the three cosines of a third of an angle. Any two rows of the matrix less its least eigenvalue
    span the plane that the direction is normal to: the longest of the three cross products is the direction. A matrix
    whose two least eigenvalues are equal has a plane of such directions; then the one nearest to upright is taken,
    and a matrix of zeros has 1.
    """
    c = {n: F.col(f"_{n}") for n in ("xx", "xy", "xz", "yy", "yz", "zz")}
    xx, xy, xz, yy, yz, zz = c.values()
    columns = cov.columns
    df = cov.withColumn("_scale", F.greatest(*[F.abs(F.col(n)) for n in c]))
    df = df.withColumns({f"_{n}": F.try_divide(F.col(n), F.col("_scale")) for n in c}).withColumn("_mean", (xx + yy + zz) / 3.0)
    mean, p = F.col("_mean"), F.col("_p")
    a, b, d = xx - mean, yy - mean, zz - mean
    df = df.withColumns(
        {
            "_p": F.sqrt((a * a + b * b + d * d + 2.0 * (xy * xy + xz * xz + yz * yz)) / 6.0),
            "_det": a * (b * d - yz * yz) - xy * (xy * d - yz * xz) + xz * (xy * yz - b * xz),
        }
    )
    half = F.try_divide(F.col("_det"), 2.0 * p * p * p)
    df = df.withColumn("_angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3.0)
    df = df.withColumns({"_least": mean + 2.0 * p * F.cos(F.col("_angle") + 2.0 * np.pi / 3.0), "_most": mean + 2.0 * p * F.cos("_angle")})
    least = F.col("_least")
    r = [(xx - least, xy, xz), (xy, yy - least, yz), (xz, yz, zz - least)]
    sides = {}
    for i, (u, v) in enumerate(((r[0], r[1]), (r[0], r[2]), (r[1], r[2]))):
        sides |= {f"_x{i}": u[1] * v[2] - u[2] * v[1], f"_y{i}": u[2] * v[0] - u[0] * v[2], f"_z{i}": u[0] * v[1] - u[1] * v[0]}
    df = df.withColumns(sides)
    square = lambda i: F.col(f"_x{i}") * F.col(f"_x{i}") + F.col(f"_y{i}") * F.col(f"_y{i}") + F.col(f"_z{i}") * F.col(f"_z{i}")
    df = df.withColumn("_best", F.greatest(*[F.struct(square(i).alias("n2"), F.abs(F.col(f"_z{i}")).alias("z")) for i in range(3)]))
    # equal least eigenvalues: the matrix less them is the square of the one direction with more spread
    upright = F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.try_divide(zz - least, xx + yy + zz - 3.0 * least)))
    middle = 3.0 * mean - least - F.col("_most")
    line = (middle - least <= 1e-9 * (F.col("_most") - least)) | (F.col("_best.n2") == 0)
    flat = F.least(F.lit(1.0), F.try_divide(F.col("_best.z"), F.sqrt("_best.n2")))
    df = df.withColumn("abs_nz", F.when((F.col("_scale") == 0) | (p <= 1e-14), 1.0).when(line, upright).otherwise(flat))
    return df.select(*columns, "abs_nz")


def normals(points: DataFrame, k: int = 15) -> DataFrame:
    """``abs_nz`` of the surface normal at every distinct position, from its k nearest."""
    sums = neighbours.nearest(_asking(points, k, True, True), True, "moments")
    mean = {a: F.col(f"s{a}") / F.col("take") for a in XYZ}
    cov = [(F.col(f"p{a}{b}") / F.col("take") - mean[a] * mean[b]).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return flat_normals(sums.select(*MISSION, *XYZ, *cov)).select(*MISSION, *XYZ, "abs_nz")


def classify_ground(
    points: DataFrame, min_nz: float = 0.70, cell_m: float = 1.0, height_m: float = 0.35
) -> DataFrame:
    """P5 given ``abs_nz``: adds ``ground_state`` (ground, semantic, vertical, elevated)."""
    df = points.withColumn(
        "_s", F.when(F.col("class_id").isin(*ELEVATED_CLASS_IDS), "semantic").when(F.col("abs_nz") < min_nz, "vertical")
    )
    cand = df.where(F.col("_s").isNull())
    corner = cand.groupBy(*MISSION).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    df = df.join(corner, MISSION, "left").withColumns(
        {
            "_cx": F.floor((F.col("x") - F.col("_x0")) / cell_m).cast("long"),
            "_cy": F.floor((F.col("y") - F.col("_y0")) / cell_m).cast("long"),
        }
    )
    floor = df.where(F.col("_s").isNull()).groupBy(*MISSION, "_cx", "_cy").agg(F.min("z").alias("_low"))
    out = df.join(floor, [*MISSION, "_cx", "_cy"], "left")
    state = F.coalesce("_s", F.when(F.col("z") <= F.col("_low") + height_m, "ground").otherwise("elevated"))
    return out.withColumn("ground_state", state).drop("_s", "_x0", "_y0", "_cx", "_cy", "_low")


def detect_ground(points: DataFrame, k: int = 15, **limits: float) -> DataFrame:
    """P5."""
    return classify_ground(points.join(normals(points, k), [*MISSION, *XYZ]), **limits)


def ground_counts(classified: DataFrame) -> DataFrame:
    s = F.col("ground_state")
    return classified.groupBy(*MISSION).agg(
        F.count_if(s == "ground").alias("n_ground_points"),
        F.count_if(s == "semantic").alias("n_rejected_semantic"),
        F.count_if(s == "vertical").alias("n_rejected_vertical"),
        F.count_if(s == "elevated").alias("n_rejected_elevated"),
    )


# --- clusters -----------------------------------------------------------------------------------


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node id reachable from each node.

    Every round, each node that has a smaller neighbour hangs itself under the smallest one, chains are
    shortened by pointer doubling, and the graph is contracted to the remaining roots. At most half of the
    connected nodes are left after a round.
    """
    comp = nodes.select("node", F.col("node").alias("root"))
    live = cut(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("p")))
        while True:
            hop = up.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            nxt = cut(up.join(hop, "p").select("node", "pp", (F.col("pp") != F.col("p")).alias("moved")))
            up = nxt.select("node", F.col("pp").alias("p"))
            if nxt.where("moved").isEmpty():
                break
        comp = cut(
            comp.join(up.select(F.col("node").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        )
        a = up.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        b = up.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        live = cut(
            live.join(a, "a").join(b, "b").where(F.col("pa") != F.col("pb"))
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
    return comp


def _box_gap2(a: str, b: str) -> Column:
    parts = [F.greatest(F.col(f"{a}lo_{c}") - F.col(f"{b}hi_{c}"), F.lit(0.0), F.col(f"{b}lo_{c}") - F.col(f"{a}hi_{c}")) for c in XYZ]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def _box_far2(a: str, b: str) -> Column:
    parts = [
        F.greatest(F.abs(F.col(f"{a}hi_{c}") - F.col(f"{b}lo_{c}")), F.abs(F.col(f"{b}hi_{c}") - F.col(f"{a}lo_{c}"))) for c in XYZ
    ]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def _touching_cells(cores: DataFrame, cells: DataFrame, side: float, eps: float, pair_cap: int = 4096) -> DataFrame:
    """Pairs of core cells (by node id) that hold two points within ``eps`` of each other.

    Boxes decide what they can. Open pairs with few points are compared point by point; open pairs with many are
    split into sub-boxes, again and again, so two crowded cells are never multiplied out.
    """
    e2 = eps * eps
    named = cells.select(*MISSION, *G, "node", "n", *BOX)
    sides = [named.withColumnsRenamed({"node": s, "n": f"n{s}"} | {c: f"{s}_{c}" for c in BOX}) for s in "ab"]
    front = _neighbour_cells(*sides, 2).drop(*MISSION, *G, "hx", "hy", "hz")
    front = front.where(_box_gap2("a_", "b_") <= e2).withColumn("sure", _box_far2("a_", "b_") <= e2)
    front = cut(front.withColumns({f"{s}{g}": F.lit(None).cast("long") for s in ("a_", "b_") for g in G}).withColumn("lv", F.lit(0)))
    pts = cut(cores.select("node", *XYZ))
    edges = front.where("sure").select("a", "b").distinct()
    level = 0
    small = []
    while True:
        open_ = front.join(edges, ["a", "b"], "left_anti")
        few = F.col("na") * F.col("nb") <= pair_cap
        small.append(open_.where(few).drop("sure", "lv"))
        big = open_.where(~few)
        if big.isEmpty() or level > 40:
            small.append(big.drop("sure", "lv"))
            break
        level += 1
        step = side / 2**level
        parts = _with_grid(pts, step).groupBy("node", *G).agg(F.count(F.lit(1)).alias("n"), *_boxes())

        def child(s: str) -> DataFrame:
            cols = [F.col(g).alias(f"{s}_{g}") for g in G] + [F.col(c).alias(f"{s}_{c}") for c in BOX] + [F.col("n").alias(f"n{s}")]
            ups = [F.floor(F.col(g) / 2).cast("long").alias(f"{s}_up_{g}") for g in G]
            return parts.select(F.col("node").alias(s), *ups, *cols)

        frontier = big.select("a", "b", *[F.col(f"{s}_{g}").alias(f"{s}_up_{g}") for s in "ab" for g in G])
        for s in "ab":
            keys = [s, *[f"{s}_up_{g}" for g in G]]
            if level == 1:
                frontier = frontier.drop(*keys[1:]).join(shuffled(child(s).drop(*keys[1:])), s)
            else:
                frontier = frontier.join(shuffled(child(s)), keys).drop(*keys[1:])
        frontier = frontier.where(_box_gap2("a_", "b_") <= e2).withColumn("sure", _box_far2("a_", "b_") <= e2)
        front = cut(frontier.withColumn("lv", F.lit(level)))
        edges = cut(edges.unionByName(front.where("sure").select("a", "b")).distinct())
    tests = small[0]
    for more in small[1:]:
        tests = tests.unionByName(more, allowMissingColumns=True)
    tests = tests.join(edges, ["a", "b"], "left_anti").select("a", "b", *[f"{s}_{c}" for s in "ab" for c in BOX])
    left = pts.select(F.col("node").alias("a"), *XYZ)
    near_a = tests.join(shuffled(left), "a").where((_gap2("b_") <= e2) & (_gap2("a_") <= 0)).select("a", "b", *XYZ, *[f"b_{c}" for c in BOX])
    right = pts.select(F.col("node").alias("b"), *[F.col(c).alias(f"o_{c}") for c in XYZ])
    met = near_a.join(shuffled(right), "b").where(_dist2("", "o_") <= e2).select("a", "b")
    return edges.unionByName(met).distinct()


def dbscan(points: DataFrame, eps: float = 3.0, min_points: int = 20) -> DataFrame:
    """Adds ``cluster_id`` (0-based per mission by smallest core point id, -1 for noise).

    A point is core with at least ``min_points`` points within ``eps``, itself included. Core points of one
    half-radius cell always belong together, so the cluster graph has cells as nodes, not points. A border point
    joins the lowest adjacent cluster.
    """
    side = eps / 2.0 * (1.0 + 1e-9)
    locs = cut(within_radius(locations(points), eps, min_points))
    cores = locs.where("dense")
    cells = cut(cores.groupBy(*MISSION, *G).agg(F.min("loc_id").alias("node"), F.count(F.lit(1)).alias("n"), *_boxes()))
    cores = cores.join(cells.select(*MISSION, *G, "node"), [*MISSION, *G])
    comp = connected_components(cells.select("node"), _touching_cells(cores, cells, side, eps))
    rooted = cut(cells.join(comp, "node").select(*MISSION, *G, "root"))
    labelled = locs.where("dense").join(rooted, [*MISSION, *G])
    core_labels = labelled.select(*MISSION, "loc_id", "root")
    # a border point lies in a cell of fewer than min_points, so borders per cell are few
    rim_labels = reached(locs.where(~F.col("dense")), labelled, eps, ["root"], F.min)
    ranks = rooted.select(*MISSION, "root").distinct().withColumn(
        "cluster_id", F.row_number().over(Window.partitionBy(*MISSION).orderBy("root")) - 1
    )
    labels = core_labels.unionByName(rim_labels).join(ranks, [*MISSION, "root"]).drop("root")
    labels = locs.select(*MISSION, *XYZ, "loc_id").join(shuffled(labels), [*MISSION, "loc_id"]).drop("loc_id")
    return points.join(shuffled(labels), [*MISSION, *XYZ], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))


def building_clusters(points: DataFrame, eps: float = 3.0, min_points: int = 20) -> DataFrame:
    """P6 over Building points; missions with fewer than ``min_points`` of them yield nothing."""
    bldg = points.where(F.col("class_id") == BUILDING_ID)
    enough = bldg.groupBy(*MISSION).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
    return dbscan(bldg.join(enough.select(*MISSION), MISSION, "left_semi"), eps, min_points)


# --- instances ----------------------------------------------------------------------------------

CLUSTER = ["mission_id", "cluster_id"]


def _hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of distinct points, counter-clockwise."""
    p = xy[np.lexsort((xy[:, 1], xy[:, 0]))]
    if len(p) < 3:
        return p
    chains = []
    for seq in (p, p[::-1]):
        chain: list[np.ndarray] = []
        for q in seq:
            while len(chain) > 1:
                u, v = chain[-1] - chain[-2], q - chain[-2]
                if u[0] * v[1] - u[1] * v[0] > 0:
                    break
                chain.pop()
            chain.append(q)
        chains.append(chain[:-1])
    return np.array(chains[0] + chains[1])


def _polygon_area(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x - x[0], y - y[0]
    return 0.5 * abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))))


def _hull_area(pdf: pd.DataFrame) -> pd.DataFrame:
    corners = _hull(pdf[["x", "y"]].to_numpy(dtype=float))
    return pdf[CLUSTER].head(1).assign(hull_area=_polygon_area(corners[:, 0], corners[:, 1]))


#: A cap of a cluster: what lies to the right of the way from one corner of its hull to a later one.
CAP = [*CLUSTER, "ax", "ay", "bx", "by"]


def _cap_area(pdf: pd.DataFrame) -> pd.DataFrame:
    ends = pdf[["ax", "ay", "bx", "by"]].to_numpy(dtype=float)[0].reshape(2, 2)
    corners = _hull(np.unique(np.vstack([ends, pdf[["x", "y"]].to_numpy(dtype=float)]), axis=0))
    return pdf[CLUSTER].head(1).assign(hull_area=_polygon_area(corners[:, 0], corners[:, 1]))


def _side(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Twice the area of the triangle from ``a`` over ``b`` to the row's position; negative to the right of the way."""
    return (b[0] - a[0]) * (F.col("y") - a[1]) - (b[1] - a[1]) * (F.col("x") - a[0])


def _into_caps(df: DataFrame, corners: list[tuple[Column, Column]]) -> DataFrame:
    """Positions outside the corners' way, each with the ends of the one step that it lies beyond; others are left out."""
    steps = list(zip(corners, corners[1:]))
    cap = F.coalesce(*[F.when(_side(a, b) < 0, F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by"))) for a, b in steps])
    return df.select(*CLUSTER, "x", "y", cap.alias("_cap")).where(F.col("_cap").isNotNull()).select(*CLUSTER, "_cap.*", "x", "y")


def footprint_area(points: DataFrame, group_rows: int = 50_000) -> DataFrame:
    """Area of the convex hull in plan; fewer than three distinct positions give 1.0, collinear ones their
    bounding box with sides of at least 0.5 m.

    A cluster of at most ``group_rows`` distinct positions is one task's work. Of a larger one the extremes in eight directions
    are corners of the hull: what lies inside them is left out, and the rest falls into the caps beyond their sides, whose
    hulls do not touch each other. A cap with too many positions is split at its farthest one, which is a corner too, until
    all caps are small. Areas of the inner polygon, of the triangles of the splits and of the small caps add up, so no task
    ever holds a whole cluster, however round it is.
    """
    pos = cut(points.groupBy(*CLUSTER, "x", "y").agg(F.count(F.lit(1)).alias("_c")).drop("_c"))
    x, y = F.col("x"), F.col("y")
    around = [x, x + y, y, y - x, -x, -x - y, -y, x - y]  # counter-clockwise
    stats = cut(
        pos.groupBy(*CLUSTER).agg(
            F.count(F.lit(1)).alias("_n"),
            (F.round(F.max("x"), 3) - F.round(F.min("x"), 3)).alias("_w"),
            (F.round(F.max("y"), 3) - F.round(F.min("y"), 3)).alias("_h"),
            *[F.max_by(F.struct("x", "y"), F.struct(d, x, y)).alias(f"_e{i}") for i, d in enumerate(around)],
        )
    )
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = f"mission_id {kinds['mission_id']}, cluster_id {kinds['cluster_id']}, hull_area double"
    few = stats.where(F.col("_n") <= group_rows).select(*CLUSTER)
    area = pos.join(few, CLUSTER, "left_semi").groupBy(*CLUSTER).applyInPandas(_hull_area, schema)

    large = stats.where(F.col("_n") > group_rows)
    corners = [(F.col(f"_e{i}.x"), F.col(f"_e{i}.y")) for i in (*range(8), 0)]
    start = corners[0]
    fan = [(a[0] - start[0]) * (b[1] - start[1]) - (a[1] - start[1]) * (b[0] - start[0]) for a, b in zip(corners[1:7], corners[2:8])]
    area = area.unionByName(large.select(*CLUSTER, (sum(fan) / 2).alias("hull_area")))
    rows = cut(_into_caps(pos.join(large, CLUSTER), corners))
    a, b, far = (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")), (F.col("_far.x"), F.col("_far.y"))
    while True:
        out = -_side(a, b)
        caps = cut(rows.groupBy(*CAP).agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(out.alias("out"), "x", "y")).alias("_far")))
        split = caps.where(F.col("_n") > group_rows)
        if split.isEmpty():
            break
        area = area.unionByName(split.select(*CLUSTER, (F.col("_far.out") / 2).alias("hull_area")))
        rest = rows.join(split.select(*CAP), CAP, "left_anti")
        rows = cut(rest.unionByName(_into_caps(rows.join(split, CAP), [a, far, b])))
    area = area.unionByName(rows.groupBy(*CAP).applyInPandas(_cap_area, schema))
    area = area.groupBy(*CLUSTER).agg(F.sum("hull_area").alias("hull_area"))
    flat = F.greatest(F.lit(0.5), F.col("_w")) * F.greatest(F.lit(0.5), F.col("_h"))
    return stats.join(area, CLUSTER).select(
        *CLUSTER,
        F.when(F.col("_n") < 3, F.lit(1.0)).when(F.col("hull_area") <= 1e-12, flat).otherwise(F.col("hull_area")).alias("footprint_area_m2"),
    )


def instance_metrics(
    points: DataFrame, footprints: DataFrame, min_points: int = 20, digits: tuple[int, int] = (3, 2)
) -> DataFrame:
    """One row per cluster of at least ``min_points``; confidence is the mean of the tier scores."""
    fine, coarse = digits
    pts = points.where(F.col("cluster_id") >= 0)
    ranks = exact_percentiles(pts, CLUSTER, "z", {"_p5": 0.05, "_p50": 0.5, "_p95": 0.95})
    upper = (
        pts.join(ranks.select(*CLUSTER, "_p50"), CLUSTER)
        .groupBy(*CLUSTER)
        .agg(
            F.count(F.lit(1)).alias("point_count"),
            *[F.bround(F.avg(c), fine).alias(f"centroid_{c}") for c in XYZ],
            *[F.bround(F.min(c), fine).alias(f"min_{c}") for c in XYZ],
            *[F.bround(F.max(c), fine).alias(f"max_{c}") for c in XYZ],
            F.max("z").alias("_zmax"),
            F.avg(F.when(F.col("z") >= F.col("_p50"), F.col("z"))).alias("_roof"),
            F.bround(F.avg("confidence"), fine).alias("mean_confidence"),
        )
        .where(F.col("point_count") >= min_points)
    )
    df = upper.join(ranks, CLUSTER).join(footprints, CLUSTER)

    def rise(top: str) -> Column:
        return F.greatest(F.lit(0.1), F.col(top) - F.col("_p5"))

    return df.select(
        *CLUSTER,
        (F.col("cluster_id") + 1).alias("instance_id"),
        "point_count",
        *[f"centroid_{c}" for c in XYZ],
        *[f"min_{c}" for c in XYZ],
        *[f"max_{c}" for c in XYZ],
        F.bround("footprint_area_m2", coarse).alias("footprint_area_m2"),
        F.bround("_p5", coarse).alias("base_elevation_m"),
        F.bround("_p95", coarse).alias("peak_elevation_m"),
        F.bround(rise("_p95"), coarse).alias("height_m"),
        F.bround(rise("_zmax"), coarse).alias("max_height_m"),
        F.bround(rise("_roof"), coarse).alias("mean_height_m"),
        F.bround(F.col("footprint_area_m2") * rise("_roof"), coarse).alias("volume_m3"),
        "mean_confidence",
    )


def nearest_point(points: DataFrame, x: float, y: float, z: float, classes: list[int]) -> DataFrame:
    """Per mission, the point of a visible class closest to a query position (smallest id on ties)."""
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) + (F.col("z") - z) * (F.col("z") - z)
    best = points.where(F.col("class_id").isin(*classes)).groupBy(*MISSION).agg(F.min(F.struct(d2.alias("d2"), "point_id")).alias("_b"))
    return best.select(*MISSION, F.col("_b.point_id").alias("point_id"), F.sqrt("_b.d2").alias("distance_m"))
