"""Rigid, similarity and pinhole geometry on flat matrix columns (``r00`` .. ``r22``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

R_NAMES = tuple(f"r{i}{j}" for i in range(3) for j in range(3))
SINGLE_FOCAL = ("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "SIMPLE_RADIAL_FISHEYE")
TWO_FOCAL = ("PINHOLE", "OPENCV", "FULL_OPENCV", "RADIAL")

Vec = Sequence[Column]


def cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def rot(prefix: str = "") -> list[list[Column]]:
    return [[F.col(f"{prefix}r{i}{j}") for j in range(3)] for i in range(3)]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def matvec(m: list[list[Column]], v: Vec) -> list[Column]:
    return [dot(row, v) for row in m]


def matvec_t(m: list[list[Column]], v: Vec) -> list[Column]:
    return [m[0][j] * v[0] + m[1][j] * v[1] + m[2][j] * v[2] for j in range(3)]


def matmul_t(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    """a times b transposed."""
    return [[dot(a[i], b[j]) for j in range(3)] for i in range(3)]


def norm3(v: Vec) -> Column:
    return F.sqrt(dot(v, v))


def camera_center(m: list[list[Column]], t: Vec) -> list[Column]:
    return [-c for c in matvec_t(m, t)]


def apply_similarity(s: Column, m: list[list[Column]], t: Vec, v: Vec) -> list[Column]:
    return [s * c + t[i] for i, c in enumerate(matvec(m, v))]


def invert_similarity(df: DataFrame, s: str = "s", t: Sequence[str] = ("t0", "t1", "t2")) -> DataFrame:
    """One transform per row -> the row of its inverse, same column names."""
    back = matvec_t(rot(), cols(*t))
    inv = {f"_i{n}": F.col(f"r{n[2]}{n[1]}") for n in R_NAMES}
    df = df.withColumns(
        {**inv, "_is": F.lit(1.0) / F.col(s), **{f"_it{i}": -back[i] / F.col(s) for i in range(3)}}
    )
    return df.withColumns(
        {
            **{n: F.col(f"_i{n}") for n in R_NAMES},
            s: F.col("_is"),
            **{t[i]: F.col(f"_it{i}") for i in range(3)},
        }
    ).drop(*[f"_i{n}" for n in R_NAMES], "_is", "_it0", "_it1", "_it2")


def project(df: DataFrame, point: Sequence[str], min_z: float, out: tuple[str, str, str] = ("pu", "pv", "pz")) -> DataFrame:
    """World point through the pose on the same row (``p = R x + t``); NULL pixel at or behind ``min_z``."""
    p = matvec(rot(), cols(*point))
    t = cols("tx", "ty", "tz")
    df = df.withColumns({f"_c{i}": p[i] + t[i] for i in range(3)})
    ahead = F.col("_c2") > F.lit(min_z)
    return df.withColumns(
        {
            out[0]: F.when(ahead, F.col("fx") * F.col("_c0") / F.col("_c2") + F.col("cx")),
            out[1]: F.when(ahead, F.col("fy") * F.col("_c1") / F.col("_c2") + F.col("cy")),
            out[2]: F.col("_c2"),
        }
    ).drop("_c0", "_c1", "_c2")


def unproject(df: DataFrame, u: str, v: str, depth: str, out: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Pixel and depth -> world point: R' (K^-1 [u v 1] d - t)."""
    d = F.col(depth)
    df = df.withColumns(
        {
            "_q0": (F.col(u) - F.col("cx")) / F.col("fx") * d - F.col("tx"),
            "_q1": (F.col(v) - F.col("cy")) / F.col("fy") * d - F.col("ty"),
            "_q2": d - F.col("tz"),
        }
    )
    w = matvec_t(rot(), cols("_q0", "_q1", "_q2"))
    return df.withColumns({out[i]: w[i] for i in range(3)}).drop("_q0", "_q1", "_q2")


def quaternion_rotation(df: DataFrame, q: Sequence[str] = ("qw", "qx", "qy", "qz"), prefix: str = "") -> DataFrame:
    """Unit-normalised quaternion -> rotation columns."""
    n = F.sqrt(sum((F.col(c) * F.col(c) for c in q[1:]), F.col(q[0]) * F.col(q[0])))
    df = df.withColumn("_qn", n)
    df = df.withColumns({f"_u{i}": F.col(c) / F.col("_qn") for i, c in enumerate(q)})
    w, x, y, z = cols("_u0", "_u1", "_u2", "_u3")
    m = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]
    return df.withColumns({f"{prefix}r{i}{j}": m[i][j] for i in range(3) for j in range(3)}).drop(
        "_qn", "_u0", "_u1", "_u2", "_u3"
    )


def euler_rotation(df: DataFrame, roll: str, pitch: str, yaw: str, prefix: str = "") -> DataFrame:
    """Body-to-world rotation, yaw about z after pitch about y after roll about x."""
    df = df.withColumns(
        {
            f"_{f}{a}": fn(F.col(c))
            for a, c in (("r", roll), ("p", pitch), ("y", yaw))
            for f, fn in (("c", F.cos), ("s", F.sin))
        }
    )
    cr, sr, cp, sp, cy, sy = cols("_cr", "_sr", "_cp", "_sp", "_cy", "_sy")
    m = [
        [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr],
        [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
        [-sp, cp * sr, cp * cr],
    ]
    return df.withColumns({f"{prefix}r{i}{j}": m[i][j] for i in range(3) for j in range(3)}).drop(
        "_cr", "_sr", "_cp", "_sp", "_cy", "_sy"
    )


def intrinsics(df: DataFrame, model: str = "model", params: str = "params") -> DataFrame:
    """Focal lengths and principal point from a camera model name and its parameter array."""

    def p(i: int) -> Column:
        return F.get(F.col(params), F.lit(i))

    m = F.col(model)
    single, double = m.isin(*SINGLE_FOCAL), m.isin(*TWO_FOCAL)
    return df.withColumns(
        {
            "fx": p(0),
            "fy": F.when(double, p(1)).otherwise(p(0)),
            "cx": F.when(single, p(1)).when(double, p(2)).otherwise(F.coalesce(p(1), F.lit(0.0))),
            "cy": F.when(single, p(2)).when(double, p(3)).otherwise(F.coalesce(p(2), F.lit(0.0))),
        }
    )


def aligned_pose(df: DataFrame, tf_prefix: str = "tf_") -> DataFrame:
    """Pose columns plus transform columns on one row -> pose in the aligned frame and its centre ``c0..c2``."""
    c = camera_center(rot(), cols("tx", "ty", "tz"))
    df = df.withColumns({f"_cc{i}": c[i] for i in range(3)})
    tf_t = cols(*[f"{tf_prefix}t{i}" for i in range(3)])
    center = apply_similarity(F.col(f"{tf_prefix}s"), rot(tf_prefix), tf_t, cols("_cc0", "_cc1", "_cc2"))
    turned = matmul_t(rot(), rot(tf_prefix))
    df = df.withColumns(
        {**{f"c{i}": center[i] for i in range(3)}, **{f"_a{i}{j}": turned[i][j] for i in range(3) for j in range(3)}}
    )
    a = [[F.col(f"_a{i}{j}") for j in range(3)] for i in range(3)]
    t = matvec(a, cols("c0", "c1", "c2"))
    df = df.withColumns({"_n0": -t[0], "_n1": -t[1], "_n2": -t[2]})
    return df.withColumns(
        {
            **{f"r{i}{j}": F.col(f"_a{i}{j}") for i in range(3) for j in range(3)},
            "tx": F.col("_n0"), "ty": F.col("_n1"), "tz": F.col("_n2"),
        }
    ).drop(*[f"_a{i}{j}" for i in range(3) for j in range(3)], *[f"_cc{i}" for i in range(3)], "_n0", "_n1", "_n2")
