"""WGS84, local East-North-Up and UTM as column expressions.

Long formulas are laid down as successive ``withColumns`` steps so that no sub-expression is copied
into the plan twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: WGS84 ellipsoid and UTM grid -------------------------------------------------
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0
# --- end of fixed values ------------------------------------------------------------------------

E2 = WGS84_F * (2.0 - WGS84_F)
WGS84_B = WGS84_A * (1.0 - WGS84_F)
EP2 = E2 / (1.0 - E2)
_N = WGS84_F / (2.0 - WGS84_F)


def _poly(*terms: tuple[float, int]) -> float:
    return sum(c * _N**p for c, p in terms)


# Krueger series in the third flattening, to sixth order.
RECTIFYING_RADIUS = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
ALPHA = (
    _poly((1 / 2, 1), (-2 / 3, 2), (5 / 16, 3), (41 / 180, 4), (-127 / 288, 5), (7891 / 37800, 6)),
    _poly((13 / 48, 2), (-3 / 5, 3), (557 / 1440, 4), (281 / 630, 5), (-1983433 / 1935360, 6)),
    _poly((61 / 240, 3), (-103 / 140, 4), (15061 / 26880, 5), (167603 / 181440, 6)),
    _poly((49561 / 161280, 4), (-179 / 168, 5), (6601661 / 7257600, 6)),
    _poly((34729 / 80640, 5), (-3418889 / 1995840, 6)),
    _poly((212378941 / 319334400, 6)),
)
BETA = (
    _poly((1 / 2, 1), (-2 / 3, 2), (37 / 96, 3), (-1 / 360, 4), (-81 / 512, 5), (96199 / 604800, 6)),
    _poly((1 / 48, 2), (1 / 15, 3), (-437 / 1440, 4), (46 / 105, 5), (-1118711 / 3870720, 6)),
    _poly((17 / 480, 3), (-37 / 840, 4), (-209 / 4480, 5), (5569 / 90720, 6)),
    _poly((4397 / 161280, 4), (-11 / 504, 5), (-830251 / 7257600, 6)),
    _poly((4583 / 161280, 5), (-108847 / 3991680, 6)),
    _poly((20648693 / 638668800, 6)),
)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def with_ecef(df: DataFrame, lat: str, lon: str, alt: str, prefix: str = "ecef_") -> DataFrame:
    """Adds ``<prefix>x, <prefix>y, <prefix>z`` in metres."""
    p = f"_{prefix}"
    df = df.withColumns({f"{p}phi": F.radians(lat), f"{p}lam": F.radians(lon)})
    df = df.withColumns(
        {f"{p}n": F.lit(WGS84_A) / F.sqrt(F.lit(1.0) - F.lit(E2) * F.pow(F.sin(f"{p}phi"), F.lit(2.0)))}
    )
    n, phi, lam, h = F.col(f"{p}n"), F.col(f"{p}phi"), F.col(f"{p}lam"), _c(alt)
    return df.withColumns(
        {
            f"{prefix}x": (n + h) * F.cos(phi) * F.cos(lam),
            f"{prefix}y": (n + h) * F.cos(phi) * F.sin(lam),
            f"{prefix}z": (n * F.lit(1.0 - E2) + h) * F.sin(phi),
        }
    ).drop(f"{p}phi", f"{p}lam", f"{p}n")


def enu_basis(lat: Column, lon: Column) -> dict[str, Column]:
    """Rows of the ECEF -> East-North-Up rotation at an origin."""
    sp, cp, sl, cl = F.sin(F.radians(lat)), F.cos(F.radians(lat)), F.sin(F.radians(lon)), F.cos(F.radians(lon))
    return {
        "b00": -sl, "b01": cl, "b02": F.lit(0.0),
        "b10": -sp * cl, "b11": -sp * sl, "b12": cp,
        "b20": cp * cl, "b21": cp * sl, "b22": sp,
    }


def with_enu(
    df: DataFrame,
    lat: str = "lat",
    lon: str = "lon",
    alt: str = "alt_m",
    origin: tuple[str, str, str] = ("origin_lat", "origin_lon", "origin_alt"),
    out: tuple[str, str, str] = ("e", "n", "u"),
) -> DataFrame:
    """WGS84 -> ENU metres relative to the origin columns of the same row."""
    df = with_ecef(df, lat, lon, alt, "_p_")
    df = with_ecef(df, *origin, "_o_")
    df = df.withColumns({f"_{k}": v for k, v in enu_basis(F.col(origin[0]), F.col(origin[1])).items()})
    df = df.withColumns({f"_d{a}": F.col(f"_p_{a}") - F.col(f"_o_{a}") for a in "xyz"})
    d = [F.col("_dx"), F.col("_dy"), F.col("_dz")]
    rows = {out[i]: sum((F.col(f"_b{i}{j}") * d[j] for j in range(1, 3)), F.col(f"_b{i}0") * d[0]) for i in range(3)}
    temp = [f"_{o}_{a}" for o in "po" for a in "xyz"] + [f"_b{i}{j}" for i in range(3) for j in range(3)]
    return df.withColumns(rows).drop(*temp, "_dx", "_dy", "_dz")


def with_geodetic(df: DataFrame, x: str, y: str, z: str, out: tuple[str, str, str], rounds: int = 4) -> DataFrame:
    """ECEF -> latitude, longitude (degrees), height; a fixed number of Bowring steps on the reduced latitude."""
    df = df.withColumns(
        {
            "_g_p": F.hypot(F.col(x), F.col(y)),
            out[1]: F.degrees(F.atan2(F.col(y), F.col(x))),
        }
    )
    df = df.withColumn("_g_th", F.atan2(F.col(z) * F.lit(WGS84_A), F.col("_g_p") * F.lit(WGS84_B)))
    for _ in range(rounds):
        df = df.withColumns({"_g_s": F.sin("_g_th"), "_g_c": F.cos("_g_th")})
        df = df.withColumn(
            "_g_lat",
            F.atan2(
                F.col(z) + F.lit(EP2 * WGS84_B) * F.pow(F.col("_g_s"), F.lit(3.0)),
                F.col("_g_p") - F.lit(E2 * WGS84_A) * F.pow(F.col("_g_c"), F.lit(3.0)),
            ),
        )
        df = df.withColumn(
            "_g_th", F.atan2(F.lit(1.0 - WGS84_F) * F.sin("_g_lat"), F.cos("_g_lat"))
        )
    df = df.withColumns({"_g_s": F.sin("_g_lat"), "_g_c": F.cos("_g_lat")})
    height = F.col("_g_p") * F.col("_g_c") + F.col(z) * F.col("_g_s") - F.lit(WGS84_A) * F.sqrt(
        F.lit(1.0) - F.lit(E2) * F.col("_g_s") * F.col("_g_s")
    )
    return df.withColumns({out[0]: F.degrees("_g_lat"), out[2]: height}).drop(
        "_g_p", "_g_th", "_g_s", "_g_c", "_g_lat"
    )


def with_wgs84_from_enu(
    df: DataFrame,
    enu: tuple[str, str, str] = ("e", "n", "u"),
    origin: tuple[str, str, str] = ("origin_lat", "origin_lon", "origin_alt"),
    out: tuple[str, str, str] = ("lat", "lon", "alt_m"),
) -> DataFrame:
    df = with_ecef(df, *origin, "_o_")
    df = df.withColumns({f"_{k}": v for k, v in enu_basis(F.col(origin[0]), F.col(origin[1])).items()})
    axes = "xyz"
    df = df.withColumns(
        {
            f"_w_{axes[j]}": F.col(f"_o_{axes[j]}")
            + F.col(f"_b0{j}") * F.col(enu[0])
            + F.col(f"_b1{j}") * F.col(enu[1])
            + F.col(f"_b2{j}") * F.col(enu[2])
            for j in range(3)
        }
    )
    df = with_geodetic(df, "_w_x", "_w_y", "_w_z", out)
    temp = [f"_{o}_{a}" for o in "ow" for a in axes] + [f"_b{i}{j}" for i in range(3) for j in range(3)]
    return df.drop(*temp)


def utm_zone(lon: Column) -> Column:
    """Zone number, held to 1..60 (lon = 180 would otherwise give a zone that does not exist)."""
    return F.least(F.lit(60), F.greatest(F.lit(1), (F.floor((lon + 180.0) / 6.0) + 1).cast("int")))


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


def with_utm(
    df: DataFrame, lat: str, lon: str, epsg: str = "epsg", out: tuple[str, str] = ("utm_x", "utm_y")
) -> DataFrame:
    """WGS84 -> UTM easting/northing in the zone named by the ``epsg`` column."""
    ecc = math.sqrt(E2)
    df = df.withColumns(
        {
            "_t_phi": F.radians(lat),
            "_t_lam": F.radians(F.col(lon) - ((F.col(epsg) % 100) * 6.0 - 183.0)),
        }
    )
    df = df.withColumn("_t_s", F.sin("_t_phi"))
    df = df.withColumn("_t_t", F.sinh(F.atanh("_t_s") - F.lit(ecc) * F.atanh(F.lit(ecc) * F.col("_t_s"))))
    df = df.withColumns(
        {
            "_t_xi": F.atan2(F.col("_t_t"), F.cos("_t_lam")),
            "_t_eta": F.atanh(F.sin("_t_lam") / F.sqrt(F.lit(1.0) + F.col("_t_t") * F.col("_t_t"))),
        }
    )
    x, y = F.col("_t_eta"), F.col("_t_xi")
    for j, a in enumerate(ALPHA, start=1):
        x = x + F.lit(a) * F.cos(F.col("_t_xi") * (2.0 * j)) * F.sinh(F.col("_t_eta") * (2.0 * j))
        y = y + F.lit(a) * F.sin(F.col("_t_xi") * (2.0 * j)) * F.cosh(F.col("_t_eta") * (2.0 * j))
    south = F.when(F.floor(F.col(epsg) / 100) == 327, F.lit(UTM_FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))
    return df.withColumns(
        {
            out[0]: F.lit(UTM_FALSE_EASTING) + F.lit(UTM_K0 * RECTIFYING_RADIUS) * x,
            out[1]: south + F.lit(UTM_K0 * RECTIFYING_RADIUS) * y,
        }
    ).drop("_t_phi", "_t_lam", "_t_s", "_t_t", "_t_xi", "_t_eta")


def with_wgs84_from_utm(
    df: DataFrame, x: str, y: str, epsg: str = "epsg", out: tuple[str, str] = ("lat", "lon"), rounds: int = 4
) -> DataFrame:
    """UTM -> WGS84; the conformal latitude is unwound by a fixed number of Newton steps."""
    ecc = math.sqrt(E2)
    south = F.when(F.floor(F.col(epsg) / 100) == 327, F.lit(UTM_FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))
    scale = UTM_K0 * RECTIFYING_RADIUS
    df = df.withColumns(
        {
            "_t_xi": (F.col(y) - south) / F.lit(scale),
            "_t_eta": (F.col(x) - F.lit(UTM_FALSE_EASTING)) / F.lit(scale),
        }
    )
    xi, eta = F.col("_t_xi"), F.col("_t_eta")
    for j, b in enumerate(BETA, start=1):
        xi = xi - F.lit(b) * F.sin(F.col("_t_xi") * (2.0 * j)) * F.cosh(F.col("_t_eta") * (2.0 * j))
        eta = eta - F.lit(b) * F.cos(F.col("_t_xi") * (2.0 * j)) * F.sinh(F.col("_t_eta") * (2.0 * j))
    df = df.withColumns({"_t_x1": xi, "_t_e1": eta})
    df = df.withColumns(
        {
            "_t_tp": F.sin("_t_x1")
            / F.sqrt(F.pow(F.sinh("_t_e1"), F.lit(2.0)) + F.pow(F.cos("_t_x1"), F.lit(2.0))),
            "_t_lam": F.atan2(F.sinh("_t_e1"), F.cos("_t_x1")),
        }
    )
    df = df.withColumn("_t_tau", F.col("_t_tp"))
    for _ in range(rounds):
        tau = F.col("_t_tau")
        df = df.withColumn("_t_r", F.sqrt(F.lit(1.0) + tau * tau))
        df = df.withColumn("_t_sg", F.sinh(F.lit(ecc) * F.atanh(F.lit(ecc) * tau / F.col("_t_r"))))
        df = df.withColumn(
            "_t_ti",
            tau * F.sqrt(F.lit(1.0) + F.col("_t_sg") * F.col("_t_sg")) - F.col("_t_sg") * F.col("_t_r"),
        )
        df = df.withColumn(
            "_t_tau",
            tau
            + (F.col("_t_tp") - F.col("_t_ti"))
            / F.sqrt(F.lit(1.0) + F.col("_t_ti") * F.col("_t_ti"))
            * (F.lit(1.0) + F.lit(1.0 - E2) * tau * tau)
            / (F.lit(1.0 - E2) * F.col("_t_r")),
        )
    df = df.withColumns(
        {
            out[0]: F.degrees(F.atan("_t_tau")),
            out[1]: F.degrees("_t_lam") + ((F.col(epsg) % 100) * 6.0 - 183.0),
        }
    )
    return df.drop(*[f"_t_{k}" for k in ("xi", "eta", "x1", "e1", "tp", "lam", "tau", "r", "sg", "ti")])


def with_utm_from_enu(
    df: DataFrame,
    enu: tuple[str, str, str] = ("e", "n", "u"),
    origin: tuple[str, str, str] = ("origin_lat", "origin_lon", "origin_alt"),
    out: tuple[str, str, str] = ("utm_x", "utm_y", "utm_z"),
) -> DataFrame:
    """ENU -> UTM easting, northing and height, all in the one zone of the origin, named by the new column ``epsg``.

    A session that crosses a zone border keeps one continuous plane.
    """
    df = with_wgs84_from_enu(df, enu, origin, ("_u_lat", "_u_lon", out[2]))
    df = df.withColumn("epsg", utm_epsg(F.col(origin[1]), F.col(origin[0])))
    return with_utm(df, "_u_lat", "_u_lon", "epsg", out[:2]).drop("_u_lat", "_u_lon")
