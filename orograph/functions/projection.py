"""Map projections as Column expressions: transverse Mercator by its series in both directions, and web Mercator, chosen by a code in a column.

Steps are columns of their own, so that no expression is written out many times over.
"""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ellipsoid's half axis and flattening, the scale and the offsets of the zones.
HALF_AXIS_M, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST_M, SOUTH_M = 0.9996, 500000.0, 10000000.0
DEGREES, WEB, NORTH, SOUTH = 4326, 3857, 32600, 32700

_N = FLATTENING / (2 - FLATTENING)
_E = sqrt(FLATTENING * (2 - FLATTENING))
_A = HALF_AXIS_M / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krueger's series in the third flattening to its fourth power: to the plane, from it, and from conformal to geographic latitude.
_TO = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
_FROM = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]
_LATITUDE = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
]
_STEPS = ["_code", "_lam", "_t", "_xi", "_eta", "_chi"]


def is_zone(code: Column) -> Column:
    return code.between(NORTH + 1, NORTH + 60) | code.between(SOUTH + 1, SOUTH + 60)


def zone_of(lon: Column, lat: Column) -> Column:
    """The code of the transverse Mercator zone of six degrees that a place is in, by longitude alone."""
    return (F.pmod(F.floor((lon + 180.0) / 6.0), F.lit(60)) + 1 + F.when(lat >= 0, NORTH).otherwise(SOUTH)).cast("int")


def _middle(code: Column) -> Column:
    return F.radians((code % 100) * 6.0 - 183.0)


def _series(factors: list[float], xi: Column, eta: Column, first: str) -> Column:
    a, b = (F.sin, F.cosh) if first == "sin" else (F.cos, F.sinh)
    return sum((f * a(xi * (2.0 * j)) * b(eta * (2.0 * j)) for j, f in enumerate(factors, 1)), F.lit(0.0))


def to_plane(df: DataFrame, code: int | Column, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with x and y of (lon, lat) in the plane that ``code`` names: 326zz and 327zz (zones, north and south), 3857, or degrees as they are.

    Null for other codes, for places that aren't finite, and for the poles in web Mercator. Zones hold for places within some 30 degrees of their meridian.
    """
    d = df.withColumn("_code", code if isinstance(code, Column) else F.lit(code))
    s = F.sin(F.radians(lat))
    d = d.withColumns({"_lam": F.radians(lon) - _middle(F.col("_code")), "_t": F.sinh(F.atanh(s) - _E * F.atanh(_E * s))})
    d = d.withColumns({"_xi": F.atan2(F.col("_t"), F.cos("_lam")), "_eta": F.asinh(F.sin("_lam") / F.sqrt(F.col("_t") * F.col("_t") + F.cos("_lam") * F.cos("_lam")))})
    east = EAST_M + SCALE * _A * (F.col("_eta") + _series(_TO, F.col("_xi"), F.col("_eta"), "cos"))
    north = SCALE * _A * (F.col("_xi") + _series(_TO, F.col("_xi"), F.col("_eta"), "sin")) + F.when(F.col("_code") > SOUTH, SOUTH_M).otherwise(0.0)
    web = HALF_AXIS_M * F.asinh(F.tan(F.radians(lat)))
    c = F.col("_code")
    px = F.when(is_zone(c), east).when(c == WEB, HALF_AXIS_M * F.radians(lon)).when(c == DEGREES, F.col(lon))
    py = F.when(is_zone(c), north).when((c == WEB) & (F.abs(F.col(lat)) < 90), web).when(c == DEGREES, F.col(lat))
    return _kept(d, px, py, x, y)


def to_degrees(df: DataFrame, code: int | Column, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``df`` with the place (lon, lat) of x and y in the plane that ``code`` names, as ``to_plane`` has it."""
    d = df.withColumn("_code", code if isinstance(code, Column) else F.lit(code))
    c = F.col("_code")
    d = d.withColumns({"_xi": (F.col(y) - F.when(c > SOUTH, SOUTH_M).otherwise(0.0)) / (SCALE * _A), "_eta": (F.col(x) - EAST_M) / (SCALE * _A)})
    d = d.withColumns({"_t": F.col("_xi") - _series(_FROM, F.col("_xi"), F.col("_eta"), "sin"), "_lam": F.col("_eta") - _series(_FROM, F.col("_xi"), F.col("_eta"), "cos")})
    d = d.withColumn("_chi", F.asin(F.sin("_t") / F.cosh("_lam")))
    phi = F.col("_chi") + sum((f * F.sin(F.col("_chi") * (2.0 * j)) for j, f in enumerate(_LATITUDE, 1)), F.lit(0.0))
    lam = F.degrees(_middle(c) + F.atan2(F.sinh("_lam"), F.cos("_t")))
    plon = F.when(is_zone(c), F.when(lam > 180, lam - 360).when(lam < -180, lam + 360).otherwise(lam)).when(c == WEB, F.degrees(F.col(x) / HALF_AXIS_M)).when(c == DEGREES, F.col(x))
    plat = F.when(is_zone(c), F.degrees(phi)).when(c == WEB, F.degrees(F.atan(F.sinh(F.col(y) / HALF_AXIS_M)))).when(c == DEGREES, F.col(y))
    return _kept(d, plon, plat, lon, lat)


def _kept(d: DataFrame, a: Column, b: Column, first: str, second: str) -> DataFrame:
    finite = lambda v: F.when(~F.isnan(v) & (F.abs(v) < 1e300), v)
    d = d.withColumns({first: a, second: b}).drop(*_STEPS)
    both = finite(F.col(first)).isNotNull() & finite(F.col(second)).isNotNull()
    return d.withColumns({first: F.when(both, F.col(first)), second: F.when(both, F.col(second))})


#: pi times the half axis: how far the web plane goes in each direction.
WEB_EDGE_M = pi * HALF_AXIS_M
