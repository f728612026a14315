"""Coordinate reference systems by name, and shapes of any depth moved from one to another as column expressions.

``EPSG:4326`` degrees (x = longitude, y = latitude); ``EPSG:3857`` Web Mercator, whose lengths are stretched by
1 / cos(latitude); ``EPSG:326zz`` and ``EPSG:327zz`` metres of UTM zone zz, north and south; ``local:lat0:lon0`` metres around a
place (``geometry.project_xy``).  Every system goes to degrees and back, so any two can be joined.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from sparkwalk.functions import geometry as G

DEGREES = "EPSG:4326"
# The WGS84 ellipsoid, and scale and false origin of UTM.
_AXIS, _FLATTENING = 6378137.0, 1 / 298.257223563
_SCALE, _EAST, _SOUTH = 0.9996, 500000.0, 10000000.0

Move = Callable[[Column], Column]


def _mercator() -> tuple[Move, Move]:
    ahead = lambda p: G.point(F.radians(p["x"]) * _AXIS, F.log(F.tan(F.radians(p["y"]) / 2 + math.pi / 4)) * _AXIS)
    back = lambda p: G.point(F.degrees(p["x"] / _AXIS), F.degrees(F.atan(F.exp(p["y"] / _AXIS)) * 2 - math.pi / 2))
    return ahead, back


def _transverse(lon0: float, north: float) -> tuple[Move, Move]:
    """Transverse Mercator by Krueger's series to the fourth power of the third flattening, good to a tenth of a millimetre within a zone."""
    n = _FLATTENING / (2 - _FLATTENING)
    size = _SCALE * _AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    # The published coefficients of the series, a polynomial in n for each multiple of the angle.
    series = lambda *rows: [sum(c * n**k for k, c in enumerate(row, 4 - len(row) + 1)) for row in rows]
    alpha = series((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
    beta = series((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
    delta = series((2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))
    e = 2 * math.sqrt(n) / (1 + n)

    def wave(weights, a: Column, b: Column, f, g) -> Column:
        return sum((f(a * (2 * j)) * g(b * (2 * j)) * w for j, w in enumerate(weights, 1)), F.lit(0.0))

    def ahead(p: Column) -> Column:
        turn, s = F.radians(p["x"] - lon0), F.sin(F.radians(p["y"]))
        t = F.sinh(F.atanh(s) - F.atanh(s * e) * e)
        up, side = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(t * t + 1))
        return G.point(
            (side + wave(alpha, up, side, F.cos, F.sinh)) * size + _EAST, (up + wave(alpha, up, side, F.sin, F.cosh)) * size + north
        )

    def back(p: Column) -> Column:
        up, side = (p["y"] - north) / size, (p["x"] - _EAST) / size
        a, b = up - wave(beta, up, side, F.sin, F.cosh), side - wave(beta, up, side, F.cos, F.sinh)
        chi = F.asin(F.sin(a) / F.cosh(b))
        lat = chi + sum((F.sin(chi * (2 * j)) * w for j, w in enumerate(delta, 1)), F.lit(0.0))
        return G.point(F.degrees(F.atan2(F.sinh(b), F.cos(a))) + lon0, F.degrees(lat))

    return ahead, back


def moves(crs: str) -> tuple[Move, Move]:
    """Expressions from degrees to ``crs`` and back."""
    if crs == DEGREES:
        return (lambda p: p), (lambda p: p)
    if crs == "EPSG:3857":
        return _mercator()
    if m := re.fullmatch(r"EPSG:32([67])(\d\d)", crs):
        if 1 <= int(m[2]) <= 60:
            return _transverse(int(m[2]) * 6 - 183.0, 0.0 if m[1] == "6" else _SOUTH)
    if m := re.fullmatch(r"local:(-?[\d.]+):(-?[\d.]+)", crs):
        lat0, lon0 = float(m[1]), float(m[2])
        return (lambda p: G.project_xy(p, lat0, lon0)), (lambda p: G.unproject_xy(p, lat0, lon0))
    raise ValueError(f"unknown coordinate reference system {crs!r}")


def reproject(shape: Column, kind: T.DataType, source: str, target: str) -> Column:
    """``shape`` of the Spark type ``kind`` - a point, nested arrays of points, or a SHAPE - in another system; null stays null."""
    if source == target:
        return shape
    to_degrees, onward = moves(source)[1], moves(target)[0]

    def move(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda v: move(v, t.elementType))
        if "parts" in t.names:
            return F.when(c.isNotNull(), F.struct(c["kind"].alias("kind"), move(c["parts"], t["parts"].dataType).alias("parts")))
        return F.when(c.isNotNull(), onward(to_degrees(c)))

    return move(shape, kind)
