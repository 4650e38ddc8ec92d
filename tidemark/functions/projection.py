"""Transverse Mercator (UTM) as column expressions, by Krüger's series to the fourth order.

Within a zone the series is good to far less than a millimetre.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greater semi-axis and flattening of the two ellipsoids, scale and origin of UTM.
WGS84, GRS80 = (6378137.0, 1 / 298.257223563), (6378137.0, 1 / 298.257222101)
SCALE, EAST, SOUTH = 0.9996, 500_000.0, 10_000_000.0


def series(ellipsoid: tuple[float, float] = WGS84) -> dict:
    """Radius of the rectifying sphere, eccentricity, and the coefficients of the series both ways."""
    a, f = ellipsoid
    n = f / (2 - f)
    return {
        "radius": SCALE * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64), "e": 2 * math.sqrt(n) / (1 + n),
        "alpha": [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280],
        "beta": [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280],
        "delta": [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630],
    }


def central_meridian(zone) -> Column:
    return F.lit(zone) * 6 - 183


def to_utm(lon: Column, lat: Column, zone, south: bool = False, ellipsoid: tuple[float, float] = WGS84) -> tuple[Column, Column]:
    """Easting and northing in metres of degrees east and north, in a zone (a number or a column)."""
    k = series(ellipsoid)
    sine, off = F.sin(F.radians(lat)), F.radians(lon - central_meridian(zone))
    t = F.sinh(F.atanh(sine) - k["e"] * F.atanh(k["e"] * sine))
    xi, eta = F.atan2(t, F.cos(off)), F.atanh(F.sin(off) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(k["alpha"], 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + k["radius"] * east, (SOUTH if south else 0.0) + k["radius"] * north


def from_utm(east: Column, north: Column, zone, south: bool = False, ellipsoid: tuple[float, float] = WGS84) -> tuple[Column, Column]:
    """Degrees east and north of an easting and northing."""
    k = series(ellipsoid)
    xi, eta = (north - (SOUTH if south else 0.0)) / k["radius"], (east - EAST) / k["radius"]
    x, y = xi, eta
    for j, b in enumerate(k["beta"], 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, d in enumerate(k["delta"], 1):
        lat = lat + d * F.sin(2 * j * chi)
    return central_meridian(zone) + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)
