"""Universal Transverse Mercator as column expressions (Krueger's series to the fourth order, within a millimetre of its zone)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_A, _F = 6378137.0, 1 / 298.257223563  # WGS 84; GRS 80 differs by a tenth of a millimetre
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280]
_BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280]
_DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630]
_K0, _EAST = 0.9996, 500000.0


def zone_of(longitude: Column) -> Column:
    return (F.floor((longitude + 180) / 6) % 60 + 1).cast("int")


def to_utm(longitude: Column, latitude: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(easting, northing) in metres of degrees."""
    lam = F.radians(longitude - (6 * zone - 183))
    sin = F.sin(F.radians(latitude))
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(sin) - e * F.atanh(e * sin))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _EAST + _K0 * _RADIUS * x, (10_000_000.0 if south else 0.0) + _K0 * _RADIUS * y


def from_utm(easting: Column, northing: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees."""
    xi = (northing - (10_000_000.0 if south else 0.0)) / (_K0 * _RADIUS)
    eta = (easting - _EAST) / (_K0 * _RADIUS)
    x, y = eta, xi
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    chi = F.asin(F.sin(y) / F.cosh(x))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return (6 * zone - 183) + F.degrees(F.atan2(F.sinh(x), F.cos(y))), F.degrees(lat)
