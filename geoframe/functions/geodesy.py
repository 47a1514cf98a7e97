"""Geodetic coordinates to a local metric frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .linear import const, let, matvec, minus, vec

# The WGS84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
WGS84_E2 = WGS84_F * (2.0 - WGS84_F)


def dms_to_degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    value = d + m / 60 + s / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def to_ecef(lat: Column, lon: Column, alt: Column) -> Column:
    """Degrees and metres to earth-centred coordinates."""

    def body(a: Column) -> Column:
        n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.pow(F.sin(a["lat"]), F.lit(2)))
        return let(n, lambda v: vec((v + alt) * F.cos(a["lat"]) * F.cos(a["lon"]), (v + alt) * F.cos(a["lat"]) * F.sin(a["lon"]), (v * (1 - WGS84_E2) + alt) * F.sin(a["lat"])))

    return let(F.struct(F.radians(lat).alias("lat"), F.radians(lon).alias("lon")), body)


def enu_axes(lat: float, lon: float) -> list[float]:
    """Rows: east, north and up at a place, in earth-centred coordinates."""
    from math import cos, radians, sin

    a, b = radians(lat), radians(lon)
    return [-sin(b), cos(b), 0.0, -sin(a) * cos(b), -sin(a) * sin(b), cos(a), cos(a) * cos(b), cos(a) * sin(b), sin(a)]


def ecef_point(lat: float, lon: float, alt: float) -> list[float]:
    from math import cos, radians, sin, sqrt

    a, b = radians(lat), radians(lon)
    n = WGS84_A / sqrt(1 - WGS84_E2 * sin(a) ** 2)
    return [(n + alt) * cos(a) * cos(b), (n + alt) * cos(a) * sin(b), (n * (1 - WGS84_E2) + alt) * sin(a)]


def to_enu(lat: Column, lon: Column, alt: Column, origin: tuple[float, float, float]) -> Column:
    """East, north and up in metres about ``origin``."""
    return matvec(const(enu_axes(*origin[:2])), minus(to_ecef(lat, lon, alt), const(ecef_point(*origin))))
