"""Positions on the sky: separations, motions, projections and rotations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.astro import BTJD

#: Rows of the rotation from galactic to equatorial axes, and the tilt of the ecliptic.
GALACTIC = [(-0.0548755604, 0.4941094279, -0.867666149), (-0.8734370902, -0.44482963, -0.1980763734), (-0.4838350155, 0.7469822445, 0.4559837762)]
OBLIQUITY = 23.4393


def cosine_separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Degrees by the law of cosines, clamped."""
    d1, d2 = F.radians(dec1), F.radians(dec2)
    c = F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(F.radians(ra1 - ra2))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def moved(ra: Column, dec: Column, pmra: Column, pmdec: Column, years: Column) -> tuple[Column, Column]:
    """Position after ``years`` of proper motion in mas a year; none where it isn't known."""
    east = F.coalesce(pmra, F.lit(0.0)) * years / 3.6e6 / F.greatest(F.cos(F.radians(dec)), F.lit(1e-6))
    return ra + east, dec + F.coalesce(pmdec, F.lit(0.0)) * years / 3.6e6


def offset_arcsec(ra0: Column, dec0: Column, ra: Column, dec: Column) -> tuple[Column, Column]:
    """(east, north) of a near position; right ascension wraps."""
    east = F.pmod(ra - ra0 + 540.0, F.lit(360.0)) - 180.0
    return east * F.cos(F.radians(dec0)) * 3600.0, (dec - dec0) * 3600.0


def julian_year(btjd: Column) -> Column:
    return 2000.0 + (btjd + (BTJD - 2451545.0)) / 365.25


def galactic_to_equatorial(lon: Column, lat: Column) -> tuple[Column, Column]:
    l, b = F.radians(lon), F.radians(lat)
    v = (F.cos(b) * F.cos(l), F.cos(b) * F.sin(l), F.sin(b))
    x, y, z = (sum((F.lit(m) * c for m, c in zip(row[1:], v[1:])), F.lit(row[0]) * v[0]) for row in GALACTIC)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))


def ecliptic_to_equatorial(lon: Column, lat: Column) -> tuple[Column, Column]:
    e, l, b = F.lit(math.radians(OBLIQUITY)), F.radians(lon), F.radians(lat)
    ra = F.atan2(F.sin(l) * F.cos(e) - F.tan(b) * F.sin(e), F.cos(l))
    dec = F.asin(F.sin(b) * F.cos(e) + F.cos(b) * F.sin(e) * F.sin(l))
    return F.pmod(F.degrees(ra) + 360.0, F.lit(360.0)), F.degrees(dec)


def mollweide(ra: Column, dec: Column, steps: int = 30) -> tuple[Column, Column]:
    """x (-2 to 2, right ascension to the left) and y (-1 to 1) of an equal-area map; Newton steps, none at the poles."""
    lon = -(F.pmod(ra + 180.0, F.lit(360.0)) - 180.0)
    phi = F.radians(dec)
    step = lambda t, _: t - F.coalesce((2 * t + F.sin(2 * t) - F.lit(math.pi) * F.sin(phi)) / F.nullif(2 + 2 * F.cos(2 * t), F.lit(0.0)), F.lit(0.0))
    theta = F.when(F.abs(F.abs(phi) - math.pi / 2) < 1e-9, phi).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), phi, step))
    return F.lit(2 / math.pi) * F.radians(lon) * F.cos(theta), F.sin(theta)


def tangent_plane(ra0: Column, dec0: Column, ra: Column, dec: Column) -> tuple[Column, Column]:
    """Degrees east and north of a place on the plane that touches the sky at (ra0, dec0)."""
    a, d, d0 = F.radians(ra - ra0), F.radians(dec), F.radians(dec0)
    c = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a)
    return F.degrees(F.cos(d) * F.sin(a) / c), F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a)) / c)


def from_tangent_plane(ra0: Column, dec0: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """The place on the sky of a point on that plane."""
    x, y, d0 = F.radians(east), F.radians(north), F.radians(dec0)
    down = F.cos(d0) - y * F.sin(d0)
    return F.pmod(ra0 + F.degrees(F.atan2(x, down)), F.lit(360.0)), F.degrees(F.atan2(F.sin(d0) + y * F.cos(d0), F.hypot(x, down)))


def pixel_of(ra: Column, dec: Column) -> tuple[Column, Column]:
    """(x, y) on an image whose columns say ra0, dec0 (touching point), x0, y0 (its pixel) and c11, c12, c21, c22 (degrees a pixel)."""
    e, n = tangent_plane(F.col("ra0"), F.col("dec0"), ra, dec)
    a, b, c, d = (F.col(k) for k in ("c11", "c12", "c21", "c22"))
    det = a * d - b * c
    return F.col("x0") + (d * e - b * n) / det, F.col("y0") + (a * n - c * e) / det


def place_of(x: Column, y: Column) -> tuple[Column, Column]:
    """(ra, dec) of a pixel of such an image."""
    u, v = x - F.col("x0"), y - F.col("y0")
    return from_tangent_plane(F.col("ra0"), F.col("dec0"), F.col("c11") * u + F.col("c12") * v, F.col("c21") * u + F.col("c22") * v)


def pixel_slopes(ra: Column, dec: Column, x: Column, y: Column) -> dict[str, Column]:
    """ex, nx, ey, ny: arcsec east and north that one pixel more in x or y leads to, seen from (ra, dec)."""
    here = offset_arcsec(ra, dec, *place_of(x, y))
    out = {}
    for axis, at in (("x", (x + 1, y)), ("y", (x, y + 1))):
        east, north = offset_arcsec(ra, dec, *place_of(*at))
        out[f"e{axis}"], out[f"n{axis}"] = east - here[0], north - here[1]
    return out
