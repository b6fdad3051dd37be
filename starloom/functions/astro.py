"""Closed-form expressions: sky positions, transits, sizes, times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
BTJD = 2457000.0
G, RHO_SUN = 6.6743e-11, 1410.0
RSUN_IN_RJUP = 9.731
CELL = 5
NOISE = (3.5821, 0.3153, 0.0504)
RATIOS = (1.0, 2.0, 3.0, 0.5, 1 / 3)


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up, alike in every engine: the last bits of a sum don't decide a tie."""
    k = 10.0**digits
    return F.floor(x * F.lit(k) + F.lit(0.500001)).cast("double") / F.lit(k)


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation in degrees by the haversine."""
    a, b = F.sin(F.radians(dec2 - dec1) / 2), F.sin(F.radians(ra2 - ra1) / 2)
    h = a * a + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * b * b
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def sky_cell(ra: Column, dec: Column, size: int = CELL) -> tuple[Column, Column]:
    """Cell of the sky: right ascension wraps, declination is held at the poles; null for what isn't finite."""
    known = ~F.isnan(ra) & ~F.isnan(dec) & (F.abs(ra) < float("inf")) & (F.abs(dec) < float("inf"))
    across = F.pmod(F.floor(F.pmod(ra, F.lit(360.0)) / size), F.lit(360 // size)).cast("int")
    up = F.least(F.floor((F.greatest(F.lit(-90.0), F.least(F.lit(90.0), dec)) + 90.0) / size), F.lit(180 // size - 1)).cast("int")
    return F.when(known, across), F.when(known, up)


def btjd(t: Column) -> Column:
    return F.when(t > 2_400_000, t - BTJD).otherwise(t)


def iso_of_btjd(t: Column) -> Column:
    seconds = F.floor((t + BTJD - 2440587.5) * 86400.0 + 0.5)
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def run_day(ts: Column, start_hour: int) -> Column:
    """The day a run belongs to when days begin at ``start_hour``."""
    return F.to_date(ts - F.expr(f"INTERVAL {start_hour} HOURS"))


def central_duration(period: Column, density: Column, k: float = 0.0) -> Column:
    """Days that a central transit on a circular orbit lasts; density in solar units."""
    per_period = period * 86400.0
    a_over_r = F.pow(F.lit(G) * density * RHO_SUN * per_period * per_period / F.lit(3 * math.pi), F.lit(1 / 3))
    return period / F.lit(math.pi) * F.asin(F.least(F.lit(1.0), F.lit(1 + k) / a_over_r))


def implied_radius(depth: Column, radius: Column, depth_err: Column, radius_err: Column) -> dict[str, Column]:
    """radius_rjup with its low and high ends: a tenth of the star's radius where its error is unknown."""
    usable = radius.isNotNull() & (depth > 0)
    star = F.coalesce(radius_err, radius * 0.1) / radius
    dip = F.when(depth_err > 0, depth_err).otherwise(0.0) / depth * 0.5
    share = F.sqrt(star * star + dip * dip)
    r = F.when(usable, radius * F.sqrt(depth) * RSUN_IN_RJUP)
    return {"radius_rjup": r, "radius_low": r * F.greatest(1 - share, F.lit(0.0)), "radius_high": r * (1 + share)}


def noise_1h(tmag: Column) -> Column:
    """Predicted noise over an hour, in parts per million."""
    x = tmag - 14.0
    return F.pow(F.lit(10.0), NOISE[0] + NOISE[1] * x + NOISE[2] * x * x)


def phase(t: Column, period: Column, t0: Column) -> Column:
    """Time from the nearest event, from -period/2 up to period/2."""
    return F.pmod(t - t0 + period / 2, period) - period / 2


def in_transit(t: Column, period: Column, t0: Column, duration: Column, scale: float = 1.0) -> Column:
    return F.abs(phase(t, period, t0)) < scale * duration / 2


def alias_of(found: Column, listed: Column, tolerance: float = 0.01) -> Column:
    """First ratio of RATIOS that found / listed comes within ``tolerance`` of; else null."""
    return F.coalesce(*[F.when(F.abs(found / listed - k) / k < tolerance, F.lit(k)) for k in RATIOS])


def sectors_mask(sector: str) -> Column:
    """Bits of a group's sectors, from 1 on."""
    return F.bit_or(F.expr(f"shiftleft(1L, cast({sector} as int) - 1)"))


def sectors_of(bits: str) -> Column:
    return F.expr(f"filter(sequence(1, 55), s -> (shiftright({bits}, s - 1) & 1) = 1)")
