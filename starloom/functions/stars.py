"""Rules and formulas on stars: tiers, ranks, densities, kinds, magnitudes, noise limits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.astro import G, RHO_SUN

#: Fixed values.
SMALL_STAR_RSUN = 0.8
DEEP_MIN_SECTORS, DEEP_MAX_TMAG = 5, 11.0
QUIET_MAX_TEFF, QUIET_MAX_CONTAMINATION = 6500.0, 0.1
NEAR_LIMIT_TMAG = 15.7
UNKNOWN_LAST = 99.0
KINDS = [(3900, "M"), (5300, "K"), (6000, "G"), (7500, "F"), (10000, "A")]
SIZES = [(1.25, "Earth-sized"), (2.0, "super-Earth"), (3.5, "sub-Neptune"), (6.0, "Neptune-sized"), (10.0, "Saturn-sized"), (16.0, "Jupiter-sized")]
REARTH_IN_RJUP = 11.209


def is_dwarf(lumclass: Column, logg: Column, least: float) -> Column:
    """A class that isn't known counts as dwarf, as does a gravity that isn't."""
    return (F.coalesce(lumclass, F.lit("DWARF")) == "DWARF") & F.coalesce(logg >= least, F.lit(True))


def bright_tier(lumclass: Column, logg: Column, teff: Column, rad: Column) -> Column:
    surely = F.coalesce(lumclass == "DWARF", F.lit(False))
    dwarf = is_dwarf(lumclass, logg, 3.8)
    return F.when(surely & dwarf & (teff < 4000), 0).when(dwarf & (rad < SMALL_STAR_RSUN), 1).when(surely & rad.isNotNull(), 2).otherwise(3)


def faint_tier(rad: Column, n_sectors: Column, contratio: Column, tmag: Column) -> Column:
    clean = F.coalesce(contratio, F.lit(0.0))
    return F.when(tmag > NEAR_LIMIT_TMAG, 3).when((rad <= 0.4) & (n_sectors >= 3) & (clean <= 0.1), 1).when((rad <= 0.6) & (n_sectors >= 2) & (clean <= 0.3), 2).otherwise(3)


def is_quiet(lumclass: Column, logg: Column, teff: Column, contratio: Column) -> Column:
    return is_dwarf(lumclass, logg, 4.0) & F.coalesce(teff <= QUIET_MAX_TEFF, F.lit(True)) & F.coalesce(contratio < QUIET_MAX_CONTAMINATION, F.lit(True))


def search_group(n_sectors: Column, tmag: Column, quiet: Column) -> Column:
    """0: quiet bright stars with many sectors, 1: other stars with many, 2: the rest."""
    return F.when(n_sectors < DEEP_MIN_SECTORS, 2).when(F.coalesce(tmag <= DEEP_MAX_TMAG, F.lit(False)) & quiet, 0).otherwise(1)


def rank_order(group: str, tier: str, rad: str, tmag: str) -> list[Column]:
    """What bright targets are ranked by; what isn't known comes last."""
    return [F.col(group), F.col(tier), F.coalesce(rad, F.lit(UNKNOWN_LAST)), F.coalesce(tmag, F.lit(UNKNOWN_LAST))]


def density(rho: Column, rad: Column, mass: Column, lumclass: Column | None = None) -> tuple[Column, Column]:
    """Density in solar units and where it comes from. With ``lumclass`` a radius alone serves only small dwarfs."""
    assumed = rad > 0
    if lumclass is not None:
        assumed = assumed & (F.coalesce(lumclass, F.lit("DWARF")) == "DWARF") & (rad < 1.5)
    cases = [(rho > 0, rho, "density"), ((rad > 0) & (mass > 0), mass / (rad * rad * rad), "mass and radius"), (assumed, 1 / (rad * rad), "radius with M = R assumed")]
    value, source = F.lit(None).cast("double"), F.lit("no radius")
    for when, found, name in reversed(cases):
        value, source = F.when(when, found).otherwise(value), F.when(when, F.lit(name)).otherwise(source)
    return value, source


def tmag_of_gaia(g: Column, bp_rp: Column) -> Column:
    """TESS magnitude by a cubic in the colour, which is held to -0.2 to 3.5."""
    c = F.least(F.greatest(bp_rp, F.lit(-0.2)), F.lit(3.5))
    known = bp_rp.isNotNull() & ~F.isnan(bp_rp)
    return F.when(known, g + ((-0.00522555 * c + 0.0891337) * c - 0.633923) * c + 0.0324473).otherwise(g - 0.43)


def spectral_type(teff: Column) -> Column:
    kind = F.lit("B")
    for below, name in reversed(KINDS):
        kind = F.when(teff < below, name).otherwise(kind)
    return F.when(teff.isNotNull(), kind)


def star_kind(teff: Column, radius: Column) -> Column:
    """A plain phrase for a star."""
    kind = spectral_type(teff)
    an = lambda noun: F.concat(F.when(kind.isin("A", "F", "M"), "an ").otherwise("a "), kind, noun)
    giant = F.when(kind.isin("M", "K"), "a red giant").otherwise("an evolved giant")
    return F.when(teff.isNull(), "a star").when(radius > 3, giant).when(radius > 1.6, an(F.lit(" subgiant"))).otherwise(an(F.when(kind.isin("A", "B"), " star").otherwise(" dwarf")))


def size_class(rjup: Column) -> Column:
    out = F.lit("bigger than Jupiter")
    for below, name in reversed(SIZES):
        out = F.when(rjup * REARTH_IN_RJUP < below, name).otherwise(out)
    return F.when(rjup.isNotNull(), out)


def eccentric_duration(period: Column, rho: Column, b: Column, k: Column, e: Column, w: Column) -> Column:
    """Days from first to last contact on an eccentric orbit; density in solar units."""
    seconds = period * 86400.0
    a = F.pow(F.lit(G) * rho * RHO_SUN * seconds * seconds / F.lit(3 * math.pi), F.lit(1 / 3))
    chord = F.sqrt(F.greatest((1 + k) * (1 + k) - b * b, F.lit(0.0)))
    x = chord / (a * F.sqrt(F.greatest(1 - (b / a) * (b / a), F.lit(1e-9))))
    return period / F.lit(math.pi) * F.asin(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))) * F.sqrt(1 - e * e) / (1 + e * F.sin(w))


def least_companion_mass(period: Column, k_kms: Column, ecc: Column, mass: Column, steps: int = 60) -> Column:
    """Least mass of a companion in solar masses by bisection of the mass function on 0 to 100."""
    f = period * 86400.0 * F.pow(k_kms * 1e3, 3.0) * F.pow(1 - ecc * ecc, 1.5) / F.lit(2 * math.pi * 6.674e-11 * 1.98892e30)

    def halve(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        low = mid * mid * mid / ((mass + mid) * (mass + mid)) < f
        return F.struct(F.when(low, mid).otherwise(a["lo"]).alias("lo"), F.when(low, a["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(100.0).alias("hi")), halve, lambda a: (a["lo"] + a["hi"]) / 2)
