"""Rules on signals and their checks: three-valued failures, stages, kinds, relations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.astro import RATIOS

#: Checks that count as failed when they could not run; stages that more data can mend.
MUST_RUN = ("snr", "odd_even", "secondary_eclipse", "size", "period_alias", "momentum_dump", "duration", "three_dips")
MENDABLE = ("sde", "transits", "checks")
ODD_EVEN_FRACTION, TTV_FRACTION = 0.05, 0.02
DUO_DEPTH_RATIO, DUO_DURATION_RATIO = 1.5, 1.6


def is_failure(name: Column, passed: Column, must_run: tuple[str, ...] = MUST_RUN) -> Column:
    """Failed, or had to run and could not: never null."""
    return F.coalesce(~passed, name.isin(*must_run))


def failures(checks: Column, must_run: tuple[str, ...] = MUST_RUN) -> Column:
    """Names of failed checks in an array<struct<name, passed>>, in order."""
    return F.transform(F.filter(checks, lambda c: is_failure(c["name"], c["passed"], must_run)), lambda c: c["name"])


def check_counts(checks: Column) -> tuple[Column, Column]:
    """Checks that passed, and those that ran."""
    return F.size(F.filter(checks, lambda c: F.coalesce(c["passed"], F.lit(False)))), F.size(F.filter(checks, lambda c: c["passed"].isNotNull()))


def dip_stage(snr_passed: Column, n_failed: Column, same_star: Column, neighbours: Column) -> Column:
    """First stage that a single or paired dip fails; null for none."""
    return F.when(~snr_passed, "snr").when(n_failed > 0, "checks").when(same_star, "known").when(neighbours, "neighbour")


def is_promising(stage: Column, snr: Column) -> Column:
    """A signal that makes its star worth a deep pass: no stage failed, or a mendable one at an SNR of 7 or more."""
    return stage.isNull() | (F.coalesce(snr >= 7.0, F.lit(False)) & stage.isin(*MENDABLE))


def harmonic(p1: Column, p2: Column, tolerance: float = 0.01) -> Column:
    ratio = p1 / p2
    out = F.lit(False)
    for k in RATIOS:
        out = out | (F.abs(ratio - k) / k < tolerance)
    return out


def same_signal(found: Column, found_t0: Column, period: Column, t0: Column, longest: Column) -> Column:
    """Period within a hundredth, and time of an event within the longer duration."""
    away = F.pmod((found_t0 - t0) / period + 0.5, F.lit(1.0)) - 0.5
    return (F.abs(found - period) / period <= 0.01) & (F.abs(away) * period < longest)


def timing_error(t0_err: Column, period_err: Column, n_orbits: Column) -> Column:
    """Three sigma of a predicted time after ``n_orbits``."""
    a, b = F.coalesce(t0_err, F.lit(0.0)), n_orbits * F.coalesce(period_err, F.lit(0.0))
    return 3 * F.sqrt(a * a + b * b)


def slight_odd_even(odd: Column, even: Column, depth: Column, sigma: Column, timing: Column) -> Column:
    """Whether an odd-even failure rests on a small difference of depths alone; false where a figure is missing."""
    small = F.try_divide(F.abs(odd - even), F.abs(depth)) <= ODD_EVEN_FRACTION
    return F.coalesce(small & sigma.isNotNull() & (depth != 0) & (F.coalesce(timing, F.lit(0.0)) <= 10), F.lit(False))


def pairable(depth1: Column, err1: Column, duration1: Column, depth2: Column, err2: Column, duration2: Column) -> Column:
    """Two dips that may belong together: like in depth (by errors or ratio) and duration."""
    ratio = F.greatest(depth1, depth2) / F.greatest(F.least(depth1, depth2), F.lit(1e-12))
    sigmas = F.abs(depth1 - depth2) / F.sqrt(err1 * err1 + err2 * err2)
    return ((sigmas <= 3) | (ratio <= DUO_DEPTH_RATIO)) & (F.greatest(duration1, duration2) / F.least(duration1, duration2) <= DUO_DURATION_RATIO)


def trapezoid(t: Column, centre: Column, depth: Column, whole: Column, slope: Column) -> Column:
    """Flux of a trapezoid dip of total length ``whole`` whose sides last ``slope``, at most half of it."""
    x, side = F.abs(t - centre), F.least(slope, whole / 2)
    return 1 - F.when(x <= whole / 2 - side, depth).when(x < whole / 2, depth * (whole / 2 - x) / F.greatest(side, F.lit(1e-6))).otherwise(0.0)


def ephemeris_key(period: Column, t0: Column, duration_h: Column, sectors: Column) -> Column:
    """32 hex digits over the rounded period, time, duration and the sorted sectors."""
    part = lambda x, digits: F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x)).otherwise("null")
    listed = F.array_join(F.transform(F.array_sort(F.coalesce(sectors, F.array().cast("array<int>"))), lambda s: s.cast("string")), ",")
    return F.substring(F.sha2(F.concat_ws(";", part(period, 6), part(t0, 4), part(duration_h, 3), listed), 256), 1, 32)


def best_radius(best: Column, value: Column, low: Column, high: Column) -> Column:
    """The radius that a list is filtered by: what is given, else the middle or the one known end of its range."""
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    low, high = finite(low), finite(high)
    return F.coalesce(finite(best), finite(value), (low + high) / 2, low, high)


def lead(detections: Column, outcome: Column) -> Column:
    """The first detection with the star's own outcome, else the first."""
    return F.coalesce(F.get(F.filter(detections, lambda d: d["outcome"] == outcome), F.lit(0)), F.get(detections, F.lit(0)))
