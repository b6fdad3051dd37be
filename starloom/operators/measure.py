"""Signals measured each at its own ephemeris: statistics, noise and depths by epoch.

``d`` holds curves (star, t, flux, sector), ``signals`` (star, signal, period, t0, duration): what a search
returns. Every row meets the few signals of its star; sums and bins are formed by (star, signal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.functions.astro import phase
from starloom.operators import quantiles as q
from starloom.operators.shared import checkpointed
from starloom.operators.signals import over_dispersion

KEYS = ("star", "signal")
#: Rows outside that an SNR needs, bins that have a scatter of their own, rows and bins of red noise, rows of an epoch inside and around, rows outside for a scatter.
SNR_ROWS, SNR_BINS, NOISE_ROWS, NOISE_BINS, EPOCH_IN, EPOCH_NEAR, OUT_ROWS = 20, 10, 50, 10, 3, 5, 10
#: Scatter of a curve that has none.
NO_SCATTER = 1e-3
#: Significance of a difference between odd and even depths that fails a signal.
ODD_EVEN_SIGMA = 3.0


def same(x: str) -> Column:
    return F.col("star").eqNullSafe(F.col(f"{x}_star")) & F.col("signal").eqNullSafe(F.col(f"{x}_signal"))


def renamed(d: DataFrame, x: str) -> DataFrame:
    return d.withColumnsRenamed({k: f"{x}_{k}" for k in KEYS})


def paired(d: DataFrame, signals: DataFrame) -> DataFrame:
    """Each row with each signal of its star, the time from the nearest event and that event's number."""
    s = signals.select(F.col("star").alias("s_star"), "signal", *[F.col(c).cast("double").alias(c) for c in ("period", "t0", "duration")])
    rows = d.join(s, F.col("star").eqNullSafe(F.col("s_star"))).drop("s_star")
    away = phase(F.col("t"), F.col("period"), F.col("t0"))
    return rows.withColumns({"away": F.abs(away), "epoch": F.rint((F.col("t") - F.col("t0")) / F.col("period")).cast("long")})


def binned_noise(rows: DataFrame) -> DataFrame:
    """star, signal, n, sigma, usual, usual_full, bins, bin_sigma of rows out of transit: their scatter and that of means over a duration, of bins that are at least half as full as usual."""
    first = F.min("t").over(W.partitionBy(*KEYS))
    bins = rows.withColumn("_bin", F.floor((F.col("t") - first) / F.col("duration"))).groupBy(*KEYS, "_bin").agg(F.avg("flux").alias("mean"), F.count("*").alias("in_bin"))
    # As many bins as durations fit into a baseline.
    w = W.partitionBy(*KEYS)
    bins = bins.withColumn("usual", F.median("in_bin").over(w)).where(F.col("in_bin") >= 0.5 * F.col("usual"))
    bins = bins.withColumn("_middle", F.median("mean").over(w))
    of_bins = bins.groupBy(*KEYS).agg(F.first("usual").alias("usual"), F.median("in_bin").alias("usual_full"), F.count("*").alias("bins"), (F.median(F.abs(F.col("mean") - F.col("_middle"))) * 1.4826).alias("bin_sigma"))
    return q.robust_sigmas(rows, KEYS, F.col("flux")).select(*KEYS, "n", "median", "sigma").join(renamed(of_bins, "b"), same("b")).drop("b_star", "b_signal")


def red_noise(noise: DataFrame) -> Column:
    """The factor at the signal's duration from ``binned_noise``, 1 at least."""
    white = F.col("sigma") / F.sqrt("usual_full")
    known = (F.col("n") > NOISE_ROWS) & (F.col("bins") >= NOISE_BINS) & (white > 0)
    return F.when(known, F.greatest(F.lit(1.0), F.col("bin_sigma") / white)).otherwise(1.0)


def statistics(d: DataFrame, signals: DataFrame) -> DataFrame:
    """star, signal, depth, depth_err, odd, odd_err, even, even_err, n_transits, snr of each signal with rows in and out of transit.

    Depths are means out of transit less means inside; errors are the curve's robust scatter, times the red noise
    at the duration. The SNR is the depth over the scatter of means over a duration, at least what white noise
    gives, and the root of the transits; 0 where fewer than twenty rows lie outside twice the transit.
    """
    rows = checkpointed(paired(d, signals).select(*KEYS, "t", "flux", "period", "duration", "away", "epoch"))
    inside = F.col("away") < F.col("duration") / 2
    odd = F.pmod("epoch", F.lit(2)) == 1
    mean, count = (lambda c: F.avg(F.when(c, F.col("flux")))), F.count_if
    s = rows.groupBy(*KEYS).agg(
        mean(inside).alias("m_in"), count(inside).alias("n_in"), mean(~inside).alias("m_out"), count(~inside).alias("n_out"),
        mean(inside & odd).alias("m_odd"), count(inside & odd).alias("n_odd"), mean(inside & ~odd).alias("m_even"), count(inside & ~odd).alias("n_even"),
        F.count_distinct(F.when(inside, F.col("epoch"))).alias("n_transits"),
    ).where("n_in > 0 and n_out > 0")
    every = q.robust_sigmas(rows, KEYS, F.col("flux")).select(*KEYS, F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(NO_SCATTER).alias("dy"))
    wide = binned_noise(rows.where(F.col("away") >= F.col("duration")))
    spread = F.greatest(F.when(F.col("bins") > SNR_BINS, F.col("bin_sigma")).otherwise(F.col("sigma")), F.col("sigma") / F.sqrt("usual"))
    wide = wide.where(F.col("n") >= SNR_ROWS).select(*KEYS, spread.alias("spread"))
    near = binned_noise(rows.where(F.col("away") >= 0.75 * F.col("duration")))
    near = near.select(*KEYS, red_noise(near).alias("beta"))
    s = s.join(renamed(every, "e"), same("e")).join(renamed(wide, "w"), same("w"), "left").join(renamed(near, "n"), same("n"), "left")
    scale = F.col("dy") * F.coalesce("beta", F.lit(1.0))
    err = lambda n: F.when(F.col(n) > 0, scale * F.sqrt(1 / F.col(n) + 1 / F.col("n_out")))
    depth = F.col("m_out") - F.col("m_in")
    snr = F.when(F.col("spread") > 0, depth / (F.col("spread") / F.sqrt("n_transits"))).otherwise(0.0)
    of = lambda x: [(F.col("m_out") - F.col(f"m_{x}")).alias(x), err(f"n_{x}").alias(f"{x}_err")]
    return s.select(*KEYS, depth.alias("depth"), err("n_in").alias("depth_err"), *of("odd"), *of("even"), "n_transits", snr.alias("snr"))


def epoch_depths(d: DataFrame, signals: DataFrame) -> DataFrame:
    """star, signal, epoch, n_in, depth, err of each epoch with three rows inside, against the middle of five rows or more around it, else of all rows out of transit."""
    rows = checkpointed(paired(d, signals).select(*KEYS, "t", "flux", "period", "duration", "away", "epoch"))
    out = rows.where(F.col("away") >= 0.75 * F.col("duration"))
    noise = binned_noise(out)
    level = noise.select(*KEYS, "n", "median", "sigma", red_noise(noise).alias("beta"))
    every = q.robust_sigmas(rows, KEYS, F.col("flux")).select(*KEYS, F.col("sigma").alias("all_sigma"))
    level = checkpointed(every.join(renamed(level, "l"), same("l"), "left").select(*KEYS, F.coalesce("median", F.lit(1.0)).alias("base"), (F.when(F.coalesce("n", F.lit(0)) > OUT_ROWS, F.col("sigma")).otherwise(F.col("all_sigma")) * F.coalesce("beta", F.lit(1.0))).alias("scale")))
    inside = F.col("away") < F.col("duration") / 2
    near = (F.col("away") > 0.75 * F.col("duration")) & (F.col("away") < F.least(2.5 * F.col("duration"), 0.45 * F.col("period")))
    flux = lambda c: F.when(c, F.col("flux"))
    e = rows.groupBy(*KEYS, "epoch").agg(F.count_if(inside).alias("n_in"), F.avg(flux(inside)).alias("m_in"), F.count_if(near).alias("n_near"), F.median(flux(near)).alias("local")).where(F.col("n_in") >= EPOCH_IN)
    e = e.join(renamed(level, "l"), same("l"))
    own = F.col("n_near") >= EPOCH_NEAR
    depth = F.when(own, F.col("local")).otherwise(F.col("base")) - F.col("m_in")
    err = F.col("scale") * F.sqrt(1 / F.col("n_in") + F.when(own, 1 / F.col("n_near")).otherwise(0.0))
    return e.select(*KEYS, "epoch", "n_in", depth.alias("depth"), err.alias("err"))


def odd_even(measured: DataFrame, epochs: DataFrame) -> DataFrame:
    """star, signal, odd, odd_err, even, even_err, sigmas: depths by parity from epochs where both have one, else from the signal's statistics, with errors times the over-dispersion within a parity."""
    e = epochs.where("err > 0")
    scale = over_dispersion(e, KEYS)
    w = 1 / (F.col("err") * F.col("err"))
    of = lambda k, name: [(F.sum(F.when(F.pmod("epoch", F.lit(2)) == k, F.col("depth") * w)) / F.sum(F.when(F.pmod("epoch", F.lit(2)) == k, w))).alias(f"e_{name}"), (1 / F.sqrt(F.sum(F.when(F.pmod("epoch", F.lit(2)) == k, w)))).alias(f"e_{name}_err")]
    parity = e.groupBy(*KEYS).agg(*of(1, "odd"), *of(0, "even"))
    j = measured.join(renamed(parity, "p"), same("p"), "left").join(renamed(scale, "c"), same("c"), "left")
    both = F.col("e_odd").isNotNull() & F.col("e_even").isNotNull()
    pick = lambda name: F.when(both, F.col(f"e_{name}")).otherwise(F.col(name))
    times = F.coalesce("scale", F.lit(1.0))
    j = j.select(*KEYS, pick("odd").alias("odd"), (pick("odd_err") * times).alias("odd_err"), pick("even").alias("even"), (pick("even_err") * times).alias("even_err"))
    gap = F.abs(F.col("odd") - F.col("even")) / F.sqrt(F.col("odd_err") * F.col("odd_err") + F.col("even_err") * F.col("even_err"))
    return j.withColumn("sigmas", F.when(F.col("odd_err") + F.col("even_err") > 0, gap))
