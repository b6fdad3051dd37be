"""Signals measured at their own ephemerides: planted transits, a binary, noise."""

import numpy as np
from pyspark.sql import functions as F

from starloom.operators import measure


def test_planted_signals(spark):
    rng = np.random.default_rng(11)
    rows, signals = [], []
    for star, (period, t0, duration, odd, even) in {1: (2.0, 0.7, 0.2, 0.01, 0.01), 2: (3.1, 1.1, 0.3, 0.02, 0.005), 3: (2.5, 0.4, 0.2, 0.0, 0.0)}.items():
        t = np.arange(0, 40, 0.02)
        f = 1 + rng.normal(0, 0.001, len(t))
        epoch = np.rint((t - t0) / period).astype(int)
        f -= np.where(np.abs(t - t0 - epoch * period) < duration / 2, np.where(epoch % 2 == 1, odd, even), 0)
        rows += [(star, 1, float(a), float(b)) for a, b in zip(t, f)]
        signals += [(star, 1, period, t0, duration), (star, 2, period * 1.37, t0 + 0.5, duration)]
    d = spark.createDataFrame(rows, "star long, sector int, t double, flux double")
    s = spark.createDataFrame(signals, "star long, signal int, period double, t0 double, duration double")
    stats = measure.statistics(d, s)
    epochs = measure.epoch_depths(d, s)
    got = {(r["star"], r["signal"]): r for r in stats.collect()}
    for star, depth in ((1, 0.01), (3, 0.0)):
        assert abs(got[star, 1]["depth"] - depth) < 4 * got[star, 1]["depth_err"]
    assert got[1, 1]["snr"] > 30 and got[1, 1]["n_transits"] == 20 and abs(got[3, 1]["snr"]) < 5
    parity = {(r["star"], r["signal"]): r["sigmas"] for r in measure.odd_even(stats, epochs).collect()}
    assert parity[2, 1] > 10 and parity[1, 1] < 3 and parity[3, 1] < 3
    of = epochs.where("star = 1 and signal = 1").agg(F.count("*"), F.avg("depth"), F.stddev("depth"), F.avg("err")).first()
    assert of[0] == 20 and abs(of[1] - 0.01) < 0.0004 and 0.5 < of[2] / of[3] < 2
    assert measure.statistics(d, s.limit(0)).count() == 0
