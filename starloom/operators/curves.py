"""Operators on light curves: rows of (star, sector, t, flux).

Windows run over a star or a star's sector; a star's rows are bounded by the survey's cadence, so a
partition is too. What only needs sums is grouped, with partial sums before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.functions.astro import in_transit, phase
from starloom.operators.quantiles import robust_sigmas

SECTOR = ("star", "sector")


def over(keys: tuple[str, ...]) -> W:
    return W.partitionBy(*keys)


def median_normalised(d: DataFrame, keys: tuple[str, ...] = SECTOR) -> DataFrame:
    return d.withColumn("flux", F.col("flux") / F.median("flux").over(over(keys)))


def robust_sigma(d: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, n, median, sigma: 1.4826 times the median distance from the median."""
    return robust_sigmas(d, keys, F.col("flux"))


def clip_upward(d: DataFrame, keys: tuple[str, ...] = SECTOR, limit: float = 3.0) -> DataFrame:
    """Rows strictly below median + ``limit`` robust sigmas."""
    s = robust_sigmas(d, keys, F.col("flux")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("median").alias("m"), F.col("sigma").alias("s"))
    m = d.join(s, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return m.where(F.col("flux") < F.col("m") + limit * F.col("s")).drop("m", "s", *[f"_{k}" for k in keys])


def time_bins(d: DataFrame, width: float | Column, keys: tuple[str, ...] = SECTOR) -> DataFrame:
    """Bins that begin at a group's first time: keys, bin, n, mean t and flux."""
    first = d.withColumn("t_first", F.min("t").over(over(keys)))
    return first.groupBy(*keys, F.floor((F.col("t") - F.col("t_first")) / width).alias("bin")).agg(F.count("*").alias("n"), F.avg("t").alias("t"), F.avg("flux").alias("flux"))


def adaptive_bins(d: DataFrame, points: int, width: float, keys: tuple[str, ...] = ("star",)) -> DataFrame:
    """Time bins as wide as makes at most about ``points`` of them from the slots of ``width`` that hold data."""
    slots = d.groupBy(*keys).agg(F.countDistinct(F.floor(F.col("t") / width)).alias("slots"))
    wide = d.join(slots, list(keys)).withColumn("width", F.lit(width) * F.ceil(F.col("slots") / points))
    return time_bins(wide, F.col("width"), (*keys, "width"))


def least_of_bins(d: DataFrame, bins: int, keys: tuple[str, ...] = ("star",)) -> DataFrame:
    """At most ``bins`` runs of rows in order of time and the least flux of each."""
    place = F.row_number().over(over(keys).orderBy("t")) - 1
    n = F.count("*").over(over(keys))
    run = F.floor(place * F.least(F.lit(bins), n) / n)
    return d.select(*keys, run.alias("bin"), "flux").groupBy(*keys, "bin").agg(F.min("flux").alias("flux"))


def folded_bins(d: DataFrame, period: float, t0: float, bins: int, keys: tuple[str, ...] = ("star",)) -> DataFrame:
    p = F.pmod((F.col("t") - t0) / period, F.lit(1.0))
    return d.groupBy(*keys, F.floor(p * bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("flux").alias("flux"))


def segments(d: DataFrame, gap: float, keys: tuple[str, ...] = ("star",)) -> DataFrame:
    """Adds segment: a new one begins after a gap strictly longer than ``gap``."""
    w = over(keys).orderBy("t")
    new = F.coalesce((F.col("t") - F.lag("t").over(w) > gap).cast("int"), F.lit(0))
    return d.withColumn("new", new).withColumn("segment", F.sum("new").over(w).cast("long")).drop("new")


def segment_edges(d: DataFrame, gap: float) -> DataFrame:
    return segments(d, gap).groupBy("star", "segment").agg(F.min("t").alias("begins"), F.max("t").alias("ends"), F.count("*").alias("n"))


def median_cadence(d: DataFrame, keys: tuple[str, ...] = SECTOR) -> DataFrame:
    step = F.col("t") - F.lag("t").over(over(keys).orderBy("t"))
    return d.select(*keys, step.alias("step")).groupBy(*keys).agg(F.median("step").alias("cadence"))


def gap_axis(d: DataFrame, longest: float, keys: tuple[str, ...] = ("star",)) -> DataFrame:
    """Adds x: time in which no gap is longer than ``longest``."""
    w = over(keys).orderBy("t")
    step = F.coalesce(F.least(F.col("t") - F.lag("t").over(w), F.lit(longest)), F.lit(0.0))
    return d.withColumn("step", step).withColumn("x", F.sum("step").over(w)).drop("step")


def around(function: str, width: float, keys: tuple[str, ...] = ("star",)) -> Column:
    """``function`` over rows within half of ``width`` in time, both ends included."""
    half = width / 2
    return F.expr(f"{function} over (partition by {', '.join(keys)} order by t range between {half}D preceding and {half}D following)")


def boxes(d: DataFrame, width: float) -> DataFrame:
    """Adds n_box and mean_box of the box around each row."""
    return d.withColumns({"n_box": around("count(flux)", width), "mean_box": around("avg(flux)", width)})


def running_median(d: DataFrame, width: float) -> DataFrame:
    return d.withColumn("trend", around("percentile(flux, 0.5)", width))


def moving_means(d: DataFrame, n: int, longest: float, keys: tuple[str, ...] = ("star",)) -> DataFrame:
    """Means of ``n`` rows in a row that span at most ``longest``."""
    w = over(keys).orderBy("t").rowsBetween(0, n - 1)
    m = d.withColumns({"mean": F.avg("flux").over(w), "span": F.max("t").over(w) - F.col("t"), "rows": F.count("*").over(w)})
    return m.where((F.col("rows") == n) & (F.col("span") <= longest)).drop("rows")


def dilated(d: DataFrame, flag: str, width: float) -> DataFrame:
    """``flag``, true as well for rows within half of ``width`` of a true one."""
    return d.withColumn(flag, around(f"max({flag})", width))


def islands(d: DataFrame, above: float, bridge: int, least: int) -> DataFrame:
    """Runs of rows above a threshold, with up to ``bridge`` lower rows between: star, island, n, begin, end, peak."""
    w = W.partitionBy("star").orderBy("t")
    hot = d.withColumn("place", F.row_number().over(w)).where(F.col("flux") > above)
    new = F.coalesce((F.col("place") - F.lag("place").over(w) > bridge + 1).cast("int"), F.lit(0))
    runs = hot.withColumn("new", new).withColumn("island", F.sum("new").over(w).cast("long"))
    return runs.groupBy("star", "island").agg(F.count("*").alias("n"), F.min("t").alias("begins"), F.max("t").alias("ends"), F.max("flux").alias("peak")).where(F.col("n") >= least)


def epochs(d: DataFrame, period: float, t0: float, duration: float, reach: float = 3.0) -> DataFrame:
    """Depth of each epoch against its own baseline: star, epoch, n_in, n_base, depth, err.

    Epochs need three rows inside and three around; err is the baseline's scatter over sqrt(n_in).
    """
    p, t, z, dur = F.lit(period), F.col("t"), F.lit(t0), F.lit(duration)
    inside = in_transit(t, p, z, dur)
    base = ~in_transit(t, p, z, dur, 1.5) & (F.abs(phase(t, p, z)) < reach * duration)
    e = d.withColumns({"epoch": F.bround((t - z) / p).cast("long"), "f_in": F.when(inside, F.col("flux")), "f_base": F.when(base, F.col("flux"))})
    g = e.groupBy("star", "epoch").agg(F.count("f_in").alias("n_in"), F.count("f_base").alias("n_base"), F.avg("f_in").alias("m_in"), F.avg("f_base").alias("m_base"), F.stddev_samp("f_base").alias("sd"))
    g = g.where("n_in >= 3 and n_base >= 3 and sd > 0")
    return g.select("star", "epoch", "n_in", "n_base", (F.col("m_base") - F.col("m_in")).alias("depth"), (F.col("sd") / F.sqrt("n_in")).alias("err"))


def weighted_mean(e: DataFrame, keys: list, value: str = "depth", err: str = "err") -> DataFrame:
    """Mean weighted by 1 / err squared, and its error."""
    w = 1 / (F.col(err) * F.col(err))
    return e.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(F.col(value) * w) / F.sum(w)).alias("mean"), (1 / F.sqrt(F.sum(w))).alias("mean_err"))


def odd_even(e: DataFrame) -> DataFrame:
    return weighted_mean(e, ["star", F.pmod("epoch", F.lit(2)).alias("parity")])


def without_strongest(e: DataFrame) -> DataFrame:
    """Weighted mean of a star's epochs but for the strongest; ties go to the first epoch."""
    rank = F.row_number().over(W.partitionBy("star").orderBy((F.col("depth") / F.col("err")).desc(), "epoch"))
    return weighted_mean(e.withColumn("rank", rank).where("rank > 1"), ["star"])


def alias_groups(e: DataFrame) -> DataFrame:
    """Weighted means by epoch modulo 2 and 3."""
    k = e.withColumn("k", F.explode(F.array(F.lit(2), F.lit(3)))).withColumn("part", F.pmod("epoch", F.col("k")))
    return weighted_mean(k, ["star", "k", "part"])


def red_noise(d: DataFrame, width: float, keys: tuple[str, ...] = ("star",)) -> DataFrame:
    """Scatter of bin means over what white noise would give, 1 at least."""
    bins = time_bins(d, width, keys).select(*keys, F.col("flux"), F.col("n").alias("in_bin"))
    of_bins = robust_sigma(bins, keys).withColumnsRenamed({"n": "bins", "sigma": "bin_sigma"}).drop("median")
    typical = bins.groupBy(*keys).agg(F.median("in_bin").alias("typical"))
    of_rows = robust_sigma(d, keys).select(*keys, "sigma")
    j = of_rows.join(of_bins, list(keys)).join(typical, list(keys)).where("sigma > 0")
    return j.select(*keys, "bins", F.greatest(F.lit(1.0), F.col("bin_sigma") / (F.col("sigma") / F.sqrt("typical"))).alias("factor"))


#: Fixed values of the cascade.
STAGES = ["snr", "sde", "transits", "checks", "known", "neighbour"]
MIN_SNR, MIN_SDE, SDE_EXEMPT, MIN_TRANSITS = 10.0, 9.0, 30.0, 3


def failed_stage(min_snr: float = MIN_SNR, min_sde: float = MIN_SDE, exempt: float = SDE_EXEMPT, least: int = MIN_TRANSITS) -> Column:
    """First stage that a signal (snr, sde, n_transits, n_failed, known, neighbour) fails; null: none."""
    c = F.col
    return (
        F.when(c("snr") < min_snr, "snr")
        .when((c("sde") < min_sde) & (c("snr") < exempt), "sde")
        .when(c("n_transits") < least, "transits")
        .when(c("n_failed") > 0, "checks")
        .when(c("known"), "known")
        .when(c("neighbour"), "neighbour")
    )


def funnel(signals: DataFrame, kind: str = "kind", stage: str = "failed_stage") -> DataFrame:
    """kind, step, stage, dropped, left: how many are left after each stage, in order."""
    spark = signals.sparkSession
    steps = spark.createDataFrame(list(enumerate(STAGES, 1)), "step int, stage string")
    counts = signals.groupBy(kind, F.col(stage).alias("s")).agg(F.count("*").alias("n"))
    total = counts.groupBy(kind).agg(F.sum("n").alias("all"))
    grid = total.crossJoin(F.broadcast(steps))  # six rows for each kind
    j = grid.join(counts.withColumnRenamed(kind, "k2"), (F.col(kind) == F.col("k2")) & (F.col("stage") == F.col("s")), "left")
    dropped = F.coalesce("n", F.lit(0))
    gone = F.sum(dropped).over(W.partitionBy(kind).orderBy("step"))
    return j.select(kind, "step", "stage", dropped.alias("dropped"), (F.col("all") - gone).alias("left"))
