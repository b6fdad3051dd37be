"""Operators on light curves and events around a search: masks, nearest joins, noise, depths, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.functions.signals import pairable

#: Fixed values.
EDGE_D, GAP_D, MAX_ATTEMPTS = 0.25, 0.5, 3


def good_rows(d: DataFrame, dropout: float | None = None) -> DataFrame:
    """Rows with a finite time and a finite positive flux, above ``dropout`` if given."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return d.where(finite("t") & finite("flux") & (F.col("flux") > (0.0 if dropout is None else dropout)))


def edge_mask(d: DataFrame, width: float = EDGE_D, gap: float = GAP_D, keys: tuple[str, ...] = ("star",)) -> DataFrame:
    """Adds masked: within ``width`` of the beginning or end of a run without a gap of ``gap``.

    The last break before a row and the first one after it are found by running minima and maxima
    over the star's rows, so no run is joined back.
    """
    w = W.partitionBy(*keys).orderBy("t", "event_id")
    begins = F.when(F.coalesce(F.col("t") - F.lag("t").over(w) > gap, F.lit(True)), F.col("t"))
    ends = F.when(F.coalesce(F.lead("t").over(w) - F.col("t") > gap, F.lit(True)), F.col("t"))
    d = d.withColumns({"_begin": begins, "_end": ends})
    first = F.last("_begin", True).over(w.rowsBetween(W.unboundedPreceding, 0))
    last = F.first("_end", True).over(w.rowsBetween(0, W.unboundedFollowing))
    return d.withColumn("masked", (F.col("t") < first + width) | (F.col("t") > last - width)).drop("_begin", "_end")


def local_sigma(d: DataFrame, chunk: float = 1.0, least: int = 20, keys: tuple[str, ...] = ("star",)) -> DataFrame:
    """Robust sigma of each chunk of time; the whole star's where the chunk has fewer than ``least`` rows."""
    sigma = lambda: F.lit(1.4826) * F.median(F.abs(F.col("flux") - F.col("_median")))
    part = [*keys, F.floor(F.col("t") / chunk).alias("chunk")]
    medians = d.groupBy(*part).agg(F.median("flux").alias("_median"), F.count("*").alias("n"))
    own = d.withColumn("chunk", F.floor(F.col("t") / chunk)).join(medians, [*keys, "chunk"]).groupBy(*keys, "chunk", "n").agg(sigma().alias("own"))
    whole = d.join(d.groupBy(*keys).agg(F.median("flux").alias("_median")), list(keys)).groupBy(*keys).agg(sigma().alias("whole"))
    return own.join(whole, list(keys)).select(*keys, "chunk", F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("whole")).alias("sigma"))


def consecutive_means(d: DataFrame, points: int, keys: tuple[str, ...] = ("star",)) -> DataFrame:
    """Means of runs of as many rows in a row as leave at most ``points``."""
    w = W.partitionBy(*keys)
    per = F.ceil(F.count("*").over(w) / F.lit(points))
    run = F.floor((F.row_number().over(w.orderBy("t", "event_id")) - 1) / per)
    return d.withColumn("run", run).groupBy(*keys, "run").agg(F.avg("t").alias("t"), F.avg("flux").alias("flux"), F.count("*").alias("n"))


def nearest(left: DataFrame, right: DataFrame, tolerance: float, keys: tuple[str, ...] = ("star",)) -> DataFrame:
    """``left`` (event_id, t) with the time and value of the nearest row of ``right`` (t, value) within ``tolerance``, earlier ones first; null if none.

    Both sides meet in one sorted pass over a key's rows: the last one before and the first one after.
    """
    both = left.select(*keys, "event_id", "t", F.lit(None).cast("struct<t:double,value:double>").alias("r")).unionByName(right.select(*keys, F.lit(None).cast("long").alias("event_id"), "t", F.struct("t", "value").alias("r")))
    order = W.partitionBy(*keys).orderBy("t", F.col("event_id").isNotNull(), "event_id")
    back = W.partitionBy(*keys).orderBy(F.col("t").desc(), F.col("event_id").isNotNull(), "event_id")
    both = both.withColumns({"before": F.last("r", True).over(order), "after": F.last("r", True).over(back)}).where("event_id is not null")
    gap = lambda c: F.abs(F.col("t") - F.col(f"{c}.t"))
    pick = F.when(F.col("after").isNull() | (gap("before") <= gap("after")), F.col("before")).otherwise(F.col("after"))
    both = both.withColumn("pick", pick)
    near = F.abs(F.col("t") - F.col("pick.t")) <= tolerance
    return both.select(*keys, "event_id", F.when(near, F.col("pick.t")).alias("near_t"), F.when(near, F.col("pick.value")).alias("near_value"))


def interpolated(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("star",)) -> DataFrame:
    """event_id and the value of ``right`` (t, value) at ``left``'s times on straight lines, level beyond both ends."""
    both = left.select(*keys, "event_id", "t", F.lit(None).cast("struct<t:double,value:double>").alias("r")).unionByName(right.select(*keys, F.lit(None).cast("long").alias("event_id"), "t", F.struct("t", "value").alias("r")))
    order = W.partitionBy(*keys).orderBy("t", F.col("event_id").isNotNull(), "event_id")
    back = W.partitionBy(*keys).orderBy(F.col("t").desc(), F.col("event_id").isNotNull(), "event_id")
    both = both.withColumns({"a": F.last("r", True).over(order), "b": F.last("r", True).over(back)}).where("event_id is not null")
    line = F.col("a.value") + (F.col("b.value") - F.col("a.value")) * (F.col("t") - F.col("a.t")) / F.nullif(F.col("b.t") - F.col("a.t"), F.lit(0.0))
    return both.select(*keys, "event_id", F.coalesce(line, F.col("a.value"), F.col("b.value")).alias("value"))


def nearest_rank(values: Column, share: float) -> Column:
    """The value whose place among the sorted ones is nearest to ``share``, halves upward."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.lit(share) * (F.size(s) - 1) + 0.5).cast("int"))


def upper_median(values: Column) -> Column:
    """The middle value, the higher of two."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def depth_snr(d: DataFrame, period: float, t0: float, duration: float, keys: tuple[str, ...] = ("star",)) -> DataFrame:
    """depth (median outside less mean inside), n_epochs with rows inside, and the depth over the robust scatter outside and the root of the epochs."""
    away = F.pmod(F.col("t") - t0 + period / 2, F.lit(period)) - period / 2
    d = d.withColumns({"_in": F.abs(away) < duration / 2, "_out": F.abs(away) >= duration, "_epoch": F.floor((F.col("t") - t0) / period + 0.5)})
    medians = d.groupBy(*keys).agg(F.median(F.when(F.col("_out"), F.col("flux"))).alias("level"))
    s = d.join(medians, list(keys)).groupBy(*keys).agg(
        F.max("level").alias("level"),
        F.avg(F.when(F.col("_in"), F.col("flux"))).alias("inside"),
        F.count_distinct(F.when(F.col("_in"), F.col("_epoch"))).alias("n_epochs"),
        (F.lit(1.4826) * F.median(F.when(F.col("_out"), F.abs(F.col("flux") - F.col("level"))))).alias("sigma"),
    )
    depth = F.col("level") - F.col("inside")
    return s.where("n_epochs > 0 and sigma > 0").select(*keys, depth.alias("depth"), "n_epochs", (depth / F.col("sigma") * F.sqrt("n_epochs")).alias("snr"))


def over_dispersion(e: DataFrame, keys: tuple[str, ...] = ("star",)) -> DataFrame:
    """Root of the reduced chi-square of depths within odd and even epochs about their own means, at least 1."""
    e = e.withColumn("parity", F.pmod("epoch", F.lit(2)))
    w = 1 / (F.col("err") * F.col("err"))
    means = e.groupBy(*keys, "parity").agg((F.sum(F.col("depth") * w) / F.sum(w)).alias("mean"), F.count("*").alias("n"))
    chi = e.join(means.where("n >= 2"), [*keys, "parity"]).groupBy(*keys, "parity", "n").agg(F.sum((F.col("depth") - F.col("mean")) * (F.col("depth") - F.col("mean")) * w).alias("chi"))
    scale = chi.groupBy(*keys).agg(F.greatest(F.lit(1.0), F.sqrt(F.sum("chi") / F.sum(F.col("n") - 1))).alias("scale"))
    return e.select(*keys).distinct().join(scale, list(keys), "left").select(*keys, F.coalesce("scale", F.lit(1.0)).alias("scale"))


def normal_tail(z: Column) -> Column:
    """Chance of a normal value above ``z``, by Zelen and Severo's fit (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    above = F.exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, above).otherwise(1 - above)


def chi_square_tail(chi: Column, dof: Column, most: int = 200) -> Column:
    """Chance of a chi-square of at least ``chi``.

    A finite sum of up to ``most`` terms for whole degrees of freedom, after the normal tail for odd
    ones; beyond twice as many degrees Wilson and Hilferty's cube root, whose error there is below 2e-4.
    """
    half, x = chi / 2, F.sqrt(chi)
    terms = lambda first, start, count: F.aggregate(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), F.struct(first.alias("t"), first.alias("s")), lambda a, i: F.struct((a["t"] * half / (i + start)).alias("t"), (a["s"] + a["t"] * half / (i + start)).alias("s")), lambda a: a["s"])
    whole = F.least(F.floor(dof / 2).cast("int"), F.lit(most))
    even = F.exp(-half) * terms(F.lit(1.0), F.lit(0.0), whole - 1)
    normal = normal_tail(x)
    odd = 2 * normal + F.when(dof > 1, F.exp(-half) * terms(x * 0.7978845608028654, F.lit(0.5), whole - 1)).otherwise(0.0)
    cube = (F.cbrt(chi / dof) - (1 - 2 / (9 * dof))) / F.sqrt(2 / (9 * dof))
    return F.when(dof > 2 * most, normal_tail(cube)).when(F.pmod(dof, F.lit(2)) == 0, even).otherwise(odd)


def sector_consistency(s: DataFrame, keys: tuple[str, ...] = ("star",)) -> DataFrame:
    """chi, dof, p and spread of the depths of a star's sectors (depth, err), where it has two or more."""
    w = 1 / (F.col("err") * F.col("err"))
    mean = s.groupBy(*keys).agg((F.sum(F.col("depth") * w) / F.sum(w)).alias("mean"), F.count("*").alias("n")).where("n > 1")
    out = s.join(mean, list(keys)).groupBy(*keys, "mean", "n").agg(F.sum((F.col("depth") - F.col("mean")) * (F.col("depth") - F.col("mean")) * w).alias("chi"), (F.max("depth") - F.min("depth")).alias("range"))
    dof = F.col("n") - 1
    return out.select(*keys, "chi", dof.alias("dof"), chi_square_tail(F.col("chi"), dof).alias("p"), (F.col("range") / F.greatest(F.abs("mean"), F.lit(1e-9))).alias("spread"))


def event_pairs(events: DataFrame, keys: tuple[str, ...] = ("star",)) -> DataFrame:
    """Pairs of a star's dips (event_id, sector, depth, err, duration) in different sectors that may belong together. A star has few dips: those that a search has kept."""
    fields = ["event_id", "sector", "depth", "err", "duration"]
    a, b = (events.select(*keys, F.struct(*fields).alias(x)) for x in "ab")
    like = pairable(F.col("a.depth"), F.col("a.err"), F.col("a.duration"), F.col("b.depth"), F.col("b.err"), F.col("b.duration"))
    return a.join(b, list(keys)).where((F.col("a.event_id") < F.col("b.event_id")) & (F.col("a.sector") != F.col("b.sector")) & like).select(*keys, F.col("a.event_id").alias("first_id"), F.col("b.event_id").alias("second_id"))


def merged_checks(checks: DataFrame, keys: list[str]) -> DataFrame:
    """One check a name over several dips: fails if one fails, null if one could not run, else passes with the least margin."""
    failed, open_ = F.max(F.when(~F.col("passed"), 1).otherwise(0)), F.max(F.when(F.col("passed").isNull(), 1).otherwise(0))
    m = checks.groupBy(*keys, "name").agg(failed.alias("failed"), open_.alias("open"), F.min("margin").alias("least"))
    return m.select(*keys, "name", F.when(F.col("failed") == 1, False).when(F.col("open") == 1, None).otherwise(True).alias("passed"), F.when(F.col("failed") == 1, 0.0).when(F.col("open") == 0, F.col("least")).alias("margin"))


def claimable(work: DataFrame, ledger: DataFrame, keys: list[str], most: int = MAX_ATTEMPTS) -> DataFrame:
    """``work`` (keys, sectors_key) that may be claimed, with the attempt it will be: new work, failed work with attempts left, finished work whose sectors have changed. A row a key, so one claim each."""
    old = ledger.select(*keys, "status", F.col("sectors_key").alias("old_key"), "attempts")
    j = work.dropDuplicates(keys).join(old, keys, "left")
    again = (F.col("status") == "failed") & (F.col("attempts") < most)
    changed = (F.col("status") == "done") & (F.col("old_key") != F.col("sectors_key"))
    return j.where(F.col("status").isNull() | again | changed).select(*keys, "sectors_key", F.when(again, F.col("attempts") + 1).otherwise(1).alias("attempt"))


def recovered(ledger: DataFrame) -> DataFrame:
    """Rows that a crash left running are failed again and keep their attempt."""
    lost = F.col("status") == "running"
    return ledger.withColumns({"attempts": F.when(lost, F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts")), "status": F.when(lost, "failed").otherwise(F.col("status"))})


def failures_since_change(log: DataFrame, key: str, at: list[str], state: str, failed: str) -> DataFrame:
    """Failures of each key since its ``state`` last changed: a new state begins at none."""
    w = W.partitionBy(key).orderBy(*at)
    d = log.withColumn("_new", F.coalesce((F.col(state) != F.lag(state).over(w)).cast("int"), F.lit(1)))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = d.groupBy(key, "_run").agg(F.count_if(F.col(failed)).alias("n"), F.first(state).alias(state))
    return runs.groupBy(key).agg(F.max_by(F.struct(state, "n"), "_run").alias("l")).select(key, f"l.{state}", F.col("l.n").alias("failures"))
