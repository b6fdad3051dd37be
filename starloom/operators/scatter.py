"""Scattered light, fits with clipped rows, boxes by phase and states of a running service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.operators.shared import checkpointed
from starloom.operators.signals import edge_mask, interpolated, normal_tail

#: Sigmas, sigmas an hour, days.
Z_HIGH, RATE_PER_H, SHOULDER_D = 3.0, 1.0, 0.5
LIVE_TIMEOUT_S, SLOT_S = 900, 20


def rates(d: DataFrame, hours: float = 1.0) -> DataFrame:
    """star, sector, t, value: the background's change an hour, by central differences between bins of ``hours``; nothing for a sector of fewer than three bins."""
    sector = W.partitionBy("star", "sector")
    b = d.withColumn("_first", F.min("t").over(sector))
    b = b.groupBy("star", "sector", F.floor((F.col("t") - F.col("_first")) * 24 / hours).alias("bin")).agg(F.avg("t").alias("t"), F.avg("bkg").alias("b"))
    o = sector.orderBy("t")
    b = b.withColumns({"n": F.count("*").over(sector), "b0": F.lag("b").over(o), "b1": F.lead("b").over(o), "hs": F.col("t") - F.lag("t").over(o), "hd": F.lead("t").over(o) - F.col("t")})
    hs, hd = F.col("hs"), F.col("hd")
    middle = (hs * hs * F.col("b1") + (hd * hd - hs * hs) * F.col("b") - hd * hd * F.col("b0")) / (hs * hd * (hs + hd))
    slope = F.when(hs.isNull(), (F.col("b1") - F.col("b")) / hd).when(hd.isNull(), (F.col("b") - F.col("b0")) / hs).otherwise(middle)
    return b.where("n >= 3").select("star", "sector", "t", (F.abs(slope) / 24).alias("value"))


def scattered_light(d: DataFrame, high: float = Z_HIGH, rate: float = RATE_PER_H, shoulder: float = SHOULDER_D, hours: float = 1.0, edge: float = 0.25, gap: float = 0.5) -> DataFrame:
    """Adds core (background above ``high`` or changing faster than ``rate`` an hour) and masked (within ``shoulder`` of a core row of the star, or at an edge). Rows need event_id, star, sector, t, bkg; a null background is no core row."""
    seen = d.where("bkg is not null and not isnan(bkg)")
    at = interpolated(seen, rates(seen, hours), ("star", "sector")).select("star", "sector", "event_id", F.col("value").alias("_rate"))
    d = d.join(at, ["star", "sector", "event_id"], "left")
    d = d.withColumn("core", F.coalesce((F.col("bkg") > high) & ~F.isnan("bkg"), F.lit(False)) | F.coalesce(F.col("_rate") > rate, F.lit(False))).drop("_rate")
    near = F.coalesce(F.expr(f"max(core) over (partition by star order by t range between {shoulder}D preceding and {shoulder}D following)"), F.lit(False))
    return edge_mask(d.withColumn("_near", near), edge, gap).withColumn("masked", F.col("masked") | F.col("_near")).drop("_near")


def clipped_quadratic(d: DataFrame, key: str, x: Column, y: Column, rounds: int = 5, limit: float = 3.0) -> DataFrame:
    """key, a, b, c, rms, clipped of y = a + b x + c x^2 in each group, refitted without rows ``limit`` robust sigmas off.

    A round is two grouped aggregates (power sums, then a median); its fits, a row a group, are cut
    from their lineage by checkpoint(), so plans don't grow with the rounds and no rows reach the
    driver. Groups whose sums have no single solution are left out.
    """
    d = d.select(key, x.cast("double").alias("x"), y.cast("double").alias("y")).where("x is not null and y is not null")
    r = F.col("y") - (F.col("a") + F.col("b") * F.col("x") + F.col("c") * F.col("x") * F.col("x"))
    det = "(s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2))"
    fit = None
    for _ in range(rounds):
        used = d if fit is None else d.join(fit, key).where(F.abs(r) < limit * F.col("s")).select(key, "x", "y")
        power = lambda k: F.pow("x", F.lit(float(k)))
        s = used.groupBy(key).agg(*[F.sum(power(k)).alias(f"s{k}") for k in range(5)], *[F.sum(power(k) * F.col("y")).alias(f"q{k}") for k in range(3)])
        new = s.where(f"abs({det}) > 1e-9").selectExpr(
            key,
            f"(q0*(s2*s4-s3*s3) - s1*(q1*s4-q2*s3) + s2*(q1*s3-q2*s2)) / {det} as a",
            f"(s0*(q1*s4-q2*s3) - q0*(s1*s4-s2*s3) + s2*(s1*q2-s2*q1)) / {det} as b",
            f"(s0*(s2*q2-s3*q1) - s1*(s1*q2-s2*q1) + q0*(s1*s3-s2*s2)) / {det} as c",
        )
        fit = checkpointed(used.join(new, key).groupBy(key, "a", "b", "c").agg((F.lit(1.4826) * F.median(F.abs(r))).alias("s")))
    near = F.abs(r) < limit * F.col("s")
    return d.join(fit, key).groupBy(key, "a", "b", "c").agg(F.stddev_pop(F.when(near, r)).alias("rms"), F.count_if(~near).alias("clipped"))


def phase_boxes(d: DataFrame, period: float, t0: float, duration: float, begin: float = 0.1, end: float = 0.9, least: int = 5) -> DataFrame:
    """star, box, phase, n, depth of boxes as wide as the transit at every half width between two phases, against the median off the transit. A row goes to the two boxes that hold it, so nothing is paired."""
    half = duration / period / 2
    away = F.pmod(F.col("t") - t0 + period / 2, F.lit(period)) - period / 2
    off = d.where(F.abs(away) >= 0.75 * duration).withColumn("ph", F.pmod((F.col("t") - t0) / period, F.lit(1.0)))
    off = off.withColumn("level", F.median("flux").over(W.partitionBy("star")))
    slot = F.floor((F.col("ph") - begin) / half)
    boxes = off.withColumn("box", F.explode(F.array(slot, slot + 1))).withColumn("phase", F.lit(begin) + F.col("box") * half)
    g = boxes.where((F.col("box") >= 0) & (F.col("phase") <= end + 1e-9)).groupBy("star", "box", "phase").agg(F.count("*").alias("n"), (F.first("level") - F.avg("flux")).alias("depth"))
    return g.where(F.col("n") >= least)


def secondary_eclipse(boxes: DataFrame, least: int = 20) -> DataFrame:
    """star, phase, depth, err, raw: the deepest box at phases 0.4 to 0.6 against the robust scatter of all boxes' depths, for stars with ``least`` boxes."""
    m = boxes.withColumn("_mid", F.median("depth").over(W.partitionBy("star")))
    near = F.col("phase").between(0.4 - 1e-9, 0.6 + 1e-9)
    g = m.groupBy("star").agg(F.count("*").alias("boxes"), (F.lit(1.4826) * F.median(F.abs(F.col("depth") - F.col("_mid")))).alias("err"), F.max_by(F.struct("phase", "depth"), F.when(near, F.struct("depth", -F.col("box")))).alias("b"))
    return g.where((F.col("boxes") >= least) & (F.col("err") > 0) & F.col("b").isNotNull()).select("star", "b.phase", "b.depth", "err", (F.col("b.depth") / F.col("err")).alias("raw"))


def normal_quantile(p: Column) -> Column:
    """x beyond which a normal value lies with chance ``p``, by halving -9 to 39; null for a chance of 0, 1 or null."""
    middle = lambda a: (a["low"] + a["high"]) / 2
    halve = lambda a, _: F.when(normal_tail(middle(a)) > p, F.struct(middle(a).alias("low"), a["high"].alias("high"))).otherwise(F.struct(a["low"].alias("low"), middle(a).alias("high")))
    ends = F.struct(F.lit(-9.0).alias("low"), F.lit(39.0).alias("high"))
    return F.when((p > 0) & (p < 1), F.aggregate(F.sequence(F.lit(1), F.lit(60)), ends, halve, middle))


#: A dip half way round counts from so many sigmas and so much of the transit's depth on; phases searched.
SECONDARY_SIGMA, SECONDARY_SHARE, SECONDARY_PHASES = 3.0, 0.1, 0.2


def secondary_verdict(s: DataFrame, share: Column, depth: Column) -> DataFrame:
    """``s`` of secondary_eclipse with places, nsig and passed: the deepest of so many independent boxes is judged by the chance that any of them gets there.

    ``share`` is the transit's duration over its period, ``depth`` its depth. A chance below all
    doubles leaves the plain ratio.
    """
    places = F.greatest(F.lit(1.0), F.lit(SECONDARY_PHASES) / share)
    one = F.least(normal_tail(F.col("raw")), F.lit(1 - 1e-16))
    any_of = -F.expm1(F.col("places") * F.log1p(-one))
    s = s.withColumn("places", places).withColumn("nsig", F.coalesce(normal_quantile(any_of), F.when(F.col("raw") > 0, F.col("raw")).otherwise(-9.0)))
    return s.withColumn("passed", ~((F.col("nsig") > SECONDARY_SIGMA) & (F.col("depth") / F.greatest(depth, F.lit(1e-12)) > SECONDARY_SHARE)))


def service_mode(runs: DataFrame, now: Column, timeout: int = LIVE_TIMEOUT_S, slot: int = SLOT_S) -> DataFrame:
    """run_id, mode, place: live while the run is running and was updated within ``timeout`` seconds; else replay at a star counted by slots of the server's time."""
    age = F.unix_timestamp(now) - F.unix_timestamp("updated_at")
    live = (F.col("state") == "running") & (age <= timeout)
    place = F.pmod(F.floor(F.unix_timestamp(now) / slot), F.nullif(F.col("stars"), F.lit(0).cast("long")))
    return runs.select("run_id", F.when(live, "live").otherwise("replay").alias("mode"), F.when(~live, place).alias("place"))


def responding(beats: DataFrame, now: Column, stale: int) -> DataFrame:
    """Adds responding: heard from within ``stale`` seconds; an idle runner counts from the start it has announced, if that is later."""
    quiet = F.when((F.col("state") == "idle") & F.col("next_run_at").isNotNull(), F.greatest("seen_at", "next_run_at")).otherwise(F.col("seen_at"))
    return beats.withColumn("responding", F.unix_timestamp(now) - F.unix_timestamp(quiet) <= stale)


def superseded(stored: DataFrame, items: DataFrame) -> DataFrame:
    """The queue (stem, run_id, source, status, attempts) after ``items`` (stem, run_id, source): new stems and changed sources are pending from the start, others keep their state."""
    i = items.dropDuplicates(["stem"]).select("stem", F.col("run_id").alias("_run"), F.col("source").alias("_source"))
    j = stored.join(i, "stem", "full")
    fresh = F.col("status").isNull() | F.coalesce(F.col("_source") != F.col("source"), F.lit(False))
    pick = lambda new, old: F.when(fresh, new).otherwise(F.col(old)).alias(old)
    return j.select("stem", pick(F.col("_run"), "run_id"), pick(F.col("_source"), "source"), pick(F.lit("pending"), "status"), pick(F.lit(0).cast("long"), "attempts"))
