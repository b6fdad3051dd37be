"""Operators on pixel series (star, frame, t, row, col, flux): frames, noise, difference images, offsets.

A pixel's frames are grouped or sorted by (star, row, col), so work spreads over pixels of all stars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Prior weights of the target, easy and hard neighbours and elsewhere; least error in pixels.
W_TARGET, W_EASY, W_HARD, W_ELSEWHERE, FLOOR_PX = 1.0, 0.25, 0.05, 1.0, 0.1
#: Inside: part of a duration from the middle. Outside: from INNER durations on, over a duration or LEAST_SIDE days.
INSIDE, INNER, LEAST_SIDE = 0.4, 0.75, 0.05
#: Fixed value: the default mask of frames' public quality flags; frames with any of them are left out.
BAD_BITS = 220335
PIXEL = ("star", "row", "col")


def good_frames(p: DataFrame, bad_bits: int = BAD_BITS) -> DataFrame:
    """star, frame of frames with a finite time, no ``bad_bits`` and more than half of their pixels finite."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    g = p.where(finite("t") & (F.col("quality").bitwiseAND(F.lit(bad_bits)) == 0))
    return g.groupBy("star", "frame").agg(F.count_if(finite("flux")).alias("n"), F.count("*").alias("all")).where("n > 0.5 * all").select("star", "frame")


def frame_noise(p: DataFrame) -> DataFrame:
    """Variance of one frame in each pixel: robust sigma of the steps between neighbouring frames, over the root of two."""
    d = p.withColumn("step", F.col("flux") - F.lag("flux").over(W.partitionBy(*PIXEL).orderBy("t", "frame"))).where("step is not null")
    d = d.withColumn("mid", F.median("step").over(W.partitionBy(*PIXEL)))
    sigma = F.lit(1.4826) * F.median(F.abs(F.col("step") - F.col("mid"))) / F.sqrt(F.lit(2.0))
    return d.groupBy(*PIXEL).agg(sigma.alias("sigma")).select(*PIXEL, (F.col("sigma") * F.col("sigma")).alias("var"))


def difference_images(p: DataFrame, noise: DataFrame, period: float, t0: float, duration: float, many: int = 6) -> DataFrame:
    """star, row, col, n_transits, diff, var: mean over transits of (before + after) / 2 - inside.

    A transit counts where it has frames inside and on both sides. With ``many`` transits or more the
    variance is scaled up to the scatter between transits, by the star's median ratio of both.
    """
    away = F.pmod(F.col("t") - t0 + period / 2, F.lit(period)) - period / 2
    d = p.withColumns({"away": away, "epoch": F.floor((F.col("t") - t0) / period + 0.5)})
    inner = INNER * duration
    outer = min(inner + max(duration, LEAST_SIDE), period / 2)
    parts = {"i": F.abs("away") < INSIDE * duration, "b": (F.col("away") <= -inner) & (F.col("away") >= -outer), "a": (F.col("away") >= inner) & (F.col("away") <= outer)}
    sums = [f(F.when(c, F.col("flux"))).alias(f"{name}_{k}") for k, c in parts.items() for name, f in (("m", F.avg), ("n", F.count))]
    e = d.groupBy(*PIXEL, "epoch").agg(*sums).where("n_i > 0 and n_b > 0 and n_a > 0").join(noise, list(PIXEL))
    e = e.select(*PIXEL, ((F.col("m_b") + F.col("m_a")) / 2 - F.col("m_i")).alias("diff"), (F.col("var") * (1 / F.col("n_i") + 0.25 / F.col("n_b") + 0.25 / F.col("n_a"))).alias("v"))
    k = F.col("n_transits")
    g = e.groupBy(*PIXEL).agg(F.count("*").alias("n_transits"), F.avg("diff").alias("diff"), F.sum("v").alias("v"), F.var_samp("diff").alias("s2")).withColumn("var", F.col("v") / (k * k))
    ratio = g.where(k >= many).where("var > 0").groupBy("star").agg(F.median(F.col("s2") / k / F.col("var")).alias("ratio"))
    return g.join(ratio, "star", "left").select(*PIXEL, "n_transits", "diff", (F.col("var") * F.when(k >= many, F.greatest(F.lit(1.0), F.coalesce("ratio", F.lit(1.0)))).otherwise(1.0)).alias("var"))


def squared_distance(e: Column, n: Column, ee: Column, en: Column, nn: Column) -> Column:
    """(e, n) times the inverse of ((ee, en), (en, nn)) times (e, n)."""
    return (nn * e * e - 2 * en * e * n + ee * n * n) / (ee * nn - en * en)


def sums_in_order(d: DataFrame, values: dict[str, Column]) -> DataFrame:
    """star, sectors (rows) and the sum of each value without its nulls, terms ascending: the shuffle doesn't decide the last bits, on which ties hang. A star's sectors are few."""
    g = d.groupBy("star").agg(F.count("*").alias("sectors"), *[F.array_sort(F.collect_list(v)).alias(k) for k, v in values.items()])
    return g.withColumns({k: F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0), lambda total, v: total + v)) for k in values})


def combined_offsets(s: DataFrame) -> DataFrame:
    """star, n, e, n_off, ee, en, nn, chi2: a star's offsets (e, n, covariance ee, en, nn) weighted by their inverse covariances, errors widened where they disagree."""
    det = F.col("ee") * F.col("nn") - F.col("en") * F.col("en")
    s = s.withColumns({"a": F.col("nn") / det, "b": -F.col("en") / det, "c": F.col("ee") / det})
    x, y = F.col("a") * F.col("e") + F.col("b") * F.col("n"), F.col("b") * F.col("e") + F.col("c") * F.col("n")
    own = F.col("e") * x + F.col("n") * y
    g = sums_in_order(s, {**{k: F.col(k) for k in "abc"}, "x": x, "y": y, "own": own})
    full = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    g = g.withColumns({"ee": F.col("c") / full, "en": -F.col("b") / full, "nn": F.col("a") / full})
    g = g.withColumns({"e": F.col("ee") * F.col("x") + F.col("en") * F.col("y"), "n": F.col("en") * F.col("x") + F.col("nn") * F.col("y")})
    left = F.greatest(F.col("own") - F.col("e") * F.col("x") - F.col("n") * F.col("y"), F.lit(0.0))
    g = g.withColumn("chi2", F.when(F.col("sectors") > 1, left / (2 * (F.col("sectors") - 1))).otherwise(1.0))
    wide = F.greatest(F.lit(1.0), F.col("chi2"))
    return g.select("star", "sectors", "e", "n", *[(F.col(k) * wide).alias(k) for k in ("ee", "en", "nn")], "chi2")


def on_target_probability(c: DataFrame, neighbours: DataFrame, scale: float) -> DataFrame:
    """star, p: the target's share of the weight of all places an offset may come from; neighbours (star, at_e, at_n, needed) count if they need a depth of one at most."""
    floor = (FLOOR_PX * scale) ** 2
    like = lambda e, n: F.exp(-squared_distance(e, n, F.col("ee") + floor, F.col("en"), F.col("nn") + floor) / 2)
    j = neighbours.where("needed <= 1").join(c, "star")
    w = F.when(F.col("needed") <= 0.5, W_EASY).otherwise(W_HARD) * like(F.col("e") - F.col("at_e"), F.col("n") - F.col("at_n"))
    others = j.groupBy("star").agg(F.sum(w).alias("others"))
    target = W_TARGET * like(F.col("e"), F.col("n"))
    return c.join(others, "star", "left").select("star", (target / (target + W_ELSEWHERE * F.exp(F.lit(-4.5)) + F.coalesce("others", F.lit(0.0)))).alias("p"))
