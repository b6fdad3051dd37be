"""Where on the sky light goes missing: point sources fitted to pixel stamps, offsets on the sky, neighbours and a verdict.

A stamp is one star's cutout in one sector. Its pixels are grouped to one row of arrays before the
fit, so work spreads over stamps, and what a task holds follows the cutout's size. Fits are made for
many stamps at once in one array program; offsets, errors, neighbours and verdicts are columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.operators.kernels import spread_out
from starloom.operators.pixels import combined_offsets, squared_distance, sums_in_order

STAMP = ("star", "sector")
#: Points a side of a pixel at which a profile is read; share of a pixel's light that counts as error of its model.
POINTS, MODEL_ERROR = 5, 0.02
#: Least signal to noise of a dip in a sector, error of a centroid on each axis in pixels.
DETECT_SNR, SECTOR_FLOOR_PX = 5.0, 0.05
#: A place is excluded from so many sigmas and pixels on; neighbours listed (arcsec).
EXCLUDED_SIGMA, EXCLUDED_PX, NEIGHBOUR_RADIUS = 3.0, 0.3, 150.0
#: Neighbours in the scene are fainter by less than so many magnitudes, so many of them, and so near the cutout (pixels).
SCENE_MAGNITUDES, SCENE_STARS, SCENE_MARGIN = 5.0, 60, 4.0
#: Limits of the common shift and of a profile's sigma in pixels, sigmas to begin with, neighbours to begin a centroid at.
MOST_SHIFT, SIGMAS, FIRST_SIGMAS, FIRST_NEIGHBOURS = 1.5, (0.3, 3.0), (0.7, 1.1), 6
#: Stamps fitted at once.
BATCH = 64

_at = (np.arange(POINTS) + 0.5) / POINTS - 0.5
SUB_X, SUB_Y = np.tile(_at, POINTS), np.repeat(_at, POINTS)


def profile(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, ratio: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Light of sources in each pixel and its slopes by x, y and the shape: (6, stamps, pixels).

    Pixels are (stamps, pixels), sources (stamps, sources) with their ``ratio`` of light. A shape
    (a, b, c) is exp(-((a dx + b dy)^2 + (c dy)^2) / 2), any elliptical normal profile with no angle
    that a round one leaves open; a pixel is the mean over its POINTS x POINTS points.
    """
    a, b, c = (shape[:, i, None, None] for i in range(3))
    out = np.zeros((6, *px.shape))
    for s in range(x.shape[1]):
        dx, dy = px[:, :, None] + SUB_X - x[:, s, None, None], py[:, :, None] + SUB_Y - y[:, s, None, None]
        u, v = a * dx + b * dy, c * dy
        g = np.exp(-0.5 * (u * u + v * v)) * (ratio[:, s, None, None] * a * c / (2 * np.pi * POINTS**2))
        for i, slope in enumerate((1.0, u * a, u * b + v * c, 1 / a - u * dx, -u * dy, 1 / c - v * dy)):
            out[i] += (g * slope).sum(axis=2)
    return out


def fitted(model, p: np.ndarray, low: np.ndarray, high: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters within bounds that minimise the weighted squares, damped steps for all items at once; their costs and normal matrices.

    ``model(p, item)`` gives values (items, points) and slopes (items, points, parameters) of the items
    of the numbers ``item``; settled ones aren't worked on further. A parameter at a bound whose step
    leads outside stands still. A worse step is taken back and damped more.
    """
    low, high = (np.broadcast_to(b, p.shape) for b in (low, high))
    item, each = np.arange(len(p)), np.arange(p.shape[1])
    values, slopes = model(p, item)
    cost = ((w * (y - values)) ** 2).sum(axis=1)
    every = p.copy(), cost.copy(), slopes
    damp = np.full(len(p), 1e-3)
    for _ in range(rounds):
        lo, hi, y1, w1 = low[item], high[item], y[item], w[item]
        j = slopes * w1[:, :, None]
        normal, down = np.einsum("bpi,bpj->bij", j, j), np.einsum("bpi,bp->bi", j, w1 * (y1 - values))
        held = ((p <= lo) & (down < 0)) | ((p >= hi) & (down > 0))
        normal = np.where(held[:, :, None] | held[:, None, :], 0.0, normal)
        size = normal[:, each, each]
        normal[:, each, each] = np.where(size > 0, size * (1 + damp[:, None]), 1.0)
        step = np.linalg.solve(normal, np.where(held, 0.0, down)[:, :, None])[:, :, 0]
        new = np.clip(p + step, lo, hi)
        new_values, new_slopes = model(new, item)
        new_cost = ((w1 * (y1 - new_values)) ** 2).sum(axis=1)
        better = new_cost <= cost
        done = (better & (cost - new_cost <= 1e-12 * cost)) | (damp > 1e9)
        damp = np.where(better, np.maximum(damp / 10, 1e-9), damp * 10)
        p, cost = np.where(better[:, None], new, p), np.where(better, new_cost, cost)
        values, slopes = np.where(better[:, None], new_values, values), np.where(better[:, None, None], new_slopes, slopes)
        for out, now in zip(every, (p, cost, slopes)):
            out[item] = now
        left = ~done
        if not left.any():
            break
        if done.any():
            item, p, cost, values, slopes, damp = (a[left] for a in (item, p, cost, values, slopes, damp))
    j = every[2] * w[:, :, None]
    return every[0], every[1], np.einsum("bpi,bpj->bij", j, j)


def covariance(normal: np.ndarray, wide: np.ndarray, instead: np.ndarray) -> np.ndarray:
    """Inverses of the normal matrices times ``wide``; the diagonal ``instead`` for one without an inverse."""
    size = np.sqrt(np.maximum(np.einsum("bii->bi", normal), 1e-300))
    scaled = normal / size[:, :, None] / size[:, None, :]
    sound = np.linalg.eigvalsh(scaled)[:, 0] > 1e-12
    inverse = np.linalg.inv(np.where(sound[:, None, None], scaled, np.eye(normal.shape[1]))) / size[:, :, None] / size[:, None, :]
    return np.where(sound[:, None, None], inverse * wide[:, None, None], np.diag(instead))


def of_light(template: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(light, background) by weighted squares for a fixed template; zero where they aren't determined."""
    w2 = w * w
    tt, t1, one, ty, y1 = ((w2 * a).sum(axis=1) for a in (template * template, template, np.ones_like(y), template * y, y))
    det = tt * one - t1 * t1
    safe = np.where(det > 1e-12 * np.maximum(tt * one, 1e-300), det, np.inf)
    return np.stack([(ty * one - y1 * t1) / safe, (tt * y1 - t1 * ty) / safe], axis=1)


def fit_scene(px, py, image, var, x, y, ratio):
    """The scene before and after a dip: light times (target + neighbours by their ratios) + background, at a common shift.

    Column 0 of ``x``, ``y``, ``ratio`` is the target. Returns parameters (shift x, y, shape a, b, c,
    light, background), their covariance widened by the reduced chi-square, and that.
    """
    good = np.isfinite(image) & np.isfinite(var) & (var > 0)
    image = np.where(good, image, 0.0)
    w = np.where(good, 1 / np.sqrt(np.where(good, var, 1.0) + (MODEL_ERROR * image) ** 2), 0.0)

    def model(p, i):
        m = profile(px[i], py[i], x[i] + p[:, :1], y[i] + p[:, 1:2], ratio[i], p[:, 2:5])
        light = p[:, 5, None]
        return light * m[0] + p[:, 6, None], np.stack([*(light * m[1:]), m[0], np.ones_like(m[0])], axis=2)

    low = np.array([-MOST_SHIFT, -MOST_SHIFT, 1 / SIGMAS[1], -1 / SIGMAS[0], 1 / SIGMAS[1], -np.inf, -np.inf])
    high = np.array([MOST_SHIFT, MOST_SHIFT, 1 / SIGMAS[0], 1 / SIGMAS[0], 1 / SIGMAS[0], np.inf, np.inf])
    best = None
    for sigma in FIRST_SIGMAS:
        p = np.zeros((len(px), 7))
        p[:, [2, 4]] = 1 / sigma
        p[:, 5:] = of_light(profile(px, py, x, y, ratio, p[:, 2:5])[0], image, w)
        found = fitted(model, p, low, high, image, w)
        best = found if best is None else [np.where((found[1] < best[1]).reshape(-1, *[1] * (f.ndim - 1)), f, b) for f, b in zip(found, best)]
    p, cost, normal = best
    chi2 = cost / np.maximum(good.sum(axis=1) - 8, 1)
    return p, covariance(normal, np.maximum(chi2, 1.0), np.array([0.25] * 7)), chi2, good.sum(axis=1)


def fit_difference(px, py, diff, var, shape, starts_x, starts_y):
    """One source of a known shape and a background in a difference image, from each start and from the highest pixel over its error; the best of them.

    Starts outside the cutout don't count (NaN: none). Returns parameters (x, y, light, background),
    covariance, reduced chi-square and pixels used.
    """
    good = np.isfinite(diff) & np.isfinite(var) & (var > 0)
    diff = np.where(good, diff, 0.0)
    w = np.where(good, 1 / np.sqrt(np.where(good, var, 1.0)), 0.0)
    ends = [f(np.where(np.isfinite(c), c, np.nan), axis=1) for c in (px, py) for f in (np.nanmin, np.nanmax)]
    peak = (diff * w).argmax(axis=1)
    row = np.arange(len(px))
    xs, ys = (np.column_stack([s, c[row, peak]]) for s, c in ((starts_x, px), (starts_y, py)))
    usable = (xs >= ends[0][:, None]) & (xs <= ends[1][:, None]) & (ys >= ends[2][:, None]) & (ys <= ends[3][:, None])
    item, start = np.nonzero(usable)
    px2, py2, y2, w2, shape2, one = px[item], py[item], diff[item], w[item], shape[item], np.ones((len(item), 1))

    def model(p, i):
        m = profile(px2[i], py2[i], p[:, :1], p[:, 1:2], one[i], shape2[i])
        return p[:, 2, None] * m[0] + p[:, 3, None], np.stack([p[:, 2, None] * m[1], p[:, 2, None] * m[2], m[0], np.ones_like(m[0])], axis=2)

    p = np.column_stack([xs[item, start], ys[item, start], np.zeros((len(item), 2))])
    p[:, 2:] = of_light(profile(px2, py2, p[:, :1], p[:, 1:2], one, shape2)[0], y2, w2)
    none = np.full(len(item), np.inf)
    low = np.column_stack([ends[0][item] - 2, ends[2][item] - 2, -none, -none])
    high = np.column_stack([ends[1][item] + 2, ends[3][item] + 2, none, none])
    p, cost, normal = fitted(model, p, low, high, y2, w2)
    first = pd.Series(cost).groupby(item).idxmin().to_numpy()
    chi2 = cost[first] / np.maximum(good.sum(axis=1) - 4, 1)
    return p[first], covariance(normal[first], np.maximum(chi2, 1.0), np.array([1e6, 1e6, 1e12, 1e12])), chi2, good.sum(axis=1)


def padded(lists, fill: float) -> np.ndarray:
    """Rows of equal length from lists; null is NaN."""
    lists = [np.asarray([] if v is None else v, dtype=float) for v in lists]
    out = np.full((len(lists), max([1, *map(len, lists)])), fill)
    for row, v in zip(out, lists):
        row[: len(v)] = v
    return out


FITS = "dx double, dy double, sigma_major double, sigma_minor double, light double, background double, scene_chi2 double, sxx double, sxy double, syy double, x_fit double, y_fit double, dxx double, dxy double, dyy double, lost double, lost_err double, diff_chi2 double, x_from double, x_to double, y_from double, y_to double"


def fit_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Fits of rows with arrays px, py, oot, oot_var, diff, diff_var and scene sources at_x, at_y, at_ratio."""
    px, py = (padded(pdf[c], np.nan) for c in ("px", "py"))
    there = np.isfinite(px)
    images = [np.where(there, padded(pdf[c], np.nan), np.nan) for c in ("oot", "oot_var", "diff", "diff_var")]
    ends = [f(c, axis=1) for c in (px, py) for f in (np.nanmin, np.nanmax)]
    px0, py0 = np.where(there, px, ends[0][:, None]), np.where(there, py, ends[2][:, None])
    at = [np.column_stack([pdf[t].to_numpy(float), padded(pdf[n], 0.0)]) for t, n in (("x", "at_x"), ("y", "at_y"))]
    ratio = np.column_stack([np.ones(len(pdf)), padded(pdf["at_ratio"], 0.0)])
    p, cov, chi2, n = fit_scene(px0, py0, *images[:2], *at, ratio)
    starts = [np.where(ratio > 0, c + p[:, i, None], np.nan)[:, : 1 + FIRST_NEIGHBOURS] for i, c in enumerate(at)]
    d, dcov, dchi2, dn = fit_difference(px0, py0, *images[2:], p[:, 2:5], *starts)
    a, b, c = p[:, 2:5].T
    inverse = np.moveaxis(np.array([[a * a, a * b], [a * b, b * b + c * c]]), 2, 0)
    sigmas = 1 / np.sqrt(np.maximum(np.linalg.eigvalsh(inverse), 1e-12))
    scene = np.column_stack([p[:, :2], sigmas, p[:, 5:], chi2, cov[:, 0, 0], cov[:, 0, 1], cov[:, 1, 1]])
    lost = np.column_stack([d[:, :2], dcov[:, 0, 0], dcov[:, 0, 1], dcov[:, 1, 1], d[:, 2], np.sqrt(dcov[:, 2, 2]), dchi2])
    scene[n < 7], lost[(dn < 4) | (n < 7)] = np.nan, np.nan
    names = [f.split()[0] for f in FITS.split(", ")]
    return pd.DataFrame(np.column_stack([scene, lost, *ends]), columns=names)


def brightest_in_scene(neighbours: DataFrame, stamps: DataFrame) -> DataFrame:
    """star, sector, at_x, at_y, at_ratio: the SCENE_STARS brightest neighbours (x, y, ratio of light to the target's, id) in or near the cutout, brightest first; equal ones by id."""
    n = neighbours.where(F.col("ratio") > 10 ** (-0.4 * SCENE_MAGNITUDES)).join(stamps.select(*STAMP, "x_from", "x_to", "y_from", "y_to"), list(STAMP))
    near = [F.col(c).between(F.col(f"{c}_from") - SCENE_MARGIN, F.col(f"{c}_to") + SCENE_MARGIN) for c in "xy"]
    n = n.where(near[0] & near[1]).withColumn("_k", F.row_number().over(W.partitionBy(*STAMP).orderBy(F.desc("ratio"), "id"))).where(F.col("_k") <= SCENE_STARS)
    g = n.groupBy(*STAMP).agg(F.array_sort(F.collect_list(F.struct("_k", "x", "y", "ratio"))).alias("s"))
    return g.select(*STAMP, F.col("s.x").alias("at_x"), F.col("s.y").alias("at_y"), F.col("s.ratio").alias("at_ratio"))


def centroid_fits(images: DataFrame, targets: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``targets`` (star, sector, x, y: pixel of the catalogue's place) with the fits of their stamps (FITS).

    ``images``: star, sector, row, col, oot, oot_var, diff, diff_var, a row for each pixel; null and
    non-finite pixels don't count. ``neighbours``: star, sector, id, x, y, ratio. A stamp with fewer
    usable pixels than parameters, or without a place for its target, has null fits; one without
    pixels or target gives no row.
    """
    pixel = F.struct(F.col("row").cast("double").alias("py"), F.col("col").cast("double").alias("px"), *[F.col(c).cast("double").alias(c) for c in ("oot", "oot_var", "diff", "diff_var")])
    s = images.where("row is not null and col is not null").groupBy(*STAMP).agg(F.array_sort(F.collect_list(pixel)).alias("s"))
    s = s.select(*STAMP, *[F.col(f"s.{c}").alias(c) for c in ("px", "py", "oot", "oot_var", "diff", "diff_var")])
    ends = [f(c).alias(f"{a}_{e}") for a, c in (("x", "px"), ("y", "py")) for e, f in (("from", F.array_min), ("to", F.array_max))]
    rows = s.join(brightest_in_scene(neighbours, s.select(*STAMP, *ends)), list(STAMP), "left").join(targets, list(STAMP))
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in targets.schema]
    own = [c for c in targets.columns if c not in ("px", "py")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for begin in range(0, len(pdf), BATCH):
                part = pdf.iloc[begin : begin + BATCH].reset_index(drop=True)
                placed = part["x"].notna() & part["y"].notna()
                fits = fit_rows(part.fillna({"x": 0.0, "y": 0.0}))
                fits.loc[~placed, [c for c in fits if c[1:] not in ("_from", "_to")]] = np.nan
                yield pd.concat([part[own], fits], axis=1)

    out = spread_out(rows, *STAMP).mapInPandas(run, ", ".join(kept) + ", " + FITS)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in [f.split()[0] for f in FITS.split(", ")]})


def sector_offsets(fits: DataFrame) -> DataFrame:
    """``fits`` with target_x, target_y, snr, depth, depth_err, detected, reason, scale (arcsec a pixel) and, where the dip is seen, e, n, ee, en, nn: the centroid's offset from the target in arcsec (east, north) and its covariance.

    ``fits`` needs the slopes of east and north by x and y: ex, ey, nx, ny.
    """
    f = fits.withColumns({
        "target_x": F.col("x") + F.col("dx"), "target_y": F.col("y") + F.col("dy"),
        "snr": F.when(F.col("lost_err") > 0, F.col("lost") / F.col("lost_err")).otherwise(F.when(F.col("lost").isNotNull(), 0.0)),
        "depth": F.when(F.col("light") > 0, F.col("lost") / F.col("light")), "depth_err": F.when(F.col("light") > 0, F.col("lost_err") / F.col("light")),
        "scale": F.sqrt(F.abs(F.col("ex") * F.col("ny") - F.col("ey") * F.col("nx"))),
    })
    seen = F.coalesce((F.col("lost") > 0) & (F.col("snr") >= DETECT_SNR) & (F.col("depth_err") > 0), F.lit(False))
    inside = F.col("x_fit").between(F.col("x_from"), F.col("x_to")) & F.col("y_fit").between(F.col("y_from"), F.col("y_to"))
    said = F.when(F.col("lost").isNull(), F.lit("too few usable pixels")).when(~seen, F.format_string("no dip in the difference image (SNR %.1f, %.0f needed)", "snr", F.lit(DETECT_SNR)))
    said = said.when(~inside, F.lit("the centroid lies off the cutout")).otherwise(F.format_string("dip at SNR %.1f", "snr"))
    x, y, floor = F.col("x_fit") - F.col("target_x"), F.col("y_fit") - F.col("target_y"), SECTOR_FLOOR_PX**2
    xx, xy, yy = F.col("dxx") + F.col("sxx") + floor, F.col("dxy") + F.col("sxy"), F.col("dyy") + F.col("syy") + floor
    c = F.col
    places = {"e": c("ex") * x + c("ey") * y, "n": c("nx") * x + c("ny") * y}
    places["ee"] = c("ex") * c("ex") * xx + 2 * c("ex") * c("ey") * xy + c("ey") * c("ey") * yy
    places["en"] = c("ex") * c("nx") * xx + (c("ex") * c("ny") + c("ey") * c("nx")) * xy + c("ey") * c("ny") * yy
    places["nn"] = c("nx") * c("nx") * xx + 2 * c("nx") * c("ny") * xy + c("ny") * c("ny") * yy
    f = f.withColumns({"detected": seen & inside, "reason": said})
    return f.withColumns({k: F.when(c("detected"), v) for k, v in places.items()})


def sigmas(e: Column, n: Column) -> Column:
    """Distance from the centroid in sigmas of its errors; rounding below zero counts as above."""
    return F.sqrt(F.abs(squared_distance(e, n, F.col("ee"), F.col("en"), F.col("nn"))))


def combined_sectors(offsets: DataFrame) -> DataFrame:
    """star, sectors, e, n, ee, en, nn, chi2, depth, depth_err, scale, offset, sigma over a star's sectors with a dip."""
    d = offsets.where("detected")
    w = 1 / (F.col("depth_err") * F.col("depth_err"))
    depth = sums_in_order(d, {"_w": w, "_wd": w * F.col("depth"), "_scale": F.col("scale"), "_scales": F.col("scale") * 0 + 1})
    depth = depth.select("star", (F.col("_wd") / F.col("_w")).alias("depth"), (1 / F.sqrt("_w")).alias("depth_err"), (F.col("_scale") / F.col("_scales")).alias("scale"))
    c = combined_offsets(d.select("star", "e", "n", "ee", "en", "nn")).join(depth, "star")
    return c.withColumns({"offset": F.hypot("e", "n"), "sigma": sigmas(F.col("e"), F.col("n"))})


def excluded(e: Column, n: Column) -> Column:
    """Whether a place at (e, n) from the centroid is ruled out: far in sigmas and in pixels."""
    return (sigmas(e, n) > EXCLUDED_SIGMA) & (F.hypot(e, n) > EXCLUDED_PX * F.col("scale"))


def neighbour_table(combined: DataFrame, neighbours: DataFrame) -> DataFrame:
    """star, id, sep, ratio, needed, distance_sigma, excluded, suspect of each neighbour (star, id, at_e, at_n, magnitudes fainter than the target) within NEIGHBOUR_RADIUS arcsec.

    needed: the eclipse that it would need to make the dip. Without a centroid nothing is judged, and none is suspect.
    """
    e, n = F.col("e") - F.col("at_e"), F.col("n") - F.col("at_n")
    t = neighbours.withColumn("sep", F.hypot("at_e", "at_n")).where(F.col("sep") <= NEIGHBOUR_RADIUS).join(combined, "star", "left")
    t = t.withColumns({"ratio": F.pow(F.lit(10.0), -0.4 * F.col("fainter")), "needed": F.col("depth") * F.pow(F.lit(10.0), 0.4 * F.col("fainter")), "distance_sigma": sigmas(e, n), "excluded": excluded(e, n)})
    return t.select("star", "id", "sep", "ratio", "needed", "distance_sigma", "excluded", F.coalesce((F.col("needed") <= 1) & ~F.col("excluded"), F.lit(False)).alias("suspect"))


def verdicts(offsets: DataFrame, combined: DataFrame, table: DataFrame) -> DataFrame:
    """star, verdict, reason: on target, possible neighbour, off target or inconclusive, for each star of ``offsets``."""
    s = table.where("suspect")
    named = F.format_string("%s (%.0f arcsec away) would need a %.1f%% eclipse", "id", "sep", 100 * F.col("needed"))
    near = s.withColumn("_k", F.row_number().over(W.partitionBy("star").orderBy("sep", "id"))).where("_k <= 3")
    near = near.groupBy("star").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_k", named.alias("s"))))["s"], "; ").alias("names"))
    count = s.groupBy("star").agg(F.count("*").alias("suspects"), F.min_by(F.format_string("%s, which would need a %.1f%% eclipse (%.1f sigma from it)", "id", 100 * F.col("needed"), "distance_sigma"), F.struct("distance_sigma", "id")).alias("match"))
    stars = offsets.groupBy("star").agg(F.max("snr").alias("best"), F.count("lost").alias("fitted"))
    j = stars.join(combined, "star", "left").join(near, "star", "left").join(count, "star", "left")
    away = excluded(F.col("e"), F.col("n"))
    j = j.withColumn("verdict", F.when(F.col("e").isNull(), "inconclusive").when(away, "off target").when(F.col("suspects") > 0, "possible neighbour").otherwise("on target"))
    place = F.format_string("%.1f arcsec (%.2f px, %.1f sigma)", "offset", F.col("offset") / F.col("scale"), "sigma")
    more = F.when(F.col("suspects") > 3, F.format_string(" (+%d more)", F.col("suspects") - 3)).otherwise("")
    reason = (
        F.when(F.col("fitted") == 0, F.lit("no usable pixel data around the transits"))
        .when(F.col("e").isNull(), F.format_string("no sector of %2$d shows the dip (best SNR %1$.1f), so it has no place", F.coalesce("best", F.lit(0.0)), "fitted"))
        .when(away, F.concat(F.lit("the light lost comes from "), place, F.lit(" off the target; "), F.coalesce(F.concat(F.lit("it matches "), F.col("match")), F.lit("no listed neighbour there is bright enough to cause it"))))
        .when(F.col("suspects") > 0, F.concat(F.lit("the centroid is consistent with the target, "), place, F.lit(", but neighbours near enough to share it remain: "), F.col("names"), more))
        .otherwise(F.concat(F.lit("the light lost comes from the target, "), place, F.lit(", and every neighbour able to make the dip is excluded")))
    )
    return j.select("star", "verdict", reason.alias("reason"))
