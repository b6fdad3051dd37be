"""Fits on pixel stamps against planted scenes, plain searches and simulated noise."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom.functions import sky
from starloom.operators import centroids as ct

SIDE = 9
ROW, COL = (a.ravel().astype(float) for a in np.mgrid[0:SIDE, 0:SIDE])
SHAPE = np.array([[1 / 0.9, 0.25, 1 / 0.8]])
PLACED = {"ex": -21.0, "ey": 0.0, "nx": 0.0, "ny": 21.0}


def light(x, y):
    """One source, plainly: the mean of the profile over a pixel's points."""
    a, b, c = SHAPE[0]
    out = np.zeros(len(COL))
    for i, (px, py) in enumerate(zip(COL, ROW)):
        for ox in (-0.4, -0.2, 0.0, 0.2, 0.4):
            for oy in (-0.4, -0.2, 0.0, 0.2, 0.4):
                u, v = a * (px + ox - x) + b * (py + oy - y), c * (py + oy - y)
                out[i] += math.exp(-(u * u + v * v) / 2) * a * c / (2 * math.pi) / 25
    return out


def stamp(star, sector, dimming, depth=0.02, noise=1.0, seed=0, shift=(0.3, -0.2)):
    """Target at (4.2, 3.9) and a neighbour at (6.5, 4.4) with 0.3 of its light, both off by ``shift``; ``dimming`` loses ``depth`` of the target's light."""
    rng = np.random.default_rng(seed)
    at = [(4.2 + shift[0], 3.9 + shift[1]), (6.5 + shift[0], 4.4 + shift[1])]
    oot = 20000 * (light(*at[0]) + 0.3 * light(*at[1])) + 150 + rng.normal(0, noise, len(COL))
    diff = 20000 * depth * light(*(at[dimming] if isinstance(dimming, int) else dimming)) + rng.normal(0, noise, len(COL))
    return pd.DataFrame({"star": star, "sector": sector, "row": ROW.astype(int), "col": COL.astype(int), "oot": oot, "oot_var": noise**2, "diff": diff, "diff_var": noise**2})


def fits(spark, stamps, targets=None, neighbours=None):
    keys = stamps[["star", "sector"]].drop_duplicates()
    targets = keys.assign(x=4.2, y=3.9, **PLACED) if targets is None else targets
    neighbours = keys.assign(id="b", x=6.5, y=4.4, ratio=0.3) if neighbours is None else neighbours
    return ct.centroid_fits(*map(spark.createDataFrame, (stamps, targets, neighbours)))


def test_profile_and_its_slopes():
    x, y, one = np.array([[4.2]]), np.array([[3.9]]), np.ones((1, 1))
    m = ct.profile(COL[None], ROW[None], x, y, one, SHAPE)[:, 0]
    assert np.allclose(m[0], light(4.2, 3.9), atol=1e-12)
    for i in range(5):
        both = []
        for h in (1e-5, -1e-5):
            s = SHAPE.copy()
            if i >= 2:
                s[0, i - 2] += h
            both.append(ct.profile(COL[None], ROW[None], x + h * (i == 0), y + h * (i == 1), one, s)[0, 0])
        assert np.allclose((both[0] - both[1]) / 2e-5, m[i + 1], atol=1e-7)


def test_planted_scene_and_dimming_sources(spark):
    r = {x.sector: x for x in ct.sector_offsets(fits(spark, pd.concat([stamp(1, "a", 0, seed=1), stamp(1, "b", 1, seed=2), stamp(1, "c", 0, depth=0.0001, seed=3)]))).collect()}
    a, b, c = SHAPE[0]
    sigmas = np.sqrt(1 / np.linalg.eigvalsh(np.array([[a * a, a * b], [a * b, b * b + c * c]])))
    for x in r.values():
        assert (x.dx, x.dy) == pytest.approx((0.3, -0.2), abs=0.01)
        assert (x.sigma_major, x.sigma_minor) == pytest.approx(tuple(sorted(sigmas, reverse=True)), abs=0.01)
        assert x.light == pytest.approx(20000, rel=0.01)
        assert x.background == pytest.approx(150, abs=2)
        assert x.scale == pytest.approx(21)
    assert (r["a"].x_fit, r["a"].y_fit) == pytest.approx((4.5, 3.7), abs=0.06)
    assert (r["b"].x_fit, r["b"].y_fit) == pytest.approx((6.8, 4.2), abs=0.06)
    assert r["b"].depth == pytest.approx(0.02, rel=0.1)
    assert (r["b"].e, r["b"].n) == pytest.approx((-21 * 2.3, 21 * 0.5), abs=1.5)
    assert r["a"].detected and r["b"].detected and not r["c"].detected
    assert r["c"].e is None and r["c"].reason.startswith("no dip")


def test_difference_fit_is_the_least_over_a_plain_grid():
    d = stamp(1, "a", (5.3, 2.8), depth=0.001, seed=4)
    p, _, chi2, _ = ct.fit_difference(COL[None], ROW[None], d["diff"].to_numpy()[None], d["diff_var"].to_numpy()[None], SHAPE, np.array([[4.5]]), np.array([[3.7]]))
    best = np.inf
    for x in np.arange(-1, 9.01, 0.25):
        for y in np.arange(-1, 9.01, 0.25):
            m = np.column_stack([ct.profile(COL[None], ROW[None], np.array([[x]]), np.array([[y]]), np.ones((1, 1)), SHAPE)[0, 0], np.ones(len(COL))])
            left = d["diff"] - m @ np.linalg.lstsq(m, d["diff"], rcond=None)[0]
            best = min(best, float((left**2).sum()))
    assert chi2[0] * (len(COL) - 4) <= best + 1e-9
    assert tuple(p[0, :2]) == pytest.approx((5.3, 2.8), abs=0.3)


def test_covariance_follows_simulated_noise():
    n = 400
    rng = np.random.default_rng(5)
    diff = 100 * light(4.4, 4.1) + rng.normal(0, 1, (n, len(COL)))
    rows = lambda v: np.repeat(np.asarray(v, float)[None], n, 0)
    p, cov, _, _ = ct.fit_difference(rows(COL), rows(ROW), diff, np.ones_like(diff), rows(SHAPE[0]), rows([4.4]), rows([4.1]))
    off = p[:, :2] - (4.4, 4.1)
    far = np.einsum("bi,bij,bj->b", off, np.linalg.inv(cov[:, :2, :2]), off)
    assert far.mean() == pytest.approx(2.0, abs=0.35)
    assert p[:, 2].std() == pytest.approx(float(np.sqrt(cov[:, 2, 2]).mean()), rel=0.15)
    assert p[:, 2].mean() == pytest.approx(100, rel=0.02)


def test_odd_stamps(spark):
    few = stamp(2, "a", 0).head(5)
    holes = stamp(3, "a", 0, seed=6)
    holes.loc[[0, 40, 80], ["oot", "diff"]] = np.nan
    holes.loc[[7], ["oot_var", "diff_var"]] = 0.0
    stamps = pd.concat([few, holes, stamp(4, "a", 0), stamp(5, "a", 0)])
    targets = pd.DataFrame({"star": [2, 3, 4, 6], "sector": "a", "x": [4.2, 4.2, None, 4.2], "y": 3.9, **PLACED})
    neighbours = spark.createDataFrame([], "star long, sector string, id string, x double, y double, ratio double")
    alone = ct.centroid_fits(spark.createDataFrame(stamps), spark.createDataFrame(targets), neighbours)
    r = {x.star: x for x in ct.sector_offsets(alone).collect()}
    assert set(r) == {2, 3, 4}
    assert r[2].light is None and r[2].reason == "too few usable pixels" and not r[2].detected
    assert r[4].lost is None and r[4].snr is None
    assert (r[3].x_fit, r[3].y_fit) == pytest.approx((4.5, 3.7), abs=0.1)
    none = spark.createDataFrame([], spark.createDataFrame(stamps).schema)
    assert ct.centroid_fits(none, spark.createDataFrame(targets), neighbours).count() == 0


def test_a_scene_takes_its_brightest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ct, "SCENE_STARS", 2)
    n = [(1, "a", "p", 1.0, 1.0, 0.5), (1, "a", "q", 2.0, 1.0, 0.7), (1, "a", "r", 3.0, 1.0, 0.5), (1, "a", "far", 30.0, 1.0, 0.9), (1, "a", "faint", 1.0, 1.0, 0.001), (1, "a", "none", None, 1.0, 0.9)]
    stamps = spark.createDataFrame([(1, "a", 0.0, 8.0, 0.0, 8.0)], "star long, sector string, x_from double, x_to double, y_from double, y_to double")
    rows = ct.brightest_in_scene(spark.createDataFrame(n, "star long, sector string, id string, x double, y double, ratio double"), stamps).collect()
    assert [(r.at_x, r.at_ratio) for r in rows] == [([2.0, 1.0], [0.7, 0.5])]


def test_verdicts_from_pixels_to_words(spark):
    stamps = pd.concat([stamp(1, "a", 0, seed=1), stamp(1, "b", 0, seed=2), stamp(2, "a", 1, seed=3), stamp(3, "a", 0, depth=0.0, seed=4), stamp(4, "a", 0, seed=5)])
    offsets = ct.sector_offsets(fits(spark, stamps)).cache()
    near = [(s, "b", -21 * 2.3, 21 * 0.5, 1.3) for s in (1, 2, 3)] + [(4, "close", 1.0, 0.5, 2.0), (4, "too faint", 1.0, 0.5, 9.0), (4, "far", 140.0, 90.0, 1.0)]
    combined = ct.combined_sectors(offsets)
    table = ct.neighbour_table(combined, spark.createDataFrame(near, "star long, id string, at_e double, at_n double, fainter double"))
    t = {(r.star, r.id): r for r in table.collect()}
    assert (4, "far") not in t and t[4, "close"].suspect and not t[4, "too faint"].suspect
    assert t[2, "b"].suspect and t[1, "b"].excluded and t[3, "b"].needed is None and not t[3, "b"].suspect
    assert t[2, "b"].needed == pytest.approx(0.02 * 10**0.52, rel=0.1)
    v = {r.star: r for r in ct.verdicts(offsets, combined, table).collect()}
    assert {s: r.verdict for s, r in v.items()} == {1: "on target", 2: "off target", 3: "inconclusive", 4: "possible neighbour"}
    assert "it matches b, which would need" in v[2].reason
    assert "no sector of 1 shows the dip" in v[3].reason
    assert "close (1 arcsec away) would need a" in v[4].reason


def test_the_order_of_sectors_decides_no_tie(spark):
    """A depth of 0.01 five magnitudes fainter needs an eclipse of exactly one, whatever the order in which three sectors are summed."""
    schema = "star long, sector string, e double, n double, ee double, en double, nn double, depth double, depth_err double, detected boolean, scale double"
    rows = [(1, s, 0.0, 0.0, 4.0, 0.5, 5.0, 0.01, err, True, 21.0) for s, err in (("a", 0.001), ("b", 0.003), ("c", 0.003))]
    near = spark.createDataFrame([(1, 1, 1.0, 1.0, 5.0)], "star long, id long, at_e double, at_n double, fainter double")
    for order in itertools.permutations(rows):
        combined = ct.combined_sectors(spark.createDataFrame(order, schema).coalesce(1))
        t = ct.neighbour_table(combined, near).first()
        assert (t.needed, t.suspect) == (1.0, True)


def test_places_and_pixels_go_round(spark):
    d = spark.createDataFrame([(359.9, 60.0, 5.0, 4.0, -0.004, 0.003, 0.003, 0.004, 7.5, 2.25), (10.0, -89.0, 5.0, 4.0, -0.0058, 0.0, 0.0, 0.0058, 1.0, 9.0)], "ra0 double, dec0 double, x0 double, y0 double, c11 double, c12 double, c21 double, c22 double, x double, y double")
    ra, dec = sky.place_of(F.col("x"), F.col("y"))
    d = d.withColumns({"ra": ra, "dec": dec})
    x, y = sky.pixel_of(F.col("ra"), F.col("dec"))
    slopes = sky.pixel_slopes(F.col("ra"), F.col("dec"), F.col("x"), F.col("y"))
    for r in d.withColumns({"x2": x, "y2": y, **slopes}).collect():
        assert (r.x2, r.y2) == pytest.approx((r.x, r.y), abs=1e-8)
    first = d.withColumns(slopes).first()
    assert (first.ex, first.ny) == pytest.approx((-0.004 * 3600, 0.004 * 3600), rel=2e-3)


def test_settled_items_are_left_out_of_later_rounds():
    """Straight lines settle at once, one item's exponential takes many rounds: only it is worked on then, and all come out as alone."""
    x = np.linspace(0, 1, 30)
    y = np.stack([2 * x + 1, 3 * np.exp(2 * x), -x])
    sizes = []

    def model(p, item):
        sizes.append(len(item))
        curved = (item == 1)[:, None]
        a, b = p[:, :1], p[:, 1:2]
        bent = np.exp(np.clip(b * x, -20, 20))
        return np.where(curved, a * bent, a * x + b), np.stack([np.where(curved, bent, x), np.where(curved, a * x * bent, 1.0)], axis=2)

    start, bound = np.array([[0.0, 0.0], [1.0, 0.1], [0.0, 0.0]]), np.array([50.0, 50.0])
    p, cost, normal = ct.fitted(model, start, -bound, bound, y, np.ones_like(y))
    assert np.allclose(p, [[2, 1], [3, 2], [-1, 0]], atol=1e-6) and normal.shape == (3, 2, 2)
    assert sizes[0] == 3 and sizes[-1] < 3
    for i in range(3):
        one = ct.fitted(lambda q, item: model(q, item + i), start[i : i + 1], -bound, bound, y[i : i + 1], np.ones((1, 30)))
        assert np.allclose(one[0][0], p[i], rtol=1e-9, atol=1e-9) and np.allclose(one[2][0], normal[i])
