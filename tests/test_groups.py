"""Grouped functions against values worked out by hand or plainly."""

import math

import numpy as np
import pytest

from starloom.operators.kernels import biweight_location, strongest_apart
from starloom.operators.lists import token_bucket


def test_token_bucket_by_hand(spark):
    """Two a minute: full with 2, one more each 30 s, never above 2."""
    hits = [("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, 2.0), ("a", 4, 31.0), ("a", 5, 32.0), ("a", 6, 700.0), ("a", 7, 700.0), ("a", 8, 700.0), ("b", 9, 2.0)]
    got = {r.seq: r.allowed for r in token_bucket(spark.createDataFrame(hits[::-1], "key string, seq long, t double"), 2.0).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True, 8: False, 9: True}
    assert token_bucket(spark.createDataFrame([], "key string, seq long, t double"), 2.0).count() == 0


def test_strongest_events_stand_apart(spark):
    events = [(1, 0.0, 5.0), (1, 1.0, 9.0), (1, 2.5, 8.0), (1, 3.0, 7.0), (1, 4.6, 1.0), (2, 1.0, 1.0), (2, 1.0, 1.0), (2, 3.0, 1.0)]
    got = sorted((r.star, r.t) for r in strongest_apart(spark.createDataFrame(events, "star long, t double, strength double"), 2.0).collect())
    assert got == [(1, 1.0), (1, 3.0), (2, 1.0), (2, 3.0)]


def test_biweight_location_solves_its_equation(spark):
    rng = np.random.default_rng(3)
    y = np.concatenate([rng.normal(10, 1, 400), [1000.0, -500.0]])
    rows = [(1, float(v)) for v in y] + [(2, 4.0)] * 5 + [(3, None), (3, float("nan")), (3, 7.0)]
    got = {r.star: r.location for r in biweight_location(spark.createDataFrame(rows, "star long, flux double"), ["star"]).collect()}
    assert got[2] == 4.0 and got[3] == 7.0
    at = got[1]
    u = (y - at) / (5 * np.median(np.abs(y - at)))
    w = np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0.0)
    assert at == pytest.approx(float((w * y).sum() / w.sum()), abs=1e-4)
    assert at == pytest.approx(10, abs=0.2) and not math.isclose(at, float(y.mean()), abs_tol=0.5)
