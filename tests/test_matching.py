"""Neighbours in time against all pairs."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from starloom.operators import matching
from starloom.plans.catalogues import neighbour_events


def test_others_near_equal_all_pairs(spark):
    """Crowded times, equal ones, ones exactly a quarter apart, on both sides of a power of two, and rows that lack something."""
    rng = np.random.default_rng(3)
    t = np.concatenate([16384 + rng.integers(-40, 40, 300) / 16, 16384 + rng.uniform(-1, 1, 200), rng.integers(-20, 20, 60) / 8, [0.1, 0.35, 0.6, -0.1]])
    rows = [(i, i % 3, int(k), float(x)) for i, (k, x) in enumerate(zip(rng.integers(0, 25, len(t)), t))]
    odd = [(1000, 0, None, 16384.0), (1001, None, 1, 16384.0), (1002, 0, 1, None), (1003, 0, 1, float("nan"))]
    d = spark.createDataFrame(rows + odd, "id long, kind int, star long, t double").repartition(5)
    got = {r.id: r.neighbours for r in matching.others_near(d, 0.25, "kind", "star").collect()}
    assert got == {i: len({s for _, k, s, u in rows if k == kind and s != star and abs(u - x) <= 0.25}) for i, kind, star, x in rows}


def test_neighbours_make_no_pairs(spark):
    """4,000 rows of one hour: 16 million pairs before, at most three marks a row now; rows of one number count together."""
    day = datetime.datetime(2024, 1, 1)
    rows = [(i if i > 1 else 0, day + datetime.timedelta(seconds=i % 3600), i % 2000, "view", 200.0) for i in range(4000)] + [(9000, day + datetime.timedelta(days=3), 1, "view", 200.0)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    found = neighbour_events(events)
    r = found.agg(F.count("*"), F.countDistinct("event_id"), F.min("neighbours"), F.max("neighbours")).first()
    assert tuple(r) == (3999, 3999, 1999, 2000)
    assert found.where("neighbours = 2000").collect()[0].event_id == 0
