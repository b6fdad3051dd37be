"""The chance that any of many places holds so deep a dip, against the standard library's normal distribution."""

from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from starloom.operators import scatter as sc

NORMAL = NormalDist()


def test_quantiles(spark):
    rows = spark.createDataFrame([(p,) for p in (0.9, 0.5, 0.1, 1e-3, 1e-6)] + [(0.0,), (1.0,), (None,)], "p double").select("p", sc.normal_quantile(F.col("p")).alias("x")).collect()
    for r in rows:
        if r.p in (0.0, 1.0, None):
            assert r.x is None
        else:
            assert r.x == pytest.approx(-NORMAL.inv_cdf(r.p), abs=2e-3)


def test_verdicts_allow_for_the_places(spark):
    raws = [1.0, 3.2, 4.0, 6.0, 50.0, -1.0]
    d = spark.createDataFrame([(i, 0.01, 0.01 / r, r) for i, r in enumerate(raws)], "star long, depth double, err double, raw double")
    got = {r.star: r for r in sc.secondary_verdict(d, F.lit(0.02), F.lit(0.05)).collect()}
    for i, raw in enumerate(raws[:4]):
        chance = -NORMAL.inv_cdf(1 - (1 - NORMAL.cdf(-raw)) ** 10)
        assert got[i].places == pytest.approx(10) and got[i].nsig == pytest.approx(chance, abs=2e-3)
    assert got[4].nsig == 50.0 and got[5].nsig < 0
    assert [got[i].passed for i in range(6)] == [True, True, False, False, False, True]
    shallow = sc.secondary_verdict(d, F.lit(0.5), F.lit(1.0)).collect()
    assert all(r.passed and r.places == 1 for r in shallow)
    assert {r.star: r for r in shallow}[2].nsig == pytest.approx(4.0, abs=1e-6)
