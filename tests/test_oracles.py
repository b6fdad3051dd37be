"""Every query of the package's own operators against its SQL in DuckDB."""

import math

import duckdb
import pytest

from starloom.plans import catalogues, centroids, curves, dips, pixels, searches, stars, vetting

TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()
QUERIES = curves.QUERIES | catalogues.QUERIES | searches.QUERIES | stars.QUERIES | pixels.QUERIES | dips.QUERIES | centroids.QUERIES | vetting.QUERIES
ORACLES = curves.ORACLES | catalogues.ORACLES | searches.ORACLES | stars.ORACLES | pixels.ORACLES | dips.ORACLES | centroids.ORACLES | vetting.ORACLES


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return db


def values(rows):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_the_oracle(name, spark, duck, sf):
    got = QUERIES[name](spark, sf)
    names = sorted(got.columns)
    found = duck.execute(ORACLES[name])
    assert sorted(c[0] for c in found.description) == names
    want = values(duck.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({ORACLES[name]})").fetchall())
    assert values(map(tuple, got.select(*[f"`{n}`" for n in names]).collect())) == want


def test_no_name_is_registered_twice():
    modules = (curves, catalogues, searches, stars, pixels, dips, centroids, vetting)
    assert sum(len(m.QUERIES) for m in modules) == len(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
