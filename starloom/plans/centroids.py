"""Queries on places in pixel stamps: projections, fits of scenes and dips, neighbours and verdicts, over events as light curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions import sky
from starloom.functions.astro import rounded
from starloom.operators import centroids as ct
from starloom.plans.curves import C, sql_r
from starloom.sources.tables import curve, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(curve(table(spark, sf_dir, "events")))
        if sql:
            ORACLES[f.__name__] = C.rstrip() + sql
        return f

    return add


SCALE = 21.0 / 3600
#: An image for each star and sector: where it touches the sky, how it is turned, and where its target lies.
IMAGE = {
    "ra0": "(star * 37) % 360 + 0.95", "dec0": "star % 141 - 70.0", "x0": "3.0", "y0": "3.0", "ra": "((star * 37) % 360 + 0.95) + (n % 7 - 3) * 0.002", "dec": "star % 141 - 70.0 + (n % 5 - 2) * 0.003",
    "c11": f"-{SCALE} * cos(0.5 * length(sector))", "c12": f"{SCALE} * sin(0.5 * length(sector))", "c21": f"{SCALE} * sin(0.5 * length(sector))", "c22": f"{SCALE} * cos(0.5 * length(sector))",
}
IMAGES = ", g AS (SELECT star, sector, count(*) AS n, avg(flux) AS level FROM c GROUP BY star, sector), i AS (SELECT *, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in IMAGE.items()) + " FROM g)"


def images(d):
    g = d.groupBy("star", "sector").agg(F.count("*").alias("n"), F.avg("flux").alias("level"))
    return g.select("*", *[F.expr(v).cast("double").alias(k) for k, v in IMAGE.items()])


def targets(d):
    i = images(d)
    x, y = sky.pixel_of(F.col("ra"), F.col("dec"))
    i = i.withColumns({"x": x, "y": y})
    return i.withColumns(sky.pixel_slopes(F.col("ra"), F.col("dec"), F.col("x"), F.col("y")))


PIXELS = """, p AS (SELECT *, degrees(cos(radians(dec)) * sin(radians(ra - ra0)) / cc) AS pe, degrees((cos(radians(dec0)) * sin(radians(dec)) - sin(radians(dec0)) * cos(radians(dec)) * cos(radians(ra - ra0))) / cc) AS pn FROM (SELECT *, sin(radians(dec0)) * sin(radians(dec)) + cos(radians(dec0)) * cos(radians(dec)) * cos(radians(ra - ra0)) AS cc FROM i)),
 q AS (SELECT *, x0 + (c22 * pe - c12 * pn) / (c11 * c22 - c12 * c21) AS x, y0 + (c11 * pn - c21 * pe) / (c11 * c22 - c12 * c21) AS y FROM p),
 k AS (SELECT q.*, v.k, radians(c11 * (x + dx - x0) + c12 * (y + dy - y0)) AS te, radians(c21 * (x + dx - x0) + c22 * (y + dy - y0)) AS tn FROM q, (VALUES (0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0)) v(k, dx, dy)),
 w AS (SELECT *, ra0 + degrees(atan2(te, cos(radians(dec0)) - tn * sin(radians(dec0)))) - ra AS away, degrees(atan2(sin(radians(dec0)) + tn * cos(radians(dec0)), sqrt(te * te + (cos(radians(dec0)) - tn * sin(radians(dec0))) ** 2))) AS d FROM k),
 o AS (SELECT star, sector, any_value(x) AS x, any_value(y) AS y, """ + ", ".join(f"max(away * cos(radians(dec)) * 3600) FILTER (k = {j}) AS e{j}, max((d - dec) * 3600) FILTER (k = {j}) AS n{j}" for j in range(3)) + " FROM w GROUP BY star, sector)"


@query(IMAGES + PIXELS + " SELECT star, sector, " + ", ".join(f"{sql_r(v, 5)} AS {k}" for k, v in {"x": "x", "y": "y", "ex": "e1 - e0", "nx": "n1 - n0", "ey": "e2 - e0", "ny": "n2 - n0"}.items()) + " FROM o")
def image_places(d):
    """Pixels of targets and the slopes of the sky along pixels."""
    return targets(d).select("star", "sector", *[rounded(F.col(k), 5).alias(k) for k in ("x", "y", "ex", "nx", "ey", "ny")])


@query(None)
def centroid_offsets(d):
    """Stamps of 7 by 7 pixels whose target shines as bright as its events' mean; every third star's neighbour is what dims."""
    t = targets(d).withColumns({"b_x": F.col("x") + 1.8, "b_y": F.col("y") + 0.6})
    side = F.sequence(F.lit(0), F.lit(6))
    p = t.withColumn("row", F.explode(side)).withColumn("col", F.explode(side))
    one = lambda x, y: F.exp(-((F.col("col") - F.col(x) - 0.2) ** 2 + (F.col("row") - F.col(y) + 0.1) ** 2) / 1.62) / 5.0
    noise = lambda salt: F.pmod(F.xxhash64("star", "sector", "row", "col", F.lit(salt)), F.lit(2001)) / 1000.0 - 1
    light = 20.0 * F.abs("level") + 100
    lost = light * F.when(F.col("star") % 3 == 0, one("b_x", "b_y")).otherwise(one("x", "y"))
    stamps = p.select("star", "sector", "row", "col", (light * (one("x", "y") + 0.4 * one("b_x", "b_y")) + 30 + noise(1)).alias("oot"), F.lit(0.34).alias("oot_var"), (0.05 * lost + noise(2)).alias("diff"), F.lit(0.34).alias("diff_var"))
    neighbours = t.select("star", "sector", F.lit("b").alias("id"), F.col("b_x").alias("x"), F.col("b_y").alias("y"), F.lit(0.4).alias("ratio"))
    fits = ct.centroid_fits(stamps, t.select("star", "sector", "x", "y", "ex", "ey", "nx", "ny"), neighbours)
    return ct.sector_offsets(fits).select("star", "sector", "dx", "dy", "light", "scene_chi2", "x_fit", "y_fit", "snr", "depth", "depth_err", "detected", "reason", "e", "n", "ee", "en", "nn")


PLACES = """, o AS (SELECT star, sector, (count(*) % 5 - 2) * 3.0 + CASE WHEN star % 4 = 0 THEN 30 ELSE 0 END AS e, (star % 7 - 3) * 2.0 AS n, 4.0 + count(*) % 3 AS ee, 0.5 AS en, 5.0 + star % 2 AS nn, 0.01 + count(*) % 4 / 200.0 AS depth, 0.001 * (1 + count(*) % 3) AS depth_err, count(*) % 2 = 0 AS detected, 4.0 + count(*) % 9 AS snr FROM c GROUP BY star, sector),
 u AS (SELECT *, nn / (ee * nn - en * en) AS ia, -en / (ee * nn - en * en) AS ib, ee / (ee * nn - en * en) AS ic, 1 / (depth_err * depth_err) AS iw FROM o WHERE detected),
 s AS (SELECT star, count(*) AS sectors, sum(ia) AS a, sum(ib) AS b, sum(ic) AS k, sum(ia * e + ib * n) AS x, sum(ib * e + ic * n) AS y, sum(ia * e * e + 2 * ib * e * n + ic * n * n) AS own, sum(iw * depth) / sum(iw) AS depth FROM u GROUP BY star),
 m AS (SELECT *, a * k - b * b AS f, (k * x - b * y) / (a * k - b * b) AS e, (a * y - b * x) / (a * k - b * b) AS n FROM s),
 j AS (SELECT *, greatest(1, CASE WHEN sectors > 1 THEN greatest(own - e * x - n * y, 0) / (2 * (sectors - 1)) ELSE 1 END) AS wide FROM m),
 r AS (SELECT star, depth, e, n, wide * k / f AS ee, -wide * b / f AS en, wide * a / f AS nn FROM j)"""
NEIGHBOURS = ", b AS (SELECT star, event_id AS id, (event_id % 13 - 6) * 9.0 AS at_e, (event_id % 29 - 14) * 12.0 AS at_n, event_id % 60 / 10.0 AS fainter FROM c)"
FAR = "sqrt(abs((nn * ({e}) * ({e}) - 2 * en * ({e}) * ({n}) + ee * ({n}) * ({n})) / (ee * nn - en * en)))"
AWAY = FAR.format(e="e - at_e", n="n - at_n")
TABLE = f""", h AS (SELECT b.star, id, sqrt(at_e * at_e + at_n * at_n) AS sep, depth * 10 ** (0.4 * fainter) AS needed, {AWAY} AS distance_sigma, {AWAY} > 3 AND sqrt((e - at_e) ** 2 + (n - at_n) ** 2) > 6.3 AS excluded FROM b LEFT JOIN r USING (star) WHERE sqrt(at_e * at_e + at_n * at_n) <= 150),
 t AS (SELECT *, coalesce(needed <= 1 AND NOT excluded, false) AS suspect FROM h)"""


def offsets(d):
    n = F.count("*")
    g = d.groupBy("star", "sector").agg(n.alias("_n"))
    return g.selectExpr("star", "sector", "(_n % 5 - 2) * 3.0D + if(star % 4 = 0, 30, 0) e", "(star % 7 - 3) * 2.0D n", "4.0D + _n % 3 ee", "0.5D en", "5.0D + star % 2 nn", "0.01D + _n % 4 / 200.0D depth", "0.001D * (1 + _n % 3) depth_err", "_n % 2 = 0 detected", "4.0D + _n % 9 snr", "21.0D scale", "1.0D lost")


def neighbours(d):
    return d.selectExpr("star", "event_id id", "(event_id % 13 - 6) * 9.0D at_e", "(event_id % 29 - 14) * 12.0D at_n", "event_id % 60 / 10.0D fainter")


@query(PLACES + NEIGHBOURS + TABLE + f" SELECT star, id, {sql_r('sep')} AS sep, {sql_r('needed')} AS needed, {sql_r('distance_sigma')} AS distance_sigma, excluded, suspect FROM t")
def neighbour_table(d):
    t = ct.neighbour_table(ct.combined_sectors(offsets(d)), neighbours(d)).drop("ratio")
    return t.withColumns({k: rounded(F.col(k)) for k in ("sep", "needed", "distance_sigma")})


@query(PLACES + NEIGHBOURS + TABLE + f""", z AS (SELECT star, count(*) FILTER (suspect) AS suspects FROM t GROUP BY star), y AS (SELECT DISTINCT star FROM o)
 SELECT y.star, CASE WHEN e IS NULL THEN 'inconclusive' WHEN {FAR.format(e='e', n='n')} > 3 AND sqrt(e * e + n * n) > 6.3 THEN 'off target' WHEN suspects > 0 THEN 'possible neighbour' ELSE 'on target' END AS verdict FROM y LEFT JOIN r USING (star) LEFT JOIN z USING (star)""")
def pixel_verdicts(d):
    o = offsets(d)
    combined = ct.combined_sectors(o)
    return ct.verdicts(o, combined, ct.neighbour_table(combined, neighbours(d))).select("star", "verdict")
