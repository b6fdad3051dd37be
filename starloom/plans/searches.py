"""Queries around a search: masks, nearest joins, noise, depths and their checks, over events as light curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions.astro import rounded
from starloom.operators import curves as ops
from starloom.operators import quantiles
from starloom.operators import signals as sig
from starloom.plans.curves import DURATION, PERIOD, PHASE, T0, C, sql_r
from starloom.sources.tables import curve, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(curve(table(spark, sf_dir, "events")))
        ORACLES[f.__name__] = C.rstrip() + sql if sql.startswith(",") else C + sql
        return f

    return add


@query("SELECT event_id, star FROM c WHERE isfinite(t) AND isfinite(flux) AND flux > 0")
def good_cadences(d):
    return sig.good_rows(d).select("event_id", "star")


@query(", m AS (SELECT *, median(flux) OVER (PARTITION BY star, sector) AS med FROM c) SELECT event_id FROM m WHERE flux / med > 0.5")
def dropout_filter(d):
    return sig.good_rows(ops.median_normalised(d), 0.5).select("event_id")


@query(", g AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER w > 2, true) THEN 1 ELSE 0 END AS fresh FROM c WINDOW w AS (PARTITION BY star ORDER BY t, event_id)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY star ORDER BY t, event_id) AS run FROM g), e AS (SELECT *, min(t) OVER (PARTITION BY star, run) AS a, max(t) OVER (PARTITION BY star, run) AS b FROM r) SELECT event_id, t < a + 0.25 OR t > b - 0.25 AS masked FROM e")
def edge_mask(d):
    return sig.edge_mask(d, 0.25, 2.0).select("event_id", "masked")


@query(", k AS (SELECT *, CAST(floor(t / 5) AS BIGINT) AS chunk FROM c), m AS (SELECT star, chunk, count(*) AS n, 1.4826 * mad(flux) AS own FROM k GROUP BY star, chunk), w AS (SELECT star, 1.4826 * mad(flux) AS whole FROM c GROUP BY star) SELECT star, chunk, " + sql_r("CASE WHEN n >= 3 THEN own ELSE whole END") + " AS sigma FROM m JOIN w USING (star)")
def local_sigma(d):
    return sig.local_sigma(d, 5.0, 3).withColumn("sigma", rounded(F.col("sigma")))


@query(", k AS (SELECT *, row_number() OVER (PARTITION BY star ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY star) AS n FROM c) SELECT star, CAST(floor((i - 1) / ceil(n / 4.0)) AS BIGINT) AS run, " + sql_r("avg(t)") + " AS t, " + sql_r("avg(flux)") + " AS flux, count(*) AS n FROM k GROUP BY 1, 2")
def consecutive_means(d):
    return sig.consecutive_means(d, 4).withColumns({"t": rounded(F.col("t")), "flux": rounded(F.col("flux"))})


PURCHASES = "p AS (SELECT star, t, max(flux) AS value FROM c WHERE sector = 'purchase' GROUP BY star, t)"


def purchases(d):
    return d.where("sector = 'purchase'").groupBy("star", "t").agg(F.max("flux").alias("value"))


@query(f", {PURCHASES}, v AS (SELECT star, event_id, t FROM c WHERE sector = 'view'), j AS (SELECT v.star, v.event_id, v.t, p.t AS near_t, p.value AS near_value, row_number() OVER (PARTITION BY v.event_id ORDER BY abs(v.t - p.t), p.t) AS k FROM v LEFT JOIN p ON p.star = v.star AND abs(v.t - p.t) <= 3) SELECT star, event_id, near_t, near_value FROM j WHERE k = 1")
def asof_nearest(d):
    return sig.nearest(d.where("sector = 'view'"), purchases(d), 3.0)


@query(f", {PURCHASES}, v AS (SELECT star, event_id, t FROM c WHERE sector = 'view'), a AS (SELECT v.*, p.t AS ta, p.value AS av FROM v ASOF LEFT JOIN p ON v.star = p.star AND v.t >= p.t), b AS (SELECT a.*, p.t AS tb, p.value AS bv FROM a ASOF LEFT JOIN p ON a.star = p.star AND a.t <= p.t) SELECT star, event_id, " + sql_r("coalesce(av + (bv - av) * (t - ta) / nullif(tb - ta, 0), av, bv)") + " AS value FROM b")
def interpolate_onto_times(d):
    return sig.interpolated(d.where("sector = 'view'"), purchases(d)).withColumn("value", rounded(F.col("value")))


@query(", s AS (SELECT star, list_sort(list(flux)) AS v FROM c GROUP BY star) SELECT star, v[CAST(floor(0.002 * (len(v) - 1) + 0.5) AS INT) + 1] AS low, v[CAST(floor(0.998 * (len(v) - 1) + 0.5) AS INT) + 1] AS high, v[CAST(floor(len(v) * 0.97) AS INT) + 1] AS top, v[len(v) // 2 + 1] AS middle FROM s")
def display_ranges(d):
    top = (0.97, lambda n: F.floor(n * 0.97))
    found = quantiles.quantiles(d, ("star",), F.col("flux"), {"low": quantiles.nearest_rank(0.002), "high": quantiles.nearest_rank(0.998), "top": top, "middle": quantiles.upper_middle()})
    return found.drop("n")


@query(f", f AS (SELECT star, CAST(floor(({PHASE} + {PERIOD} / 2) / {PERIOD} * 12) AS BIGINT) AS bin, flux FROM c), g AS (SELECT star, bin, list_sort(list(flux)) AS v FROM f GROUP BY star, bin) SELECT star, bin, v[len(v) // 2 + 1] AS middle FROM g WHERE len(v) >= 2 AND bin < 12")
def folded_middles(d):
    """Middle value of each bin of phase that holds enough rows."""
    away = F.pmod(F.col("t") - T0 + PERIOD / 2, F.lit(PERIOD))
    b = d.withColumn("bin", F.floor(away / PERIOD * 12)).where("bin < 12")
    return quantiles.quantiles(b, ("star", "bin"), F.col("flux"), {"middle": quantiles.upper_middle()}).where("n >= 2").drop("n")


INSIDE = f"p AS (SELECT *, {PHASE} AS away, floor((t - {T0}) / {PERIOD} + 0.5) AS epoch FROM c)"


@query(f", {INSIDE}, l AS (SELECT star, median(flux) AS level FROM p WHERE abs(away) >= {DURATION} GROUP BY star), s AS (SELECT p.star, any_value(level) AS level, avg(flux) FILTER (abs(away) < {DURATION} / 2) AS inside, count(DISTINCT epoch) FILTER (abs(away) < {DURATION} / 2) AS n_epochs, 1.4826 * median(abs(flux - level)) FILTER (abs(away) >= {DURATION}) AS sigma FROM p JOIN l ON p.star = l.star GROUP BY p.star) SELECT star, " + sql_r("level - inside") + " AS depth, n_epochs, " + sql_r("(level - inside) / sigma * sqrt(n_epochs)", 3) + " AS snr FROM s WHERE n_epochs > 0 AND sigma > 0")
def depth_snr(d):
    return sig.depth_snr(d, PERIOD, T0, DURATION).select("star", rounded(F.col("depth")).alias("depth"), "n_epochs", rounded(F.col("snr"), 3).alias("snr"))


DEPTHS = f"{INSIDE}, e AS (SELECT star, CAST(epoch AS BIGINT) AS epoch, avg(flux) AS depth, 1 + count(*) AS err FROM p GROUP BY star, epoch)"


def depths(d):
    return d.withColumn("epoch", F.floor((F.col("t") - T0) / PERIOD + 0.5)).groupBy("star", "epoch").agg(F.avg("flux").alias("depth"), (1 + F.count("*")).cast("double").alias("err"))


@query(f", {DEPTHS}, m AS (SELECT star, epoch % 2 AS parity, sum(depth / (err * err)) / sum(1.0 / (err * err)) AS mean, count(*) AS n FROM e GROUP BY 1, 2), x AS (SELECT e.star, sum((depth - mean) * (depth - mean) / (err * err)) AS chi, count(*) - count(DISTINCT parity) AS dof FROM e JOIN m ON e.star = m.star AND e.epoch % 2 = m.parity WHERE m.n >= 2 GROUP BY e.star), s AS (SELECT DISTINCT star FROM e) SELECT star, " + sql_r("greatest(1.0, coalesce(sqrt(chi / dof), 1.0))", 3) + " AS scale FROM s LEFT JOIN x USING (star)")
def odd_even_over_dispersion(d):
    return sig.over_dispersion(depths(d)).withColumn("scale", rounded(F.col("scale"), 3))


SECTORS = "s AS (SELECT star, sector, avg(flux) AS depth, 10.0 + count(*) AS err FROM c GROUP BY star, sector)"


def sector_depths(d):
    return d.groupBy("star", "sector").agg(F.avg("flux").alias("depth"), (10.0 + F.count("*")).alias("err"))


@query(f", {SECTORS}, m AS (SELECT star, sum(depth / (err * err)) / sum(1 / (err * err)) AS mean, count(*) AS n, max(depth) - min(depth) AS r FROM s GROUP BY star), x AS (SELECT star, sum((depth - mean) * (depth - mean) / (err * err)) AS chi, any_value(n) - 1 AS dof, any_value(r) AS r, any_value(mean) AS mean FROM s JOIN m USING (star) WHERE n > 1 GROUP BY star), z AS (SELECT *, 1 / (1 + 0.2316419 * sqrt(chi)) AS u FROM x), q AS (SELECT *, exp(-chi / 2) / 2.5066282746310002 * u * (0.319381530 + u * (-0.356563782 + u * (1.781477937 + u * (-1.821255978 + u * 1.330274429)))) AS tail FROM z) SELECT star, " + sql_r("chi") + " AS chi, dof, " + sql_r("CASE dof WHEN 1 THEN 2 * tail WHEN 2 THEN exp(-chi / 2) WHEN 3 THEN 2 * tail + exp(-chi / 2) * sqrt(chi) * 0.7978845608028654 WHEN 4 THEN exp(-chi / 2) * (1 + chi / 2) END") + " AS p, " + sql_r("r / greatest(abs(mean), 1e-9)") + " AS spread FROM q")
def sector_depth_consistency(d):
    s = sig.sector_consistency(sector_depths(d))
    return s.select("star", rounded(F.col("chi")).alias("chi"), "dof", rounded(F.col("p")).alias("p"), rounded(F.col("spread")).alias("spread"))


@query(", w AS (SELECT star, sector, flux, 1.4826 * mad(flux) OVER (PARTITION BY star, sector) AS sigma, count(*) OVER (PARTITION BY star, sector) AS n FROM c), s AS (SELECT star, sector, any_value(sigma) / sqrt(2) AS noise FROM w GROUP BY star, sector) SELECT star, " + sql_r("1 / sqrt(avg(1 / (noise * noise)))", 3) + " AS noise FROM s WHERE noise > 0 GROUP BY star")
def combined_noise(d):
    s = ops.robust_sigma(d, ("star", "sector")).withColumn("noise", F.col("sigma") / F.sqrt(F.lit(2.0))).where("noise > 0")
    return s.groupBy("star").agg(rounded(1 / F.sqrt(F.avg(1 / (F.col("noise") * F.col("noise")))), 3).alias("noise"))


DIPS = "e AS (SELECT event_id, star, sector, flux AS depth, 1.0 + event_id % 5 AS err, 1.0 + event_id % 4 AS duration FROM c WHERE flux > 150)"


@query(f", {DIPS} SELECT a.star, a.event_id AS first_id, b.event_id AS second_id FROM e a JOIN e b ON a.star = b.star AND a.event_id < b.event_id AND a.sector <> b.sector WHERE (abs(a.depth - b.depth) / sqrt(a.err * a.err + b.err * b.err) <= 3 OR greatest(a.depth, b.depth) / greatest(least(a.depth, b.depth), 1e-12) <= 1.5) AND greatest(a.duration, b.duration) / least(a.duration, b.duration) <= 1.6")
def dip_pairs(d):
    e = d.where("flux > 150").selectExpr("event_id", "star", "sector", "flux depth", "1.0D + event_id % 5 err", "1.0D + event_id % 4 duration")
    return sig.event_pairs(e)


CHECKS = "k AS (SELECT star, sector AS name, CASE event_id % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS passed, round(flux) / 100 AS margin FROM c WHERE event_id % 3 = 0)"


@query(f", {CHECKS} SELECT star, name, CASE WHEN bool_or(passed = false) THEN false WHEN bool_or(passed IS NULL) THEN NULL ELSE true END AS passed, CASE WHEN bool_or(passed = false) THEN 0.0 WHEN bool_or(passed IS NULL) THEN NULL ELSE min(margin) END AS margin FROM k GROUP BY star, name")
def merged_event_checks(d):
    k = d.where("event_id % 3 = 0").selectExpr("star", "sector name", "CASE event_id % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END passed", "round(flux) / 100 margin")
    return sig.merged_checks(k, ["star"])
