"""Queries on detrending, single dips, located masks, aliases against coverage and footprints, over events as light curves.

A star has about two rows a day here, so windows and durations are days long.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions.astro import rounded
from starloom.operators import detrend, dips
from starloom.plans.curves import C, sql_r
from starloom.sources.tables import curve, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WINDOW, GAP = 8.0, 2.0


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(curve(table(spark, sf_dir, "events")))
        if sql:
            ORACLES[f.__name__] = C.rstrip() + sql if sql.startswith(",") else C + sql
        return f

    return add


#: Runs of a star's rows, and what a run holds; rows of one event type are left out of the trend.
RUNS = f""", x AS (SELECT *, sector = 'purchase' AS masked FROM c),
 g AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER w > {GAP}, true) THEN t END AS b0, CASE WHEN coalesce(lead(t) OVER w - t > {GAP}, true) THEN t END AS e0 FROM x WINDOW w AS (PARTITION BY star ORDER BY t)),
 r AS (SELECT *, max(b0) OVER (PARTITION BY star ORDER BY t) AS begins, min(e0) OVER (PARTITION BY star ORDER BY t DESC) AS ends FROM g),
 s AS (SELECT star, begins, any_value(ends) AS ends, count(*) FILTER (NOT masked) AS n_used, median(flux) AS every, median(flux) FILTER (NOT masked) AS used FROM r GROUP BY star, begins)"""


def biweight_sql(source: str, rounds: int) -> str:
    """Rounds of the biweight over the lists y of ``source``, from the median on; the last table is l{rounds}."""
    out = f", l0 AS (SELECT *, list_median(y) AS loc FROM {source})"
    for k in range(rounds):
        w = "CASE WHEN abs((v - loc) / (5 * mad)) < 1 THEN pow(1 - pow((v - loc) / (5 * mad), 2), 2) ELSE 0.0 END"
        out += f", m{k} AS (SELECT *, list_median(list_transform(y, lambda v: abs(v - loc))) AS mad FROM l{k})"
        out += f", w{k} AS (SELECT *, CASE WHEN mad > 0 THEN list_transform(y, lambda v: {w}) END AS w FROM m{k})"
        out += f", l{k + 1} AS (SELECT * EXCLUDE (loc, mad, w), coalesce(list_sum(list_transform(list_zip(y, w), lambda z: z[1] * z[2])) / nullif(list_sum(w), 0), loc) AS loc FROM w{k})"
    return out


TREND = (
    RUNS
    + f""", k AS (SELECT star, begins, begins + i * {WINDOW / 12!r} AS node FROM (SELECT *, unnest(range(0, CAST(ceil((ends + {WINDOW / 12!r} - begins) / {WINDOW / 12!r}) AS BIGINT))) AS i FROM s WHERE n_used >= 10)),
 y AS (SELECT k.star, k.begins, node, list(flux) AS y FROM k JOIN r ON r.star = k.star AND r.begins = k.begins AND NOT masked AND t >= node - {WINDOW / 2} AND t < node + {WINDOW / 2} GROUP BY ALL HAVING count(*) >= 5)"""
    + biweight_sql("y", 5)
    + """, a AS (SELECT r.*, n.node AS na, n.loc AS va FROM r ASOF LEFT JOIN l5 n ON r.star = n.star AND r.begins = n.begins AND r.t >= n.node),
 b AS (SELECT a.*, n.node AS nb, n.loc AS vb FROM a ASOF LEFT JOIN l5 n ON a.star = n.star AND a.begins = n.begins AND a.t <= n.node),
 h AS (SELECT b.*, coalesce(coalesce(va + (vb - va) * (t - na) / nullif(nb - na, 0), va, vb), CASE WHEN n_used < 10 THEN every ELSE used END) AS trend FROM b JOIN s USING (star, begins))"""
)


def masked(d):
    return d.withColumn("masked", F.col("sector") == "purchase")


def trend(d):
    return detrend.sliding_biweight(masked(d), WINDOW, gap=GAP)


@query(TREND + " SELECT event_id, " + sql_r("trend") + " AS trend FROM h")
def sliding_trend(d):
    """Biweight trend on a grid in each run of a star, one event type left out of it."""
    return trend(d).select("event_id", rounded(F.col("trend")).alias("trend"))


@query(TREND + ", f AS (SELECT *, flux / trend AS flat FROM h), o AS (SELECT star, median(flat) AS middle, 1.4826 * mad(flat) AS sigma FROM f GROUP BY star) SELECT event_id, " + sql_r("flat") + " AS flat, flat < middle + 3 * sigma AS keep FROM f JOIN o USING (star)")
def flatten_for_search(d):
    return detrend.flattened(trend(d)).select("event_id", rounded(F.col("flat")).alias("flat"), "keep")


USED_RUNS = f""", x AS (SELECT *, sector = 'purchase' AS masked FROM c), u AS (SELECT * FROM x WHERE NOT masked),
 g AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY star ORDER BY t) > {GAP}, true) THEN t END AS b0 FROM u),
 r AS (SELECT *, max(b0) OVER (PARTITION BY star ORDER BY t) AS begins FROM g),
 y AS (SELECT a.star, a.t AS node, list(b.flux) AS y FROM (SELECT DISTINCT star, begins, t FROM r) a JOIN r b ON a.star = b.star AND a.begins = b.begins AND b.t >= a.t - {WINDOW / 2} AND b.t < a.t + {WINDOW / 2} GROUP BY ALL)"""


@query(USED_RUNS + biweight_sql("y", 15) + ", n AS (SELECT star, count(*) AS n_used, median(flux) AS used FROM u GROUP BY star), a AS (SELECT x.*, l.node AS na, l.loc AS va FROM x ASOF LEFT JOIN l15 l ON x.star = l.star AND x.t >= l.node), b AS (SELECT a.*, l.node AS nb, l.loc AS vb FROM a ASOF LEFT JOIN l15 l ON a.star = l.star AND a.t <= l.node) SELECT event_id, " + sql_r("CASE WHEN coalesce(n_used, 0) < 10 THEN coalesce(used, 1.0) ELSE coalesce(va + (vb - va) * (t - na) / nullif(nb - na, 0), va, vb) END", 3) + " AS trend FROM b LEFT JOIN n USING (star)")
def trend_at_rows(d):
    """Biweight around every row that isn't left out, straight lines over those that are."""
    return detrend.biweight_at_rows(masked(d), WINDOW, GAP).select("event_id", rounded(F.col("trend"), 3).alias("trend"))


@query(None)
def single_dips(d):
    """Dips of two tiers of durations in every star's detrended curve, and whether they are clear of edges."""
    d = masked(d).where("flux is not null")
    found = dips.single_dips(d, ((2.0, 3.0), (4.0,)), 60.0, GAP, most=5, least_ses=2.5, least_coverage=0.5, usual=0.5, day=10.0, day_rows=5, noise_rows=20, gap_d=GAP)
    return dips.clear_of_edges(found, d, 60.0, 0.5, GAP)


LISTED = "struct(star, 1L AS entry, 3.0D AS period, 1.0D + star % 3 AS t0, CASE WHEN star % 4 = 0 THEN NULL ELSE 0.5D END AS duration, 0.01D * (star % 5) AS t0_err, 1e-6D AS period_err, star % 7 = 0 AS moving)"


@query(None)
def located_masks(d):
    """Rows in a transit of the signal that is listed for their star, where it is predicted and where it is found."""
    from starloom.operators.known import known_mask

    d = d.where("flux is not null")
    listed = d.select("star").distinct().selectExpr(f"{LISTED} AS k").select("k.*")
    return known_mask(d, listed, WINDOW, GAP)[0].select("event_id", "masked")


DIPS = ", u AS (SELECT star, event_id, t AS tc, 0.25 + event_id % 4 * 0.25 AS duration FROM c WHERE flux > 120)"
BEGUN = f""", g AS (SELECT star, t, CASE WHEN t - lag(t) OVER (PARTITION BY star ORDER BY t) > {GAP} THEN 1 ELSE 0 END AS fresh FROM c),
 q AS (SELECT star, t, sum(fresh) OVER (PARTITION BY star ORDER BY t) AS run FROM g), r AS (SELECT star, min(t) AS begins, max(t) AS ends FROM q GROUP BY star, run)"""


def data_runs(d):
    from starloom.operators.chunks import runs

    return runs(d.select("star", "t"), GAP, 30.0).select("star", "begins", "ends").distinct()


def strong_dips(d):
    return d.where("flux > 120").selectExpr("star", "event_id", "t tc", "cast(0.25 + event_id % 4 * 0.25 as double) duration")


#: Every transit of every candidate is listed and held against every run.
COVERED = "least(r.ends, k.at + duration / 2) - greatest(r.begins, k.at - duration / 2) >= duration / 2"


@query(f"{DIPS}{BEGUN}, p AS (SELECT u.*, CAST(unnest([1.5, 2.75, 7.0, 23.0]) AS DOUBLE) AS period FROM u), k AS (SELECT p.*, tc + i * period AS at FROM (SELECT *, unnest(range(-30, 31)) AS i FROM p) p WHERE i <> 0) SELECT p.event_id, p.period, count(k.at) FILTER (WHERE r.star IS NOT NULL) AS n_covered, count(k.at) FILTER (WHERE r.star IS NOT NULL) = 0 AS allowed FROM p LEFT JOIN (k LEFT JOIN r ON r.star = k.star AND {COVERED}) ON p.event_id = k.event_id AND p.period = k.period GROUP BY 1, 2")
def periods_allowed(d):
    """Trial periods of strong rows, and how many other transits each would have put on the star's data."""
    from starloom.operators.known import allowed_periods

    c = strong_dips(d).withColumn("period", F.explode(F.array(*map(F.lit, (1.5, 2.75, 7.0, 23.0)))))
    return allowed_periods(c, data_runs(d)).select("event_id", "period", "n_covered", "allowed")


@query(f"{DIPS}{BEGUN}, o AS (SELECT *, row_number() OVER (PARTITION BY star ORDER BY tc, event_id) AS i FROM u), w AS (SELECT a.star, a.event_id AS pair, a.tc, b.tc AS second, a.duration FROM o a JOIN o b ON a.star = b.star AND b.i = a.i + 1 WHERE b.tc - a.tc >= 1), p AS (SELECT *, (second - tc) / n AS period FROM (SELECT *, unnest(range(1, CAST(floor(second - tc) AS BIGINT) + 1)) AS n FROM w)), k AS (SELECT p.*, tc + i * period AS at FROM (SELECT *, unnest(range(-31, 62)) AS i FROM p) p WHERE i <> 0 AND i <> n) SELECT p.pair, p.n, " + sql_r("any_value(p.period)") + f" AS period, count(k.at) FILTER (WHERE r.star IS NOT NULL) AS n_covered, count(k.at) FILTER (WHERE r.star IS NOT NULL) = 0 AS allowed FROM p LEFT JOIN (k LEFT JOIN r ON r.star = k.star AND {COVERED}) ON p.pair = k.pair AND p.n = k.n GROUP BY 1, 2")
def aliases_against_coverage(d):
    """Periods that two neighbouring strong rows of a star allow."""
    from pyspark.sql import Window

    from starloom.operators.known import pair_aliases

    w = Window.partitionBy("star").orderBy("tc", "event_id")
    pairs = strong_dips(d).withColumn("second", F.lead("tc").over(w)).where("second is not null").select("star", F.col("event_id").alias("pair"), F.col("tc").alias("first"), "second", "duration")
    return pair_aliases(pairs, data_runs(d)).select("pair", "n", rounded(F.col("period")).alias("period"), "n_covered", "allowed")


@query(None)
def period_posteriors(d):
    """5, 50 and 95 % of the period of each strong row taken as a dip, by its own seeded draws."""
    from starloom.operators.known import period_posterior

    dips_of = d.where("flux > 150").selectExpr("event_id event", "0.1D + event_id % 5 * 0.05D duration", "0.001D * (1 + event_id % 9) depth", "0.5D + star % 4 * 0.5D density", "CASE WHEN star % 2 = 0 THEN 0.25D ELSE 0.5D END density_err")
    return period_posterior(dips_of, draws=20_000)


SKY = "(SELECT {k} AS id, {k} * 7919 % 36000 / 100.0::DOUBLE AS ra, {k} * 104729 % 18000 / 100.0::DOUBLE - 90 AS dec FROM {t})"
FOOTPRINTS = f"""WITH s AS (SELECT id AS star, radians(ra) AS ra, radians(dec) AS dec FROM {SKY.format(k='c_custkey', t='customer')}),
 k AS (SELECT id % 13 AS sector, radians(ra) AS ca, radians(dec) AS cd, radians(id * 37 % 360) AS roll FROM {SKY.format(k='s_suppkey', t='supplier')}),
 v AS (SELECT star, sector, roll, cos(dec) * sin(ra - ca) AS e, sin(dec) * cos(cd) - cos(dec) * sin(cd) * cos(ra - ca) AS n, sin(dec) * sin(cd) + cos(dec) * cos(cd) * cos(ra - ca) AS z FROM s, k),
 p AS (SELECT star, sector, z, abs((e * cos(roll) + n * sin(roll)) / z) AS x, abs((n * cos(roll) - e * sin(roll)) / z) AS y FROM v)
SELECT DISTINCT star, sector FROM p WHERE z > cos(radians(20)) AND x <= tan(radians(12)) AND y <= tan(radians(12)) AND x >= tan(radians(0.3)) AND y >= tan(radians(0.3))"""


def footprints(spark, sf_dir):
    """Sectors whose cameras (placed by supplier) saw each star (placed by customer)."""
    from starloom.operators.known import observed
    from starloom.plans.catalogues import placed

    cameras = placed(table(spark, sf_dir, "supplier"), "s_suppkey").withColumns({"sector": F.col("id") % 13, "roll": F.col("id") * 37 % 360})
    return observed(placed(table(spark, sf_dir, "customer"), "c_custkey").withColumnRenamed("id", "star"), cameras)


QUERIES["footprints"], ORACLES["footprints"] = footprints, FOOTPRINTS


#: Each star's own ephemeris, and where its rows stand to it.
OWN = """, g AS (SELECT star, 2.0 + star % 5 * 0.5 AS period, 1.0 + star % 3 * 0.25 AS t0, 0.6 + star % 2 * 0.2 AS duration, 1 AS signal FROM (SELECT DISTINCT star FROM c)),
 r AS (SELECT c.star, signal, t, flux, period, duration, abs((((t - t0 + period / 2) % period) + period) % period - period / 2) AS away, CAST(round_even((t - t0) / period, 0) AS BIGINT) AS epoch FROM c JOIN g ON c.star = g.star WHERE flux IS NOT NULL)"""


def noise_sql(name: str, rows: str) -> str:
    return f""", {name}0 AS (SELECT *, floor((t - min(t) OVER (PARTITION BY star)) / duration) AS bin FROM r WHERE {rows}), {name}1 AS (SELECT star, bin, avg(flux) AS mean, count(*) AS k FROM {name}0 GROUP BY 1, 2),
 {name}2 AS (SELECT *, median(k) OVER (PARTITION BY star) AS usual FROM {name}1), {name}3 AS (SELECT star, any_value(usual) AS usual, median(k) AS usual_full, count(*) AS bins, 1.4826 * mad(mean) AS bin_sigma FROM {name}2 WHERE k >= 0.5 * usual GROUP BY star),
 {name} AS (SELECT x.star, n, middle, sigma, usual, usual_full, bins, bin_sigma, CASE WHEN n > 50 AND bins >= 10 AND sigma > 0 THEN greatest(1.0, bin_sigma / (sigma / sqrt(usual_full))) ELSE 1.0 END AS beta FROM (SELECT star, count(*) AS n, median(flux) AS middle, 1.4826 * mad(flux) AS sigma FROM {name}0 GROUP BY star) x JOIN {name}3 USING (star))"""


INSIDE = "away < duration / 2"
STATS = (
    OWN
    + noise_sql("w", "away >= duration")
    + noise_sql("v", "away >= 0.75 * duration")
    + f""", s AS (SELECT star, avg(flux) FILTER ({INSIDE}) AS m_in, count(*) FILTER ({INSIDE}) AS n_in, avg(flux) FILTER (NOT {INSIDE}) AS m_out, count(*) FILTER (NOT {INSIDE}) AS n_out, avg(flux) FILTER ({INSIDE} AND epoch % 2 <> 0) AS m_odd, count(*) FILTER ({INSIDE} AND epoch % 2 <> 0) AS n_odd, avg(flux) FILTER ({INSIDE} AND epoch % 2 = 0) AS m_even, count(*) FILTER ({INSIDE} AND epoch % 2 = 0) AS n_even,
 count(DISTINCT epoch) FILTER ({INSIDE}) AS n_transits, CASE WHEN mad(flux) > 0 THEN 1.4826 * mad(flux) ELSE 1e-3 END AS dy FROM r GROUP BY star),
 z AS (SELECT s.*, coalesce(v.beta, 1.0) * dy AS scale, CASE WHEN w.n >= 20 THEN greatest(CASE WHEN w.bins > 10 THEN w.bin_sigma ELSE w.sigma END, w.sigma / sqrt(w.usual)) END AS spread FROM s LEFT JOIN v ON s.star = v.star LEFT JOIN w ON s.star = w.star WHERE n_in > 0 AND n_out > 0)"""
)


def own_signals(d):
    return d.select("star").distinct().selectExpr("star", "1 AS signal", "2.0D + star % 5 * 0.5D AS period", "1.0D + star % 3 * 0.25D AS t0", "0.6D + star % 2 * 0.2D AS duration")


def shortened(e, *names):
    return e.withColumns({n: rounded(F.col(n), 3) for n in names})


@query(STATS + " SELECT star, " + ", ".join(sql_r(x, 3) + f" AS {n}" for n, x in {"depth": "m_out - m_in", "depth_err": "scale * sqrt(1.0 / n_in + 1.0 / n_out)", "odd": "m_out - m_odd", "odd_err": "CASE WHEN n_odd > 0 THEN scale * sqrt(1.0 / n_odd + 1.0 / n_out) END", "even": "m_out - m_even", "even_err": "CASE WHEN n_even > 0 THEN scale * sqrt(1.0 / n_even + 1.0 / n_out) END", "snr": "CASE WHEN spread > 0 THEN (m_out - m_in) / (spread / sqrt(n_transits)) ELSE 0.0 END"}.items()) + ", n_transits FROM z")
def signal_statistics(d):
    """Depths, errors with red noise, transits and SNR of a signal on each star, each at its own ephemeris."""
    from starloom.operators.measure import statistics

    return shortened(statistics(d.where("flux is not null"), own_signals(d)), "depth", "depth_err", "odd", "odd_err", "even", "even_err", "snr").drop("signal")


NEAR = "away > 0.75 * duration AND away < least(2.5 * duration, 0.45 * period)"


@query(OWN + noise_sql("v", "away >= 0.75 * duration") + f", e AS (SELECT star, epoch, count(*) FILTER ({INSIDE}) AS n_in, avg(flux) FILTER ({INSIDE}) AS m_in, count(*) FILTER ({NEAR}) AS n_near, median(flux) FILTER ({NEAR}) AS local FROM r GROUP BY 1, 2), a AS (SELECT star, 1.4826 * mad(flux) AS every FROM r GROUP BY star), q AS (SELECT e.*, coalesce(middle, 1.0) AS base, CASE WHEN coalesce(v.n, 0) > 10 THEN sigma ELSE every END * coalesce(beta, 1.0) AS scale FROM e JOIN a USING (star) LEFT JOIN v USING (star) WHERE n_in >= 3) SELECT star, epoch, n_in, " + sql_r("CASE WHEN n_near >= 5 THEN local ELSE base END - m_in", 3) + " AS depth, " + sql_r("scale * sqrt(1.0 / n_in + CASE WHEN n_near >= 5 THEN 1.0 / n_near ELSE 0 END)", 3) + " AS err FROM q")
def signal_epochs(d):
    """Depth of every epoch of each star's own signal against its local baseline, else against all rows out of transit."""
    from starloom.operators.measure import epoch_depths

    return shortened(epoch_depths(d.where("flux is not null"), own_signals(d)), "depth", "err").drop("signal")


@query(None)
def searched_and_judged(d):
    """From search to failed stage in one plan: each star's best box, measured at its own ephemeris and put through the stages."""
    from starloom.operators import curves as ops
    from starloom.operators import measure
    from starloom.operators.kernels import box_search
    from starloom.operators.shared import checkpointed

    d = d.where("flux is not null")
    found = checkpointed(box_search(d, 1.0, 8.0)).withColumn("signal", F.lit(1))
    stats = checkpointed(measure.statistics(d, found))
    parity = measure.odd_even(stats, measure.epoch_depths(d, found))
    j = stats.join(found.select(F.col("star").alias("f_star"), "period", "t0", "duration", "sde"), F.col("star").eqNullSafe(F.col("f_star"))).drop("f_star")
    j = j.join(parity.select(F.col("star").alias("p_star"), "sigmas"), F.col("star").eqNullSafe(F.col("p_star")), "left").drop("p_star")
    j = j.withColumns({"n_failed": F.coalesce((F.col("sigmas") > measure.ODD_EVEN_SIGMA).cast("int"), F.lit(0)), "known": F.lit(False), "neighbour": F.lit(False)})
    return j.withColumn("failed_stage", ops.failed_stage(3.0, 3.0, 30.0, 3)).drop("known", "neighbour", "signal")


@query("SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'tic' WHEN 2 THEN 'missing: t0_btjd' WHEN 3 THEN 'duration_h' WHEN 4 THEN 'period_d' WHEN 5 THEN 'not an object' WHEN 6 THEN 'id' END AS reason, CASE WHEN event_id % 8 IN (0, 7) THEN (1 + event_id % 9) / 2.0 END AS best_radius, CASE WHEN event_id % 8 IN (0, 7) THEN 1 END AS checks_passed, CASE WHEN event_id % 8 IN (0, 7) THEN 2 END AS checks_total FROM c")
def record_reasons(d):
    """Nested records of every row, judged; the SQL knows how each was spoilt."""
    from starloom.operators.records import judged

    e = F.col("event_id") % 8
    text = F.format_string(
        '{"tic": %s, "t0_btjd": %s, "duration_h": %s, "period_d": %s, "checks": [{"passed": true}, {"passed": null}, {"passed": false}], "radius_low": 1, "radius_high": %s}',
        (F.col("star") + (e == 1).cast("int")).cast("string"), F.when(e == 2, F.lit('"1.5"')).otherwise(F.lit("1.5")), F.when(e == 3, F.lit("0")).otherwise(F.lit("2.5")), F.when(e == 4, F.lit("-1")).when(e == 7, F.lit("null")).otherwise(F.lit("3")), (F.col("event_id") % 9).cast("string"),
    )
    d = d.select("event_id", F.concat(F.col("star").cast("string"), F.when(e == 6, F.lit("-1")).otherwise(F.lit("_1"))).alias("id"), F.when(e == 5, F.lit("[1, NaN")).otherwise(text).alias("record"))
    return judged(d).select("event_id", "reason", "best_radius", "checks_passed", "checks_total")
