"""Queries on events as light curves: user = star, event type = sector."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.astro import in_transit, rounded
from starloom.operators import curves as ops
from starloom.operators import shaped
from starloom.sources.tables import curve, table

PERIOD, T0, DURATION = 3.0, 1.0, 0.6

C = "WITH c AS (SELECT event_id, user_id AS star, event_type AS sector, epoch_us(ts) / 86400e6 AS t, value AS flux FROM events) "
PHASE = f"(((t - {T0} + {PERIOD} / 2) % {PERIOD}) + {PERIOD}) % {PERIOD} - {PERIOD} / 2"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def sql_r(x: str, digits: int = 4) -> str:
    k = f"1e{digits}"
    return f"(floor(({x}) * {k} + 0.500001) / {k})"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(curve(table(spark, sf_dir, "events")))
        if sql:
            ORACLES[f.__name__] = C.rstrip() + sql if sql.startswith(",") else C + sql
        return f

    return add


SIGNALS = f""", m AS (SELECT star, sector, flux, median(flux) OVER (PARTITION BY star, sector) AS med FROM c),
 s AS (SELECT star, sector, any_value(med) AS med, min(flux) AS lo, max(flux) AS hi, 1.4826 * median(abs(flux - med)) AS sigma, count(*) AS n FROM m GROUP BY star, sector),
 k AS (SELECT *, (med - lo) / sigma AS snr, (hi - med) / sigma AS sde FROM s WHERE sigma > 0),
 g AS (SELECT sector AS kind, CASE WHEN snr < 1 THEN 'snr' WHEN sde < 1.2 AND snr < 4 THEN 'sde' WHEN n < 6 THEN 'transits' WHEN star % 7 = 0 THEN 'checks' WHEN star % 5 = 0 THEN 'known' WHEN star % 11 = 0 THEN 'neighbour' END AS failed_stage FROM k),
 st(step, stage) AS (VALUES (1, 'snr'), (2, 'sde'), (3, 'transits'), (4, 'checks'), (5, 'known'), (6, 'neighbour')),
 t AS (SELECT kind, count(*) AS n_all FROM g GROUP BY kind),
 d AS (SELECT t.kind, st.step, st.stage, (SELECT count(*) FROM g WHERE g.kind = t.kind AND g.failed_stage = st.stage) AS dropped, n_all FROM t, st)
SELECT kind, step, stage, dropped, CAST(n_all - sum(dropped) OVER (PARTITION BY kind ORDER BY step) AS BIGINT) AS "left" FROM d"""


@query(SIGNALS)
def flagship_funnel(d: DataFrame) -> DataFrame:
    m = d.withColumn("med", F.median("flux").over(ops.over(ops.SECTOR)))
    s = m.groupBy("star", "sector").agg(F.first("med").alias("med"), F.min("flux").alias("lo"), F.max("flux").alias("hi"), (F.median(F.abs(F.col("flux") - F.col("med"))) * 1.4826).alias("sigma"), F.count("*").alias("n_transits")).where("sigma > 0")
    k = s.selectExpr("sector kind", "(med - lo) / sigma snr", "(hi - med) / sigma sde", "n_transits", "cast(star % 7 = 0 as int) n_failed", "star % 5 = 0 known", "star % 11 = 0 neighbour")
    return ops.funnel(k.withColumn("failed_stage", ops.failed_stage(1.0, 1.2, 4.0, 6)))


@query("SELECT sector, count(*) AS n, median(flux) AS median, " + sql_r("1.4826 * mad(flux)") + " AS sigma FROM c GROUP BY sector")
def robust_sigma(d):
    return ops.robust_sigma(d, ("sector",)).withColumn("sigma", rounded(F.col("sigma")))


@query(", m AS (SELECT *, median(flux) OVER (PARTITION BY sector) AS med FROM c), k AS (SELECT *, 1.4826 * median(abs(flux - med)) OVER (PARTITION BY sector) AS s FROM m) SELECT event_id, flux FROM k WHERE flux < med + 3 * s")
def clip_upward(d):
    return ops.clip_upward(d, ("sector",)).select("event_id", "flux")


@query("SELECT event_id, " + sql_r("flux / median(flux) OVER (PARTITION BY star, sector)") + " AS flux FROM c")
def sector_normalise(d):
    return ops.median_normalised(d).select("event_id", rounded(F.col("flux")).alias("flux"))


@query(", b AS (SELECT *, CAST(floor((t - min(t) OVER (PARTITION BY star, sector)) / 2.0) AS BIGINT) AS bin FROM c) SELECT star, sector, bin, count(*) AS n, " + sql_r("avg(t)") + " AS t, " + sql_r("avg(flux)", 3) + " AS flux FROM b GROUP BY star, sector, bin")
def time_bins(d):
    return ops.time_bins(d, 2.0).select("star", "sector", "bin", "n", rounded(F.col("t")).alias("t"), rounded(F.col("flux"), 3).alias("flux"))


@query(", p AS (SELECT star, flux, row_number() OVER (PARTITION BY star ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY star) AS n FROM c) SELECT star, CAST(floor(i * least(20, n) / n) AS BIGINT) AS bin, min(flux) AS flux FROM p GROUP BY ALL")
def bins_min_spark(d):
    return ops.least_of_bins(d, 20)


@query(", s AS (SELECT star, 0.5 * ceil(count(DISTINCT floor(t / 0.5)) / 10.0) AS width FROM c GROUP BY star), b AS (SELECT c.star, width, flux, CAST(floor((t - min(t) OVER (PARTITION BY c.star)) / width) AS BIGINT) AS bin FROM c JOIN s USING (star)) SELECT star, width, bin, count(*) AS n, " + sql_r("avg(flux)", 3) + " AS flux FROM b GROUP BY star, width, bin")
def adaptive_bins(d):
    return ops.adaptive_bins(d, 10, 0.5).select("star", "width", "bin", "n", rounded(F.col("flux"), 3).alias("flux"))


@query(f"SELECT sector, CAST(floor(((((t - {T0}) / {PERIOD}) % 1.0) + 1.0) % 1.0 * 20) AS BIGINT) AS bin, count(*) AS n, " + sql_r("avg(flux)", 3) + " AS flux FROM c GROUP BY ALL")
def phase_fold_bins(d):
    return ops.folded_bins(d, PERIOD, T0, 20, ("sector",)).select("sector", "bin", "n", rounded(F.col("flux"), 3).alias("flux"))


SEGMENTS = ", g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY star ORDER BY t) > 0.75 THEN 1 ELSE 0 END AS new FROM c), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY star ORDER BY t) AS BIGINT) AS segment FROM g) "


@query(SEGMENTS + "SELECT event_id, segment FROM s")
def gap_segments(d):
    return ops.segments(d, 0.75).select("event_id", "segment")


@query(SEGMENTS + "SELECT star, segment, min(t) AS begins, max(t) AS ends, count(*) AS n FROM s GROUP BY star, segment")
def segment_edges(d):
    return ops.segment_edges(d, 0.75)


@query(", s AS (SELECT star, sector, t - lag(t) OVER (PARTITION BY star, sector ORDER BY t) AS step FROM c) SELECT star, sector, " + sql_r("median(step)", 6) + " AS cadence FROM s GROUP BY star, sector")
def median_cadence(d):
    return ops.median_cadence(d).withColumn("cadence", rounded(F.col("cadence"), 6))


@query(", s AS (SELECT event_id, star, t, coalesce(least(t - lag(t) OVER (PARTITION BY star ORDER BY t), 0.5), 0.0) AS step FROM c) SELECT event_id, " + sql_r("sum(step) OVER (PARTITION BY star ORDER BY t)") + " AS x FROM s")
def gap_axis(d):
    return ops.gap_axis(d, 0.5).select("event_id", rounded(F.col("x")).alias("x"))


@query("SELECT event_id, count(flux) OVER w AS n_box, " + sql_r("avg(flux) OVER w", 3) + " AS mean_box FROM c WINDOW w AS (PARTITION BY star ORDER BY t RANGE BETWEEN 1.0 PRECEDING AND 1.0 FOLLOWING)")
def box_range_frame(d):
    return ops.boxes(d, 2.0).select("event_id", "n_box", rounded(F.col("mean_box"), 3).alias("mean_box"))


@query("SELECT event_id, " + sql_r("quantile_cont(flux, 0.5) OVER (PARTITION BY star ORDER BY t RANGE BETWEEN 1.5 PRECEDING AND 1.5 FOLLOWING)") + " AS trend FROM c")
def running_median(d):
    return ops.running_median(d, 3.0).select("event_id", rounded(F.col("trend")).alias("trend"))


@query(", m AS (SELECT event_id, avg(flux) OVER w AS mean, max(t) OVER w - t AS span, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY star ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT event_id, " + sql_r("mean", 3) + " AS mean FROM m WHERE n = 5 AND span <= 3.0")
def moving_mean_rows(d):
    return ops.moving_means(d, 5, 3.0).select("event_id", rounded(F.col("mean"), 3).alias("mean"))


@query("SELECT event_id, bool_or(flux > 150) OVER (PARTITION BY star ORDER BY t RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) AS flag FROM c")
def mask_dilate(d):
    return ops.dilated(d.withColumn("flag", F.col("flux") > 150), "flag", 1.0).select("event_id", "flag")


@query(", p AS (SELECT star, t, flux, row_number() OVER (PARTITION BY star ORDER BY t) AS place FROM c), h AS (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY star ORDER BY t) > 2 THEN 1 ELSE 0 END AS new FROM p WHERE flux > 60), i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY star ORDER BY t) AS BIGINT) AS island FROM h) SELECT star, island, count(*) AS n, min(t) AS begins, max(t) AS ends, max(flux) AS peak FROM i GROUP BY star, island HAVING count(*) >= 2")
def threshold_islands(d):
    return ops.islands(d, 60.0, 1, 2)


@query(f"SELECT event_id FROM c WHERE abs({PHASE}) < {DURATION} / 2")
def in_transit_phase(d):
    return d.where(in_transit(F.col("t"), F.lit(PERIOD), F.lit(T0), F.lit(DURATION))).select("event_id")


EPOCHS = f""", q AS (SELECT sector AS star, CAST(round_even((t - {T0}) / {PERIOD}, 0) AS BIGINT) AS epoch, flux, abs({PHASE}) AS x FROM c),
 e0 AS (SELECT star, epoch, count(*) FILTER (x < {DURATION} / 2) AS n_in, count(*) FILTER (x >= 1.5 * {DURATION} / 2 AND x < 3.0 * {DURATION}) AS n_base, avg(flux) FILTER (x < {DURATION} / 2) AS m_in, avg(flux) FILTER (x >= 1.5 * {DURATION} / 2 AND x < 3.0 * {DURATION}) AS m_base, stddev_samp(flux) FILTER (x >= 1.5 * {DURATION} / 2 AND x < 3.0 * {DURATION}) AS sd FROM q GROUP BY star, epoch),
 e AS (SELECT star, epoch, n_in, n_base, m_base - m_in AS depth, sd / sqrt(n_in) AS err FROM e0 WHERE n_in >= 3 AND n_base >= 3 AND sd > 0) """
MEAN = "count(*) AS n, " + sql_r("sum(depth / (err * err)) / sum(1 / (err * err))", 3) + " AS mean, " + sql_r("1 / sqrt(sum(1 / (err * err)))", 3) + " AS mean_err"


def sector_epochs(d):
    return ops.epochs(d.withColumn("star", F.col("sector")), PERIOD, T0, DURATION)


def short(e):
    return e.withColumns({"mean": rounded(F.col("mean"), 3), "mean_err": rounded(F.col("mean_err"), 3)})


@query(EPOCHS + "SELECT star, epoch, n_in, n_base, " + sql_r("depth", 3) + " AS depth, " + sql_r("err", 3) + " AS err FROM e")
def epoch_depths(d):
    return sector_epochs(d).withColumns({"depth": rounded(F.col("depth"), 3), "err": rounded(F.col("err"), 3)})


@query(EPOCHS + "SELECT star, ((epoch % 2) + 2) % 2 AS parity, " + MEAN + " FROM e GROUP BY ALL")
def odd_even(d):
    return short(ops.odd_even(sector_epochs(d)))


@query(EPOCHS + ", r AS (SELECT *, row_number() OVER (PARTITION BY star ORDER BY depth / err DESC, epoch) AS rank FROM e) SELECT star, " + MEAN + " FROM r WHERE rank > 1 GROUP BY star")
def leave_best_out(d):
    return short(ops.without_strongest(sector_epochs(d)))


@query(EPOCHS + "SELECT star, CAST(k AS INT) AS k, ((epoch % k) + k) % k AS part, " + MEAN + " FROM e, (VALUES (2), (3)) v(k) GROUP BY ALL")
def alias_groups(d):
    return short(ops.alias_groups(sector_epochs(d)))


@query("SELECT sector, count(*) AS n, " + sql_r("sum(flux / (1 + star % 3)) / sum(1 / (1 + star % 3))", 3) + " AS mean FROM c GROUP BY sector")
def weighted_mean_by_group(d):
    return ops.weighted_mean(d.withColumn("e", F.sqrt(1 + F.col("star") % 3)), ["sector"], "flux", "e").select("sector", "n", rounded(F.col("mean"), 3).alias("mean"))


@query(", b0 AS (SELECT star, flux, floor((t - min(t) OVER (PARTITION BY star)) / 1.0) AS bin FROM c), b AS (SELECT star, bin, avg(flux) AS f, count(*) AS n FROM b0 GROUP BY star, bin), s AS (SELECT star, count(*) AS bins, 1.4826 * mad(f) AS bs, median(n) AS typical FROM b GROUP BY star), w AS (SELECT star, 1.4826 * mad(flux) AS sigma FROM c GROUP BY star) SELECT star, bins, " + sql_r("greatest(1.0, bs / (sigma / sqrt(typical)))", 3) + " AS factor FROM s JOIN w USING (star) WHERE sigma > 0")
def red_noise_factor(d):
    return ops.red_noise(d, 1.0).withColumn("factor", rounded(F.col("factor"), 3))


@query("SELECT sector, 0.5 * count(DISTINCT floor(t / 0.5)) AS days FROM c GROUP BY sector")
def days_with_data(d):
    return d.groupBy("sector").agg((F.countDistinct(F.floor(F.col("t") / 0.5)) * 0.5).alias("days"))


@query("SELECT star, count(DISTINCT sector) AS n_sectors, max(t) - min(t) AS baseline, array_to_string(list_sort(list(DISTINCT sector)), ' ') AS sectors FROM c GROUP BY star")
def stitch_summary(d):
    return d.groupBy("star").agg(F.countDistinct("sector").alias("n_sectors"), (F.max("t") - F.min("t")).alias("baseline"), F.array_join(F.array_sort(F.collect_set("sector")), " ").alias("sectors"))


@query(None)
def bls_best_period(d):
    from starloom.operators.kernels import box_search, inject

    return box_search(inject(d, PERIOD, T0, DURATION, 0.5), 1.0, 8.0)


@query(None)
def staged_best_period(d):
    """The same curves searched in two stages: likelihoods summed over event types as sectors, then a grid for the whole baseline."""
    from starloom.operators.kernels import inject
    from starloom.operators.staged import staged_search

    return staged_search(inject(d, PERIOD, T0, DURATION, 0.5), 1.0, 8.0, (0.3, 0.45, 0.6, 0.8), star_rows=20, sector_rows=5)


@query(None)
def shaped_best_period(d):
    """The same curves searched for transits of a star's shape and duration, in their newest event types within a budget."""
    from starloom.operators.kernels import inject

    return shaped.shaped_search(inject(d, PERIOD, T0, DURATION, 0.5), masses(d), budget=0.04, star_rows=20)


def masses(d):
    return d.select("star").distinct().selectExpr("star", "0.5D + star % 4 * 0.5D mass", "0.5D + star % 3 * 0.5D radius")


GRID = {k: f"({v!r}::DOUBLE)" for k, v in {"step": (2 * math.pi) ** (2 / 3) / math.pi / 3 * shaped.SUN_RADIUS / (shaped.GRAVITY * shaped.SUN_MASS) ** (1 / 3) * shaped.DAY ** (-2 / 3) / shaped.OVERSAMPLE, "top": (1 / shaped.LEAST_PERIOD) ** (1 / 3)}.items()}


@query(f""", s AS (SELECT star, sector, count(*) AS rows, min(t) AS a, max(t) AS z FROM c WHERE flux IS NOT NULL GROUP BY star, sector),
 w AS (SELECT *, sum(rows) OVER k AS every, max(z) OVER k - min(a) OVER k AS span, row_number() OVER k AS i, 0.5 + star % 4 * 0.5 AS mass, 0.5 + star % 3 * 0.5 AS radius FROM s WINDOW k AS (PARTITION BY star ORDER BY z DESC, sector DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 g AS (SELECT *, pow(1 / greatest(span / 2, {shaped.LEAST_PERIOD * 1.01}::DOUBLE), 1.0 / 3) AS root, {GRID['step']} * radius / pow(mass, 1.0 / 3) / greatest(span, 1) AS step FROM w),
 x AS (SELECT *, every * (ceil(({GRID['top']} - root) / step) + 1) / {shaped.RATE} AS cost FROM g)
 SELECT star, sector, rows, {sql_r('cost', 6)} AS cost, i = 1 OR max(cost) OVER (PARTITION BY star ORDER BY i) <= 0.02 AS used FROM x""")
def budgeted_sectors(d):
    return shaped.within_budget(d, masses(d), budget=0.02).withColumn("cost", rounded(F.col("cost"), 6))


@query(None)
def repeated_signals(d):
    """Up to two signals of each curve with a box transit put in: the second from the rows off the first."""
    from starloom.operators.kernels import inject, repeated_search

    return repeated_search(inject(d, PERIOD, T0, DURATION, 0.7), 1.0, 8.0, signals=2, least_sde=3.0)


@query(None)
def dip_events(d):
    """Rows far below their star's running median, each at least half a day from all stronger ones."""
    from starloom.operators.kernels import strongest_apart

    trend = ops.running_median(d, 3.0).select("star", "t", (F.col("trend") - F.col("flux")).alias("strength"))
    return strongest_apart(trend.where("strength > 20"), 0.5)


@query(None)
def biweight_by_sector(d):
    from starloom.operators.kernels import biweight_location

    return biweight_location(d, ["star", "sector"])


@query(None)
def injection_recovery(d):
    """Box transits of three depths put into every curve, searched for again: rates by depth."""
    from starloom.operators.kernels import box_search, inject

    found = None
    for depth in (0.3, 0.6, 0.9):
        one = box_search(inject(d, PERIOD, T0, DURATION, depth), 2.0, 5.0).withColumn("depth_in", F.lit(depth))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("depth_in").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("period") / PERIOD - 1) < 0.01).alias("recovered"))


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](spark, sf_dir)
