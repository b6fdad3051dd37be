"""Queries on pixel series, backgrounds, clipped fits and service states, made of events and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions.astro import rounded
from starloom.operators import pixels as px
from starloom.operators import scatter as sc
from starloom.plans.curves import DURATION, PERIOD, PHASE, T0, C, sql_r
from starloom.sources.tables import curve, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, source: str = "events"):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(curve(table(spark, sf_dir, "events")) if source == "events" else table(spark, sf_dir, source))
        ORACLES[f.__name__] = sql if source != "events" else C.rstrip() + sql
        return f

    return add


#: Four pixels of each event: some without a flux, some frames with quality bits.
P = ', p AS (SELECT star, event_id AS frame, t, v.r AS "row", v.k AS col, CASE WHEN (event_id + v.r + 2 * v.k) % 5 < 1 + event_id % 4 - 1 THEN NULL ELSE flux * (1 + v.r) + (event_id * (v.k + 3)) % 17 END AS flux, CASE WHEN event_id % 11 = 0 THEN 4 ELSE 16 END AS quality FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(r, k))'


def pixels(d):
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(k).alias("col")) for r in (0, 1) for k in (0, 1)]))
    p = d.select("star", F.col("event_id").alias("frame"), "t", "flux", cells.alias("v")).select("*", "v.*")
    flux = "CASE WHEN (frame + row + 2 * col) % 5 < frame % 4 THEN NULL ELSE flux * (1 + row) + (frame * (col + 3)) % 17 END"
    return p.withColumns({"flux": F.expr(flux), "quality": F.when(F.col("frame") % 11 == 0, 4).otherwise(16)}).drop("v")


GOOD = " SELECT star, frame FROM p WHERE (quality & 4) = 0 GROUP BY star, frame HAVING count(flux) > 0.5 * count(*)"


@query(P + GOOD)
def good_frames(d):
    return px.good_frames(pixels(d))


NOISE = ', s AS (SELECT star, "row", col, flux - lag(flux) OVER (PARTITION BY star, "row", col ORDER BY t, frame) AS step FROM p), z AS (SELECT star, "row", col, pow(1.4826 * mad(step) / sqrt(2), 2) AS var FROM s WHERE step IS NOT NULL GROUP BY star, "row", col)'


@query(P + NOISE + ' SELECT star, "row", col, ' + sql_r("var", 2) + " AS var FROM z")
def frame_noise(d):
    return px.frame_noise(pixels(d)).withColumn("var", rounded(F.col("var"), 2))


INNER, OUTER = px.INNER * DURATION, min(px.INNER * DURATION + max(DURATION, px.LEAST_SIDE), PERIOD / 2)
IMAGES = f""", q AS (SELECT *, {PHASE} AS away, floor((t - {T0}) / {PERIOD} + 0.5) AS epoch FROM p),
 e AS (SELECT star, "row", col, epoch, avg(flux) FILTER (i) AS mi, count(flux) FILTER (i) AS ni, avg(flux) FILTER (b) AS mb, count(flux) FILTER (b) AS nb, avg(flux) FILTER (a) AS ma, count(flux) FILTER (a) AS na FROM (SELECT *, abs(away) < {px.INSIDE * DURATION} AS i, away BETWEEN -{OUTER} AND -{INNER} AS b, away BETWEEN {INNER} AND {OUTER} AS a FROM q) GROUP BY ALL),
 f AS (SELECT star, "row", col, (mb + ma) / 2 - mi AS diff, var * (1.0 / ni + 0.25 / nb + 0.25 / na) AS v FROM e JOIN z USING (star, "row", col) WHERE ni > 0 AND nb > 0 AND na > 0),
 g AS (SELECT star, "row", col, count(*) AS n_transits, avg(diff) AS diff, sum(v) / (count(*) * count(*)) AS var, var_samp(diff) / count(*) AS emp FROM f GROUP BY ALL),
 h AS (SELECT star, median(emp / var) AS ratio FROM g WHERE n_transits >= 2 AND var > 0 GROUP BY star)
 SELECT star, "row", col, n_transits, {sql_r('diff', 2)} AS diff, {sql_r('var * CASE WHEN n_transits >= 2 THEN greatest(1.0, coalesce(ratio, 1.0)) ELSE 1 END', 1)} AS var FROM g LEFT JOIN h USING (star)"""


@query(P + NOISE + IMAGES)
def difference_images(d):
    """Few transits a pixel here, so two are enough to scale."""
    p = pixels(d)
    images = px.difference_images(p, px.frame_noise(p), PERIOD, T0, DURATION, many=2)
    return images.withColumns({"diff": rounded(F.col("diff"), 2), "var": rounded(F.col("var"), 1)})


OFFSETS = ", o AS (SELECT star, sector, avg(flux) / 100 AS e, min(flux) / 50 AS n, 1.0 + count(*) % 3 AS ee, 0.2 AS en, 2.0 + count(*) % 2 AS nn FROM c GROUP BY star, sector), w AS (SELECT star, e, n, nn / (ee * nn - en * en) AS a, -en / (ee * nn - en * en) AS b, ee / (ee * nn - en * en) AS k FROM o), s AS (SELECT star, count(*) AS sectors, sum(a) AS a, sum(b) AS b, sum(k) AS k, sum(a * e + b * n) AS x, sum(b * e + k * n) AS y, sum(a * e * e + 2 * b * e * n + k * n * n) AS own FROM w GROUP BY star), m AS (SELECT *, (k * x - b * y) / (a * k - b * b) AS e, (a * y - b * x) / (a * k - b * b) AS n FROM s), j AS (SELECT *, CASE WHEN sectors > 1 THEN greatest(own - e * x - n * y, 0) / (2 * (sectors - 1)) ELSE 1 END AS chi2 FROM m), r AS (SELECT star, sectors, e, n, chi2, greatest(1, chi2) * k / (a * k - b * b) AS ee, -greatest(1, chi2) * b / (a * k - b * b) AS en, greatest(1, chi2) * a / (a * k - b * b) AS nn FROM j)"


def offsets(d):
    g = d.groupBy("star", "sector").agg((F.avg("flux") / 100).alias("e"), (F.min("flux") / 50).alias("n"), F.count("*").alias("_n"))
    return px.combined_offsets(g.select("star", "sector", "e", "n", (1.0 + F.col("_n") % 3).alias("ee"), F.lit(0.2).alias("en"), (2.0 + F.col("_n") % 2).alias("nn")))


@query(OFFSETS + " SELECT star, sectors, " + ", ".join(f"{sql_r(k)} AS {k}" for k in ("e", "n", "ee", "en", "nn", "chi2")) + " FROM r")
def combined_offsets(d):
    return offsets(d).withColumns({k: rounded(F.col(k)) for k in ("e", "n", "ee", "en", "nn", "chi2")})


LIKE = "exp(-((nn + 0.04) * ({e}) * ({e}) - 2 * en * ({e}) * ({n}) + (ee + 0.04) * ({n}) * ({n})) / ((ee + 0.04) * (nn + 0.04) - en * en) / 2)"
NEIGHBOURS = ", b AS (SELECT star, flux / 100 AS at_e, (event_id % 7) / 2.0 AS at_n, (event_id % 9) / 6.0 AS needed FROM c WHERE event_id % 10 = 0)"


@query(OFFSETS + NEIGHBOURS + f", u AS (SELECT star, sum(CASE WHEN needed <= 0.5 THEN 0.25 ELSE 0.05 END * {LIKE.format(e='e - at_e', n='n - at_n')}) AS others FROM b JOIN r USING (star) WHERE needed <= 1 GROUP BY star), g AS (SELECT star, {LIKE.format(e='e', n='n')} AS own, others FROM r LEFT JOIN u USING (star)) SELECT star, {sql_r('own / (own + exp(-4.5) + coalesce(others, 0))')} AS p FROM g")
def on_target_probability(d):
    b = d.where("event_id % 10 = 0").selectExpr("star", "flux / 100 at_e", "(event_id % 7) / 2.0D at_n", "(event_id % 9) / 6.0D needed")
    return px.on_target_probability(offsets(d), b, 2.0).withColumn("p", rounded(F.col("p")))


BKG = ", d AS (SELECT *, CASE WHEN event_id % 6 = 0 THEN NULL ELSE flux / 80 END AS bkg FROM c)"
SCATTER = BKG + """, s0 AS (SELECT * FROM d WHERE bkg IS NOT NULL), s1 AS (SELECT *, min(t) OVER (PARTITION BY star, sector) AS t0 FROM s0),
 b AS (SELECT star, sector, floor((t - t0) * 24 / 48) AS bin, avg(t) AS t, avg(bkg) AS b FROM s1 GROUP BY star, sector, bin),
 l AS (SELECT *, count(*) OVER (PARTITION BY star, sector) AS n, lag(b) OVER w AS b0, lead(b) OVER w AS b1, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd FROM b WINDOW w AS (PARTITION BY star, sector ORDER BY t)),
 x AS (SELECT star, sector, t, abs(CASE WHEN hs IS NULL THEN (b1 - b) / hd WHEN hd IS NULL THEN (b - b0) / hs ELSE (hs * hs * b1 + (hd * hd - hs * hs) * b - hd * hd * b0) / (hs * hd * (hs + hd)) END) / 24 AS value FROM l WHERE n >= 3),
 a1 AS (SELECT s0.star, s0.sector, s0.event_id, s0.t, x.t AS ta, x.value AS av FROM s0 ASOF LEFT JOIN x ON s0.star = x.star AND s0.sector = x.sector AND s0.t >= x.t),
 a2 AS (SELECT a1.*, x.t AS tb, x.value AS bv FROM a1 ASOF LEFT JOIN x ON a1.star = x.star AND a1.sector = x.sector AND a1.t <= x.t),
 r AS (SELECT event_id, coalesce(av + (bv - av) * (t - ta) / nullif(tb - ta, 0), av, bv) AS rate FROM a2),
 k AS (SELECT d.*, coalesce(bkg > 3, false) OR coalesce(rate > 0.02, false) AS core FROM d LEFT JOIN r USING (event_id)),
 m AS (SELECT *, bool_or(core) OVER (PARTITION BY star ORDER BY t RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) AS near FROM k),
 g AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER w > 2, true) THEN 1 ELSE 0 END AS fresh FROM m WINDOW w AS (PARTITION BY star ORDER BY t, event_id)),
 h AS (SELECT *, sum(fresh) OVER (PARTITION BY star ORDER BY t, event_id) AS run FROM g)
 SELECT event_id, core, near OR t < min(t) OVER (PARTITION BY star, run) + 0.25 OR t > max(t) OVER (PARTITION BY star, run) - 0.25 AS masked FROM h"""


@query(SCATTER)
def scattered_light_mask(d):
    d = d.withColumn("bkg", F.when(F.col("event_id") % 6 != 0, F.col("flux") / 80))
    return sc.scattered_light(d, 3.0, 0.02, 0.5, 48.0, 0.25, 2.0).select("event_id", "core", "masked")


BOXES = f""", q AS (SELECT *, {PHASE} AS away, (((t - {T0}) / {PERIOD}) % 1.0 + 1) % 1.0 AS ph FROM c), o AS (SELECT *, median(flux) OVER (PARTITION BY star) AS level FROM q WHERE abs(away) >= 0.75 * {DURATION}),
 b AS (SELECT star, CAST(floor((ph - 0.1) / {DURATION / PERIOD / 2}) AS BIGINT) + j AS box, level, flux FROM o, (VALUES (0), (1)) v(j)),
 g AS (SELECT star, box, 0.1 + box * {DURATION / PERIOD / 2} AS phase, count(*) AS n, any_value(level) - avg(flux) AS depth FROM b WHERE box >= 0 AND 0.1 + box * {DURATION / PERIOD / 2} <= 0.9 + 1e-9 GROUP BY star, box HAVING count(*) >= 5)"""


@query(BOXES + f", s AS (SELECT star, count(*) AS boxes, 1.4826 * mad(depth) AS err, max(depth) FILTER (phase BETWEEN 0.4 - 1e-9 AND 0.6 + 1e-9) AS depth FROM g GROUP BY star) SELECT star, {sql_r('depth')} AS depth, {sql_r('err')} AS err, {sql_r('depth / err', 3)} AS raw FROM s WHERE boxes >= 5 AND err > 0 AND depth IS NOT NULL")
def secondary_eclipse(d):
    s = sc.secondary_eclipse(sc.phase_boxes(d, PERIOD, T0, DURATION), 5)
    return s.select("star", rounded(F.col("depth")).alias("depth"), rounded(F.col("err")).alias("err"), rounded(F.col("raw"), 3).alias("raw"))


def secondary_verdicts(spark, sf_dir):
    """The same boxes judged for all the places that they could have been, against a transit as deep as a tenth of the star's mean."""
    d = curve(table(spark, sf_dir, "events"))
    s = sc.secondary_eclipse(sc.phase_boxes(d, PERIOD, T0, DURATION), 5).join(d.groupBy("star").agg((F.avg("flux") / 10).alias("transit")), "star")
    return sc.secondary_verdict(s, F.lit(DURATION / PERIOD), F.col("transit")).drop("transit")


QUERIES["secondary_verdicts"] = secondary_verdicts


def quadratic_sql(rounds: int = 5) -> str:
    det = "(s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2))"
    sql = "WITH d0 AS (SELECT substring(p_brand, 1, 7) AS k, CAST(p_size AS DOUBLE) / 10 - 2 AS x, CAST(p_retailprice AS DOUBLE) / 100 AS y, true AS u FROM part)"
    for i in range(rounds):
        sums = ", ".join([f"sum(x ** {j}) FILTER (u) AS s{j}" for j in range(5)] + [f"sum(x ** {j} * y) FILTER (u) AS q{j}" for j in range(3)])
        sql += f", t{i} AS (SELECT k, {sums} FROM d{i} GROUP BY k), f{i} AS (SELECT k, (q0*(s2*s4-s3*s3) - s1*(q1*s4-q2*s3) + s2*(q1*s3-q2*s2)) / {det} AS a, (s0*(q1*s4-q2*s3) - q0*(s1*s4-s2*s3) + s2*(s1*q2-s2*q1)) / {det} AS b, (s0*(s2*q2-s3*q1) - s1*(s1*q2-s2*q1) + q0*(s1*s3-s2*s2)) / {det} AS c FROM t{i} WHERE abs({det}) > 1e-9)"
        sql += f", r{i} AS (SELECT k, x, y, u, f.a, f.b, f.c, y - (f.a + f.b * x + f.c * x * x) AS r FROM d{i} JOIN f{i} f USING (k)), m{i} AS (SELECT k, 1.4826 * median(abs(r)) FILTER (u) AS s FROM r{i} GROUP BY k), d{i + 1} AS (SELECT k, x, y, a, b, c, r, abs(r) < 1.5 * s AS u FROM r{i} JOIN m{i} USING (k))"
    show = ", ".join(f"{sql_r(v)} AS {v}" for v in "abc")
    return f"{sql}, z AS (SELECT k, a, b, c, stddev_pop(r) FILTER (u) AS rms, count(*) FILTER (NOT u) AS clipped FROM d{rounds} GROUP BY ALL) SELECT k AS brand, {show}, {sql_r('rms')} AS rms, clipped FROM z"


@query(quadratic_sql(), "part")
def quadratic_clip_fit(d):
    fit = sc.clipped_quadratic(d.withColumn("brand", F.substring("p_brand", 1, 7)), "brand", F.col("p_size").cast("double") / 10 - 2, F.col("p_retailprice").cast("double") / 100, limit=1.5)
    return fit.withColumns({k: rounded(F.col(k)) for k in ("a", "b", "c", "rms")})


NOW = "TIMESTAMP '2024-01-20 00:00:00'"


@query(f", u AS (SELECT user_id AS run_id, max(ts) AS seen, count(*) AS stars, max_by(event_id, (ts, event_id)) AS last FROM events GROUP BY user_id) SELECT run_id, CASE WHEN last % 2 = 0 AND epoch({NOW}) - floor(epoch(seen)) <= 864000 THEN 'live' ELSE 'replay' END AS mode, CASE WHEN last % 2 = 0 AND epoch({NOW}) - floor(epoch(seen)) <= 864000 THEN NULL ELSE CAST(floor(epoch({NOW}) / 20) AS BIGINT) % stars END AS place FROM u")
def live_or_replay(d):
    runs = d.groupBy(F.col("star").alias("run_id")).agg(F.max("t").alias("t"), F.count("*").alias("stars"), F.max_by("event_id", F.struct("t", "event_id")).alias("last"))
    runs = runs.selectExpr("run_id", "timestamp_micros(cast(round(t * 86400e6) as bigint)) updated_at", "stars", "if(last % 2 = 0, 'running', 'done') state")
    return sc.service_mode(runs, F.expr(NOW), timeout=864000)


@query(f", u AS (SELECT user_id AS runner, max(ts) AS seen, max(event_id) AS last FROM events GROUP BY user_id) SELECT runner, epoch({NOW}) - floor(epoch(CASE WHEN last % 2 = 0 THEN seen + INTERVAL 9 DAY ELSE seen END)) <= 86400 AS responding FROM u")
def heartbeat_responding(d):
    b = d.groupBy(F.col("star").alias("runner")).agg(F.max("t").alias("t"), F.max("event_id").alias("last"))
    b = b.selectExpr("runner", "timestamp_micros(cast(round(t * 86400e6) as bigint)) seen_at", "last").withColumns({"next_run_at": F.expr("seen_at + INTERVAL 9 DAY"), "state": F.when(F.col("last") % 2 == 0, "idle").otherwise("busy")})
    return sc.responding(b, F.expr(NOW), 86400).select("runner", "responding")


@query("WITH s AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0), i AS (SELECT * FROM customer WHERE c_custkey % 4 <> 0) SELECT coalesce(s.c_custkey, i.c_custkey) AS stem, CASE WHEN s.c_custkey IS NULL OR i.c_custkey % 5 = 0 THEN 2 ELSE 1 END AS run_id, CASE WHEN s.c_custkey IS NULL OR i.c_custkey % 5 = 0 THEN 'pending' ELSE 'done' END AS status, CASE WHEN s.c_custkey IS NULL OR i.c_custkey % 5 = 0 THEN 0 ELSE 1 END AS attempts FROM s FULL JOIN i ON s.c_custkey = i.c_custkey", "customer")
def superseded_vets(d):
    stored = d.where("c_custkey % 3 <> 0").selectExpr("c_custkey stem", "1 run_id", "c_name source", "'done' status", "1L attempts")
    items = d.where("c_custkey % 4 <> 0").selectExpr("c_custkey stem", "2 run_id", "if(c_custkey % 5 = 0, concat(c_name, '+'), c_name) source")
    return sc.superseded(stored, items).select("stem", "run_id", "status", "attempts")
