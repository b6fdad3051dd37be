"""Queries on stars, signals, records and the work ledger, over the relational tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from starloom.functions import astro, signals, sky, stars
from starloom.functions.astro import rounded
from starloom.operators import signals as ops
from starloom.plans.curves import sql_r
from starloom.sources.tables import number, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Stars made of customers, for both engines.
STAR = "c_custkey AS tic, (c_custkey * 7.31) % 360 AS ra, (c_custkey * 3.7) % 179 - 89.5 AS dec, 6 + c_custkey % 110 / 10.0 AS tmag, CASE WHEN c_custkey % 11 > 0 THEN 3000 + c_custkey % 70 * 100.0 END AS teff, CASE WHEN c_custkey % 13 > 0 THEN 0.3 + c_custkey % 37 / 10.0 END AS rad, CASE WHEN c_custkey % 17 > 0 THEN 3.5 + c_custkey % 15 / 10.0 END AS logg, CASE c_custkey % 3 WHEN 0 THEN 'DWARF' WHEN 1 THEN 'GIANT' END AS lumclass, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 10 / 20.0 END AS contratio, CASE WHEN c_custkey % 4 > 0 THEN 0.5 + c_custkey % 9 / 5.0 END AS mass, CASE WHEN c_custkey % 5 = 0 THEN 0.1 + c_custkey % 7 / 7.0 END AS rho, c_custkey % 8 AS n_sectors"
S = f"WITH s AS (SELECT {STAR} FROM customer) "


def query(sql: str, *tables: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in tables])
        ORACLES[f.__name__] = sql
        return f

    return add


def on_stars(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(table(spark, sf_dir, "customer").selectExpr(*[x.strip() for x in split_top(STAR)]).select("tic", *[F.col(c).cast("double").alias(c) for c in ("ra", "dec", "tmag", "teff", "rad", "logg")], "lumclass", *[F.col(c).cast("double").alias(c) for c in ("contratio", "mass", "rho")], "n_sectors"))
        ORACLES[f.__name__] = S + sql
        return f

    return add


def split_top(text: str) -> list[str]:
    """Parts between commas outside brackets."""
    parts, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(text[begin:i])
            begin = i + 1
    return [*parts, text[begin:]]


col = F.col
DWARF = "coalesce(lumclass, 'DWARF') = 'DWARF' AND (logg IS NULL OR logg >= {})"
TIER = f"CASE WHEN lumclass = 'DWARF' AND {DWARF.format(3.8)} AND teff < 4000 THEN 0 WHEN {DWARF.format(3.8)} AND rad < 0.8 THEN 1 WHEN lumclass = 'DWARF' AND rad IS NOT NULL THEN 2 ELSE 3 END"
QUIET = f"({DWARF.format(4.0)} AND (teff IS NULL OR teff <= 6500) AND (contratio IS NULL OR contratio < 0.1))"
GROUP = f"CASE WHEN n_sectors < 5 THEN 2 WHEN tmag <= 11 AND {QUIET} THEN 0 ELSE 1 END"


@on_stars(f"SELECT tic, {TIER} AS tier, {GROUP} AS grp, {QUIET} AS quiet, CASE WHEN tmag > 15.7 THEN 3 WHEN rad <= 0.4 AND n_sectors >= 3 AND coalesce(contratio, 0) <= 0.1 THEN 1 WHEN rad <= 0.6 AND n_sectors >= 2 AND coalesce(contratio, 0) <= 0.3 THEN 2 ELSE 3 END AS faint FROM s")
def star_tiers(s):
    quiet = stars.is_quiet(col("lumclass"), col("logg"), col("teff"), col("contratio"))
    return s.select("tic", stars.bright_tier(col("lumclass"), col("logg"), col("teff"), col("rad")).alias("tier"), stars.search_group(col("n_sectors"), col("tmag"), quiet).alias("grp"), quiet.alias("quiet"), stars.faint_tier(col("rad"), col("n_sectors"), col("contratio"), col("tmag")).alias("faint"))


@on_stars(f", t AS (SELECT *, {TIER} AS tier, {GROUP} AS grp FROM s) SELECT tic, row_number() OVER (PARTITION BY grp, tier ORDER BY coalesce(rad, 99.0), coalesce(tmag, 99.0), tic) AS rank, grp, tier FROM t")
def target_ranks(s):
    """Rank within a group and tier, which come first in the order: a star's place follows from the sizes of those before its own."""
    from starloom.operators.lists import placed

    return placed(grouped(s), ["grp", "tier"], [*stars.rank_order("grp", "tier", "rad", "tmag"), col("tic")]).select("tic", "rank", "grp", "tier")


def grouped(s):
    """Stars with their group and tier."""
    quiet = stars.is_quiet(col("lumclass"), col("logg"), col("teff"), col("contratio"))
    return s.withColumns({"tier": stars.bright_tier(col("lumclass"), col("logg"), col("teff"), col("rad")), "grp": stars.search_group(col("n_sectors"), col("tmag"), quiet)})


@on_stars(f", t AS (SELECT *, {TIER} AS tier, {GROUP} AS grp FROM s) SELECT tic, row_number() OVER (ORDER BY grp, tier, coalesce(rad, 99.0), coalesce(tmag, 99.0), tic) AS rank FROM t")
def overall_ranks(s):
    """One rank over all stars: group, tier, size, brightness."""
    from starloom.operators.lists import placed

    return placed(grouped(s), [], [*stars.rank_order("grp", "tier", "rad", "tmag"), col("tic")]).select("tic", "rank")


for _name in ("target_ranks", "overall_ranks"):
    ORACLES[_name] = ORACLES[_name].replace("FROM customer) , t AS", "FROM customer), t AS")


@on_stars("SELECT tic, " + sql_r("CASE WHEN rho > 0 THEN rho WHEN rad > 0 AND mass > 0 THEN mass / (rad * rad * rad) WHEN rad > 0 AND coalesce(lumclass, 'DWARF') = 'DWARF' AND rad < 1.5 THEN 1 / (rad * rad) END") + " AS density, CASE WHEN rho > 0 THEN 'density' WHEN rad > 0 AND mass > 0 THEN 'mass and radius' WHEN rad > 0 AND coalesce(lumclass, 'DWARF') = 'DWARF' AND rad < 1.5 THEN 'radius with M = R assumed' ELSE 'no radius' END AS source FROM s")
def density_fallbacks(s):
    value, source = stars.density(col("rho"), col("rad"), col("mass"), col("lumclass"))
    return s.select("tic", rounded(value).alias("density"), source.alias("source"))


TYPE = "CASE WHEN teff < 3900 THEN 'M' WHEN teff < 5300 THEN 'K' WHEN teff < 6000 THEN 'G' WHEN teff < 7500 THEN 'F' WHEN teff < 10000 THEN 'A' ELSE 'B' END"


@on_stars(f", k AS (SELECT *, {TYPE} AS k FROM s) SELECT tic, CASE WHEN teff IS NULL THEN 'a star' WHEN rad > 3 THEN CASE WHEN k IN ('M', 'K') THEN 'a red giant' ELSE 'an evolved giant' END WHEN rad > 1.6 THEN CASE WHEN k IN ('A', 'F', 'M') THEN 'an ' ELSE 'a ' END || k || ' subgiant' ELSE CASE WHEN k IN ('A', 'F', 'M') THEN 'an ' ELSE 'a ' END || k || CASE WHEN k IN ('A', 'B') THEN ' star' ELSE ' dwarf' END END AS kind, CASE WHEN rad IS NULL THEN NULL WHEN rad * 11.209 < 6 THEN 'Neptune-sized' WHEN rad * 11.209 < 10 THEN 'Saturn-sized' WHEN rad * 11.209 < 16 THEN 'Jupiter-sized' ELSE 'bigger than Jupiter' END AS size FROM k")
def star_kinds(s):
    return s.select("tic", stars.star_kind(col("teff"), col("rad")).alias("kind"), stars.size_class(col("rad")).alias("size"))


ORACLES["star_kinds"] = ORACLES["star_kinds"].replace("FROM customer) , k AS", "FROM customer), k AS").replace("WHEN rad * 11.209 < 6 THEN", "WHEN rad * 11.209 < 3.5 THEN 'sub-Neptune' WHEN rad * 11.209 < 6 THEN")


@on_stars("SELECT tic, " + sql_r("CASE WHEN teff IS NULL THEN tmag - 0.43 ELSE tmag + ((-0.00522555 * c + 0.0891337) * c - 0.633923) * c + 0.0324473 END") + " AS tmag FROM (SELECT *, least(greatest(teff / 1000 - 4, -0.2), 3.5) AS c FROM s)")
def tmag_from_colour(s):
    return s.select("tic", rounded(stars.tmag_of_gaia(col("tmag"), col("teff") / 1000 - 4)).alias("tmag"))


@on_stars("SELECT tic, " + sql_r("degrees(acos(greatest(-1, least(1, sin(radians(dec)) * sin(radians(20.0)) + cos(radians(dec)) * cos(radians(20.0)) * cos(radians(ra - 100.0))))))", 3) + " AS separation, " + sql_r("((ra - 359.0 + 540) % 360 - 180) * cos(radians(10.0)) * 3600", 2) + " AS east, " + sql_r("(dec - 10.0) * 3600", 2) + " AS north, " + sql_r("ra + tmag * 16 / 3.6e6 / greatest(cos(radians(dec)), 1e-6)", 5) + " AS ra_now, " + sql_r("dec + coalesce(teff, 0) * 16 / 3.6e6", 5) + " AS dec_now FROM s")
def sky_motions(s):
    lit = F.lit
    east, north = sky.offset_arcsec(lit(359.0), lit(10.0), col("ra"), col("dec"))
    ra, dec = sky.moved(col("ra"), col("dec"), col("tmag"), col("teff"), lit(16.0))
    return s.select("tic", rounded(sky.cosine_separation(col("ra"), col("dec"), lit(100.0), lit(20.0)), 3).alias("separation"), rounded(east, 2).alias("east"), rounded(north, 2).alias("north"), rounded(ra, 5).alias("ra_now"), rounded(dec, 5).alias("dec_now"))


V = "cos(radians(dec)) * cos(radians(ra)) AS x, cos(radians(dec)) * sin(radians(ra)) AS y, sin(radians(dec)) AS z"


@on_stars(f"SELECT tic, " + sql_r("(degrees(atan2(-0.8734370902 * x - 0.44482963 * y - 0.1980763734 * z, -0.0548755604 * x + 0.4941094279 * y - 0.867666149 * z)) + 360) % 360", 3) + " AS ra_of_galactic, " + sql_r("degrees(asin(greatest(-1, least(1, -0.4838350155 * x + 0.7469822445 * y + 0.4559837762 * z))))", 3) + " AS dec_of_galactic, " + sql_r("(degrees(atan2(sin(radians(ra)) * cos(radians(23.4393)) - tan(radians(dec)) * sin(radians(23.4393)), cos(radians(ra)))) + 360) % 360", 3) + f" AS ra_of_ecliptic FROM (SELECT *, {V} FROM s)")
def sky_rotations(s):
    ra, dec = sky.galactic_to_equatorial(col("ra"), col("dec"))
    return s.select("tic", rounded(ra, 3).alias("ra_of_galactic"), rounded(dec, 3).alias("dec_of_galactic"), rounded(sky.ecliptic_to_equatorial(col("ra"), col("dec"))[0], 3).alias("ra_of_ecliptic"))


@on_stars(f"SELECT tic, " + sql_r(f"2 / pi() * radians(-((ra + 180) % 360 - 180)) * cos(t)", 3) + " AS x, " + sql_r("sin(t)", 3) + f" AS y FROM (SELECT *, list_reduce(list_prepend(radians(dec), list_transform(range(60), lambda i: pi() * sin(radians(dec)))), lambda a, q: a - (2 * a + sin(2 * a) - q) / (2 + 2 * cos(2 * a))) AS t FROM s)")
def sky_map(s):
    x, y = sky.mollweide(col("ra"), col("dec"), 60)
    return s.select("tic", rounded(x, 3).alias("x"), rounded(y, 3).alias("y"))


@on_stars("SELECT tic, " + sql_r(f"p / pi() * asin(least(greatest(chord / (a * sqrt(greatest(1 - (0.3 / a) * (0.3 / a), 1e-9))), 0), 1)) * sqrt(1 - 0.04) / (1 + 0.2 * sin(0.7))", 5) + f" AS duration FROM (SELECT *, sqrt(greatest(1.1 * 1.1 - 0.09, 0)) AS chord, pow(6.6743e-11 * mass * 1410.0 * (p * 86400) * (p * 86400) / {3 * math.pi!r}, {1 / 3!r}) AS a FROM (SELECT *, 1.0 + tic % 50 AS p FROM s WHERE mass IS NOT NULL))")
def eccentric_durations(s):
    lit = F.lit
    d = stars.eccentric_duration(1.0 + col("tic") % 50, col("mass"), lit(0.3), lit(0.1), lit(0.2), lit(0.7))
    return s.where("mass is not null").select("tic", rounded(d, 5).alias("duration"))


@on_stars("SELECT tic, CASE WHEN abs(m * m * m / ((mass + m) * (mass + m)) - f) < 1e-6 * (f + 1e-9) THEN 'solved' END AS state FROM (SELECT *, 1.0 AS m, 1.0 / ((mass + 1) * (mass + 1)) AS f FROM s WHERE mass IS NOT NULL)")
def companion_masses(s):
    """The least companion of mass 1 whose amplitude is worked out from it is found again."""
    p = 10.0
    f = 1 / ((col("mass") + 1) * (col("mass") + 1))
    k = F.pow(f * F.lit(2 * math.pi * 6.674e-11 * 1.98892e30 / (p * 86400)), F.lit(1 / 3)) / 1e3
    found = stars.least_companion_mass(F.lit(p), k, F.lit(0.0), col("mass"))
    return s.where("mass is not null").select("tic", F.when(F.abs(found - 1) < 1e-6, "solved").alias("state"))


@on_stars("SELECT tic, " + sql_r("2000.0 + (tmag * 1000 + 2457000.0 - 2451545.0) / 365.25") + " AS year, " + sql_r("3 * sqrt(0.01 * 0.01 + tic * coalesce(rho, 0) / 1000 * (tic * coalesce(rho, 0) / 1000))", 3) + " AS timing, " + sql_r("1 - CASE WHEN abs(tmag - 10) <= 1 THEN 0.3 WHEN abs(tmag - 10) < 2 THEN 0.3 * (2 - abs(tmag - 10)) / 1.0 ELSE 0 END") + " AS flux FROM s")
def formulas(s):
    lit = F.lit
    return s.select("tic", rounded(sky.julian_year(col("tmag") * 1000)).alias("year"), rounded(signals.timing_error(lit(0.01), col("rho") / 1000, col("tic").cast("double")), 3).alias("timing"), rounded(signals.trapezoid(col("tmag"), lit(10.0), lit(0.3), lit(4.0), lit(1.0))).alias("flux"))


SIGNAL = "l_orderkey AS id, l_linenumber AS n, 1 + l_quantity AS snr, l_extendedprice / 1000 AS period, l_discount AS margin, CASE l_suppkey % 6 WHEN 0 THEN 'snr' WHEN 1 THEN 'sde' WHEN 2 THEN 'checks' WHEN 3 THEN 'known' END AS stage, CASE l_partkey % 5 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS passed, CASE l_partkey % 4 WHEN 0 THEN 'size' WHEN 1 THEN 'edge' WHEN 2 THEN 'snr' ELSE 'shape' END AS name"
L = f"WITH s AS (SELECT {SIGNAL} FROM lineitem) "


def signal_rows(lineitem):
    return lineitem.selectExpr(*[x.strip() for x in split_top(SIGNAL)])


@query(L + "SELECT id, string_agg(name, ',' ORDER BY n, name) FILTER (coalesce(passed = false, name IN ('size', 'snr'))) AS failed, CAST(count(*) FILTER (passed) AS INT) AS n_passed, CAST(count(passed) AS INT) AS n_run FROM s GROUP BY id", "lineitem")
def must_run_failures(lineitem):
    d = signal_rows(lineitem).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "name", "passed"))).alias("checks"))
    passed, run = signals.check_counts(col("checks"))
    failed = F.array_join(signals.failures(col("checks")), ",")
    return d.select("id", F.nullif(failed, F.lit("")).alias("failed"), passed.alias("n_passed"), run.alias("n_run"))


@query(L + "SELECT id, bool_or(stage IS NULL OR (snr >= 7 AND stage IN ('sde', 'transits', 'checks'))) AS promising, max(CASE WHEN stage IS NULL THEN 1 ELSE 0 END) = 0 AS quiet FROM s GROUP BY id", "lineitem")
def promising_stars(lineitem):
    d = signal_rows(lineitem).groupBy("id")
    return d.agg(F.bool_or(signals.is_promising(col("stage"), col("snr"))).alias("promising"), F.bool_and(col("stage").isNotNull()).alias("quiet"))


@query(L + "SELECT id, n, CASE WHEN NOT passed THEN 'snr' WHEN margin > 0.08 THEN 'checks' WHEN stage = 'known' THEN 'known' WHEN stage = 'sde' THEN 'neighbour' END AS failed FROM s", "lineitem")
def dip_stages(lineitem):
    stage = signals.dip_stage(col("passed"), (col("margin") > 0.08).cast("int"), col("stage") == "known", col("stage") == "sde")
    return signal_rows(lineitem).select("id", "n", stage.alias("failed"))


@query(L + "SELECT a.id, a.n AS n1, b.n AS n2 FROM s a JOIN s b ON a.id = b.id AND a.n < b.n WHERE abs(a.period / b.period - 1) < 0.01 OR abs(a.period / b.period - 2) / 2 < 0.01 OR abs(a.period / b.period - 3) / 3 < 0.01 OR abs(a.period / b.period - 0.5) / 0.5 < 0.01 OR abs(a.period / b.period - 1 / 3.0) * 3 < 0.01", "lineitem")
def harmonic_pairs(lineitem):
    d = signal_rows(lineitem)
    a, b = (d.select("id", col("n").alias(f"n{k}"), col("period").alias(f"p{k}")) for k in (1, 2))
    return a.join(b, "id").where((col("n1") < col("n2")) & signals.harmonic(col("p1"), col("p2"))).select("id", "n1", "n2")


@query(L + ", i AS (SELECT o_orderkey AS id, o_totalprice / 5000 AS period, 1.5 AS t0 FROM orders) SELECT i.id, count(*) FILTER (abs(s.period - i.period) / i.period <= 0.01 AND abs((((n - t0) / i.period + 0.5) % 1 + 1) % 1 - 0.5) * i.period < 0.8) AS hits FROM i JOIN s USING (id) GROUP BY i.id".replace(") , i", "), i"), "lineitem", "orders")
def injected_and_found(lineitem, orders):
    i = orders.select(col("o_orderkey").alias("i_id"), (col("o_totalprice") / 5000).alias("truth"))
    d = signal_rows(lineitem).join(i, col("id") == col("i_id"))
    same = signals.same_signal(col("period"), col("n").cast("double"), col("truth"), F.lit(1.5), F.lit(0.8))
    return d.groupBy("id").agg(F.count_if(same).alias("hits"))


ORACLES["injected_and_found"] = ORACLES["injected_and_found"].replace("FROM lineitem) , i", "FROM lineitem), i")


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END, CASE WHEN p_partkey % 5 = 0 THEN 7.0 END, (low + high) / 2, low, high) AS radius FROM (SELECT *, CASE WHEN p_partkey % 7 > 0 THEN p_size * 1.0 END AS low, CASE WHEN p_partkey % 11 > 0 THEN p_size * 3.0 END AS high FROM part)", "part")
def best_radii(part):
    k = col("p_partkey")
    size = col("p_size").cast("double")
    pick = signals.best_radius(F.when(k % 3 == 0, col("p_retailprice")), F.when(k % 5 == 0, 7.0), F.when(k % 7 > 0, size), F.when(k % 11 > 0, size * 3))
    return part.select("p_partkey", pick.alias("radius"))


@query("SELECT p_partkey, substring(sha256(printf('%.6f', p_size / 8.0) || ';' || printf('%.4f', p_size * 1.5) || ';' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE printf('%.3f', p_size / 4.0) END || ';' || '3,5'), 1, 32) AS key FROM part", "part")
def ephemeris_keys(part):
    s = col("p_size")
    key = signals.ephemeris_key(s / 8.0, s * 1.5, F.when(col("p_partkey") % 3 > 0, s / 4.0), F.array(F.lit(5), F.lit(3)))
    return part.select("p_partkey", key.alias("key"))


@query("SELECT o_custkey, coalesce(first(o_orderkey ORDER BY o_orderkey) FILTER (o_orderstatus = 'F'), min(o_orderkey)) AS lead FROM orders GROUP BY o_custkey", "orders")
def lead_detections(orders):
    d = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", col("o_orderstatus").alias("outcome")))).alias("dets"))
    return d.select("o_custkey", signals.lead(col("dets"), F.lit("F"))["o_orderkey"].alias("lead"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_retailprice END AS value FROM part", "part")
def lenient_numbers(part):
    """Numbers out of text; what is no finite number is null."""
    raw = F.when(col("p_partkey") % 6 == 0, F.element_at(F.array(F.lit("n/a"), F.lit("NaN"), F.lit("inf"), F.lit("")), (1 + col("p_partkey") % 4).cast("int"))).otherwise(F.concat(F.lit(" "), col("p_retailprice").cast("string")))
    return part.withColumn("raw", raw).select("p_partkey", number("raw").alias("value"))


LEDGER = "o_custkey AS tic, CAST(o_orderkey % 3 AS VARCHAR) AS sectors_key, CASE o_orderkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'done' WHEN 2 THEN 'running' ELSE 'failed' END AS status, CAST(o_orderkey % 5 AS INT) AS attempts"
FIRST = f"WITH l AS (SELECT {LEDGER} FROM orders WHERE o_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_custkey)), w AS (SELECT c_custkey AS tic, '1' AS sectors_key FROM customer) "


def ledger_rows(orders):
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    k = col("o_orderkey")
    return first.select(col("o_custkey").alias("tic"), (k % 3).cast("string").alias("sectors_key"), F.when(k % 4 == 1, "done").when(k % 4 == 2, "running").otherwise("failed").alias("status"), (k % 5).cast("int").alias("attempts"))


@query(FIRST + "SELECT tic, w.sectors_key, CASE WHEN status = 'failed' THEN attempts + 1 ELSE 1 END AS attempt FROM w LEFT JOIN l USING (tic) WHERE status IS NULL OR (status = 'failed' AND attempts < 3) OR (status = 'done' AND l.sectors_key <> w.sectors_key)", "orders", "customer")
def claims(orders, customer):
    return ops.claimable(customer.select(col("c_custkey").alias("tic"), F.lit("1").alias("sectors_key")), ledger_rows(orders), ["tic"])


@query(FIRST + "SELECT tic, CASE status WHEN 'running' THEN 'failed' ELSE status END AS status, CASE status WHEN 'running' THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts FROM l", "orders")
def crash_recovery(orders):
    return ops.recovered(ledger_rows(orders)).select("tic", "status", "attempts")


@query("WITH g AS (SELECT *, coalesce(o_orderpriority <> lag(o_orderpriority) OVER w, true)::INT AS fresh FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS run FROM g), m AS (SELECT *, max(run) OVER (PARTITION BY o_custkey) AS last FROM r) SELECT o_custkey, any_value(o_orderpriority) AS o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS failures FROM m WHERE run = last GROUP BY o_custkey", "orders")
def failures_since_change(orders):
    return ops.failures_since_change(orders.withColumn("failed", col("o_orderstatus") == "F"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority", "failed")


@query("SELECT o_orderpriority AS queue, avg(o_totalprice) AS mean, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS middle, count(*) FILTER (o_orderstatus = 'F') AS n_failed FROM orders GROUP BY 1", "orders")
def throughput_rates(orders):
    from starloom.operators.quantiles import quantiles, upper_middle

    queues = orders.select(col("o_orderpriority").alias("queue"), "o_totalprice", "o_orderstatus")
    middles = quantiles(queues, ("queue",), col("o_totalprice"), {"middle": upper_middle()}).drop("n")
    sums = queues.groupBy("queue").agg(rounded(F.avg("o_totalprice"), 2).alias("mean"), F.count_if(col("o_orderstatus") == "F").alias("n_failed"))
    return sums.join(middles, "queue").select("queue", "mean", "middle", "n_failed")


ORACLES["throughput_rates"] = ORACLES["throughput_rates"].replace("avg(o_totalprice) AS mean", sql_r("avg(o_totalprice)", 2) + " AS mean")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_orderpriority AS queue, " + sql_r("avg(o_totalprice)", 2) + " AS mean FROM r WHERE k <= 200 GROUP BY 1", "orders")
def mean_of_last_finished(orders):
    from starloom.operators.lists import top_per_group

    last = top_per_group(orders, ["o_orderpriority"], [col("o_orderdate").desc(), col("o_orderkey").desc()], 200)
    return last.groupBy(col("o_orderpriority").alias("queue")).agg(rounded(F.avg("o_totalprice"), 2).alias("mean"))


@query("WITH a AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_linenumber)) AS x, list_sort(list(DISTINCT CAST(l_quantity AS INT) % 7)) AS y FROM lineitem GROUP BY 1) SELECT k, CAST(len(list_filter(x, lambda e: NOT list_contains(y, e))) AS INT) AS missing, CAST(len(list_filter(y, lambda e: NOT list_contains(x, e))) AS INT) AS extra FROM a", "lineitem")
def set_differences(lineitem):
    a = lineitem.groupBy(col("l_orderkey").alias("k")).agg(F.collect_set("l_linenumber").alias("x"), F.collect_set(col("l_quantity").cast("int") % 7).alias("y"))
    return a.select("k", F.size(F.array_except("x", "y")).alias("missing"), F.size(F.array_except("y", "x")).alias("extra"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 40 = 0) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000) AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 20 = 0)", "customer", "orders", "supplier")
def anti_four_lists(customer, orders, supplier):
    """Customers on none of several lists, each list with a hit count of its own to be had from the same union."""
    lists = orders.where("o_orderkey % 40 = 0").select(col("o_custkey").alias("id")).unionByName(orders.where("o_totalprice > 480000").select(col("o_custkey").alias("id")))
    left = customer.join(lists.distinct(), col("c_custkey") == col("id"), "left_anti")
    return left.join(supplier.where("s_suppkey % 20 = 0").select("s_nationkey").distinct(), col("c_nationkey") == col("s_nationkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey, CASE WHEN d < 1 THEN printf('%.1f h', d * 24) WHEN d < 100 THEN printf('%.2f d', d) ELSE printf('%d d', CAST(floor(d + 0.5) AS BIGINT)) END AS period FROM (SELECT p_partkey, p_size * p_size / 16.0 AS d FROM part)", "part")
def human_periods(part):
    d = col("p_size") * col("p_size") / 16.0
    text = F.when(d < 1, F.format_string("%.1f h", d * 24)).when(d < 100, F.format_string("%.2f d", d)).otherwise(F.format_string("%d d", F.floor(d + 0.5)))
    return part.select("p_partkey", text.alias("period"))
