"""Queries on catalogues, results and states, over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions import astro, text
from starloom.functions.astro import rounded
from starloom.operators import lists, matching
from starloom.plans.curves import sql_r
from starloom.sources.tables import clean_cell, curve, pipe_rows, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(*tables: str, sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in tables])
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("customer", "orders", sql="SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_new_targets(customer, orders):
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("customer", "orders", sql="SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def semi_hosts(customer, orders):
    return customer.join(orders.where("o_orderstatus = 'O'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("part", sql="SELECT CASE WHEN p_partkey % 10 = 0 THEN 'known' WHEN p_size < 5 THEN 'no coverage' WHEN p_retailprice > 1500 THEN 'crowded' WHEN p_type IS NULL THEN 'no radius' ELSE 'kept' END AS reason, count(*) AS n FROM part GROUP BY 1")
def drop_reason_counts(part):
    return matching.drop_reasons(part, [("known", F.col("p_partkey") % 10 == 0), ("no coverage", F.col("p_size") < 5), ("crowded", F.col("p_retailprice") > 1500), ("no radius", F.col("p_type").isNull())])


TIER = "CASE WHEN p_retailprice > 1570 THEN 3 WHEN p_size <= 10 AND p_partkey % 10 >= 3 THEN 1 WHEN p_size <= 25 AND p_partkey % 10 >= 2 THEN 2 ELSE 3 END"


@query("part", sql=f"SELECT p_partkey, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY tier, p_size, p_retailprice, p_partkey) AS rank FROM (SELECT *, {TIER} AS tier FROM part)) WHERE rank <= 20")
def tier_rank(part):
    """Ranks inside each brand: a rank over all rows would need them in one task."""
    return lists.top_per_group(part.withColumn("tier", F.expr(TIER)), ["p_brand"], [F.col("tier"), F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey")], 20).select("p_partkey", "tier", "rank")


@query("customer", "supplier", sql="WITH a AS (SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), b AS (SELECT s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier), u AS (SELECT *, 0 AS source FROM b UNION ALL SELECT *, 1 FROM a) SELECT id, rank, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, source) AS k FROM u) WHERE k = 1")
def round_robin_interleave(customer, supplier):
    ranked = [
        lists.top_per_group(d, [n], [F.col(v).desc(), F.col(k)], 2**31 - 1).select(F.col(k).alias("id"), "rank")
        for d, k, n, v in ((supplier, "s_suppkey", "s_nationkey", "s_acctbal"), (customer, "c_custkey", "c_nationkey", "c_acctbal"))
    ]
    return lists.interleaved(ranked)


@query("lineitem", sql="SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def best_per_group_topn(lineitem):
    return lists.top_per_group(lineitem, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


ALIAS = "CASE " + " ".join(f"WHEN abs(period / listed_period - {k}) / {k} < 0.01 THEN {k}" for k in ("1.0", "2.0", "3.0", "0.5", "(1.0/3)")) + " END"


@query("orders", "customer", sql=f"WITH j AS (SELECT o_orderkey, o_totalprice / 1000 AS period, c_acctbal / 100 AS listed_period FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0), a AS (SELECT o_orderkey, {ALIAS} AS alias FROM j) SELECT o_orderkey, {sql_r('alias')} AS alias FROM a WHERE alias IS NOT NULL")
def period_alias_join(orders, customer):
    found = orders.select("o_orderkey", F.col("o_custkey").alias("star"), (F.col("o_totalprice") / 1000).alias("period"))
    listed = customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("star"), (F.col("c_acctbal") / 100).alias("listed_period"))
    return matching.period_aliases(found, listed).select("o_orderkey", rounded(F.col("alias")).alias("alias"))


@query("events", "customer", sql="WITH e AS (SELECT event_id, user_id AS star, epoch_us(ts) / 86400e6 AS t FROM events), j AS (SELECT event_id, t, 2.0 + c_custkey % 5 AS period, CAST(c_custkey % 3 AS DOUBLE) AS t0 FROM e JOIN customer ON star = c_custkey), k AS (SELECT *, CAST(round_even((t - t0) / period, 0) AS BIGINT) AS n FROM j) SELECT event_id, n FROM k WHERE abs(t - t0 - n * period) < 0.2")
def predicted_epoch_join(events, customer):
    listed = customer.select(F.col("c_custkey").alias("star"), (F.lit(2.0) + F.col("c_custkey") % 5).alias("period"), (F.col("c_custkey") % 3).cast("double").alias("t0"))
    return matching.predicted_epochs(curve(events), listed, 0.2).select("event_id", "n")


def placed(d, key):
    """Positions made from keys."""
    return d.select(F.col(key).alias("id"), (F.col(key) * 7919 % 36000 / 100).alias("ra"), (F.col(key) * 104729 % 18000 / 100 - 90).alias("dec"))


SKY = "(SELECT {k} AS id, {k} * 7919 % 36000 / 100.0::DOUBLE AS ra, {k} * 104729 % 18000 / 100.0::DOUBLE - 90 AS dec FROM {t})"
APART = "degrees(2 * asin(sqrt(least(1.0, power(sin(radians(r.dec - l.dec) / 2), 2) + cos(radians(l.dec)) * cos(radians(r.dec)) * power(sin(radians(r.ra - l.ra) / 2), 2)))))"


@query("customer", "supplier", sql=f"SELECT l.id AS l_id, r.id AS r_id FROM {SKY.format(k='c_custkey', t='customer')} l JOIN {SKY.format(k='s_suppkey', t='supplier')} r ON {APART} < 2.5")
def cone_join(customer, supplier):
    return matching.cone_join(placed(customer, "c_custkey"), placed(supplier, "s_suppkey"), 2.5).select("l_id", "r_id")


@query("customer", sql=f"SELECT CAST(floor(ra / 5) AS INT) % 72 AS cell_ra, CAST(least(floor((dec + 90) / 5), 35) AS INT) AS cell_dec, count(*) AS n FROM {SKY.format(k='c_custkey', t='customer')} GROUP BY ALL")
def sky_cells(customer):
    across, up = astro.sky_cell(F.col("ra"), F.col("dec"))
    return placed(customer, "c_custkey").groupBy(across.alias("cell_ra"), up.alias("cell_dec")).agg(F.count("*").alias("n"))


@query("events", sql="WITH e AS (SELECT event_id, user_id AS star, event_type AS sector, epoch_us(ts) / 86400e6 AS t FROM events WHERE value > 120) SELECT a.event_id, count(DISTINCT b.star) AS neighbours FROM e a JOIN e b ON a.sector = b.sector AND abs(a.t - b.t) <= 0.25 AND a.star <> b.star GROUP BY a.event_id HAVING count(DISTINCT b.star) >= 2")
def neighbour_events(events):
    e = curve(events).where("flux > 120").select("event_id", "star", "sector", "t")
    # Rows of one number count their stars together, in pairs; there are none in a sound table.
    twice = e.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("event_id").alias("id"))
    same = F.col("event_id").eqNullSafe(F.col("id"))
    once = matching.others_near(e, 0.25, "sector", "star").join(twice, same, "left_anti").select("event_id", "neighbours")
    j = matching.near_in_time(e.join(twice, same, "left_semi"), e, 0.25, "sector").where("star <> r_star")
    return once.unionByName(j.groupBy("event_id").agg(F.countDistinct("r_star").alias("neighbours"))).where("neighbours >= 2")


@query("events", sql="WITH e AS (SELECT event_id, user_id AS star, event_type, epoch_us(ts) / 86400e6 AS t, value FROM events), l AS (SELECT * FROM e WHERE event_type = 'purchase'), r AS (SELECT * FROM e WHERE event_type = 'signup') SELECT l.event_id, r.value AS r_flux FROM l ASOF LEFT JOIN r ON l.star = r.star AND l.t >= r.t")
def asof_last(events):
    c = curve(events)
    return matching.last_before(c.where("sector = 'purchase'").select("event_id", "star", "t"), c.where("sector = 'signup'").select("star", "t", "flux"), "star", "flux").select("event_id", "r_flux")


@query("orders", "lineitem", sql="SELECT o_orderkey, tries FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS tries, bool_or(l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE tries IS NULL OR (failed AND tries < 3)")
def left_join_requeue(orders, lineitem):
    done = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("tries"), F.bool_or(F.col("l_returnflag") == "R").alias("failed"))
    return matching.requeue(orders, done, "o_orderkey", F.col("failed"), 3).select("o_orderkey", "tries")


@query("orders", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_shipdate >= o_orderdate + INTERVAL 30 DAY AS fresh FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def freshness_flag(orders, lineitem):
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", (F.col("l_shipdate") >= F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("fresh"))


@query("orders", sql="SELECT o_orderkey, coalesce(lead(o_orderkey) OVER w, first_value(o_orderkey) OVER w) AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def successor_wrap(orders):
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select("o_orderkey", F.coalesce(F.lead("o_orderkey").over(w), F.first("o_orderkey").over(w)).alias("next"))


@query("conversations", sql="SELECT DISTINCT conv_id FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn >= 2)")
def exists_runs(conversations):
    return conversations.select("conv_id").distinct().join(conversations.where("turn >= 2"), "conv_id", "left_semi")


@query("orders", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey < 100) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 51")
def keyset_page(orders):
    return lists.page_after(orders, "o_totalprice", "o_orderkey", (200000, 100), 50).select("o_orderkey", "o_totalprice")


@query("customer", "orders", sql="SELECT c_custkey, last FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY last ASC NULLS FIRST, c_acctbal DESC, c_custkey LIMIT 40")
def nulls_first_work(customer, orders):
    last = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return customer.join(last, F.col("o_custkey") == F.col("c_custkey"), "left").orderBy(F.col("last").asc_nulls_first(), F.col("c_acctbal").desc(), "c_custkey").limit(40).select("c_custkey", "last")


@query("orders", sql="SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1 OFFSET 17")
def offset_nth(orders):
    return orders.orderBy("o_orderdate", "o_orderkey").offset(17).limit(1).select("o_orderkey")


@query("orders", sql="SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus = 'F') WHERE k <= 3")
def keep_newest_n(orders):
    return lists.top_per_group(orders.where("o_orderstatus = 'F'"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 3).select("o_orderkey")


@query("orders", sql="WITH u AS (SELECT o_custkey, 0 AS source, o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 2, o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey, source, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY source, o_orderkey) AS k FROM u) WHERE k = 1")
def precedence_union(orders):
    return lists.by_precedence([orders.where(F.col("o_orderstatus") == s).select("o_custkey", "o_orderkey") for s in "POF"], "o_custkey")


@query("orders", sql="SELECT o_orderkey, o_custkey % 8 AS shard FROM orders WHERE o_custkey % 8 IN (1, 5)")
def shard_stride(orders):
    """Shards by the id: a row's place in a list would need a sort of all rows."""
    return orders.select("o_orderkey", (F.col("o_custkey") % 8).alias("shard")).where("shard in (1, 5)")


@query("customer", "orders", sql="SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) AS in_both, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS without")
def list_intersections(customer, orders):
    key = lambda s: orders.where(F.col("o_orderstatus") == s).select("o_custkey")
    both = key("O").intersect(key("F")).agg(F.count("*").alias("in_both"))
    return both.crossJoin(customer.select("c_custkey").subtract(orders.select("o_custkey")).agg(F.count("*").alias("without")))  # one row each


@query("events", sql="SELECT star, sector AS state, t, flux FROM (SELECT user_id AS star, event_type AS sector, epoch_us(ts) / 86400e6 AS t, value AS flux, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_wins_late_data(events):
    return lists.latest(curve(events).withColumnRenamed("sector", "state"), ["star"], ["t", "event_id"], ["state", "t", "flux"])


@query("events", sql="WITH e AS (SELECT user_id AS run, epoch_us(ts) / 86400e6 AS t, event_type = 'purchase' AS is_done FROM events) SELECT run, min(t) AS started, bool_or(is_done) AS done, min(t) FILTER (is_done) AS finished FROM e GROUP BY run")
def run_state_machine(events):
    return lists.run_states(curve(events).select(F.col("star").alias("run"), "t", F.when(F.col("sector") == "purchase", "done").otherwise("running").alias("state")))


@query("events", sql="WITH l AS (SELECT user_id AS run, event_type AS shard, event_id % 50 AS done, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT run, CAST(sum(done) AS BIGINT) AS done, count(*) AS shards FROM l WHERE k = 1 GROUP BY run")
def shard_progress_sum(events):
    return lists.progress(curve(events).select(F.col("star").alias("run"), F.col("sector").alias("shard"), "t", F.col("event_id").alias("seq"), (F.col("event_id") % 50).alias("done")))


@query("events", sql="WITH l AS (SELECT event_id % 20 AS candidate, CASE WHEN event_type <> 'error' THEN event_type END AS vote, row_number() OVER (PARTITION BY event_id % 20, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT candidate, vote, count(*) AS n FROM l WHERE k = 1 AND vote IS NOT NULL GROUP BY candidate, vote")
def last_vote_tally(events):
    return lists.tally(curve(events).select((F.col("event_id") % 20).alias("candidate"), F.col("star").alias("voter"), "t", F.col("event_id").alias("seq"), F.when(F.col("sector") != "error", F.col("sector")).alias("vote")))


@query("customer", sql="SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'created' WHEN c_custkey % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM customer")
def upsert_hash_diff(customer):
    hashed = lambda d: d.select("c_custkey", text.content_hash("c_name", "c_mktsegment").alias("hash"))
    changed = customer.withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")))
    return lists.upsert_plan(hashed(customer.where("c_custkey % 10 <> 0")), hashed(changed), "c_custkey")


@query("events", sql=None)
def token_bucket(events):
    return lists.token_bucket(events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")), 5.0)


INJECTED = "SELECT CAST(floor(l_quantity / 10) AS INT) AS r_bin, CAST(floor(l_discount * 100 / 3) AS INT) AS p_bin, l_returnflag = 'R' AS found FROM lineitem"


def injected(lineitem):
    return lineitem.selectExpr("cast(floor(l_quantity / 10) as int) r_bin", "cast(floor(l_discount * 100 / 3) as int) p_bin", "l_returnflag = 'R' found")


@query("lineitem", sql=f"SELECT r_bin, p_bin, count(*) AS n, count(*) FILTER (found) AS recovered, {sql_r('count(*) FILTER (found) / count(*)')} AS fraction FROM ({INJECTED}) GROUP BY ALL")
def sensitivity_grid(lineitem):
    return lists.sensitivity(injected(lineitem)).withColumn("fraction", rounded(F.col("fraction")))


@query("lineitem", sql=f"SELECT r_bin, p_bin, count(*) AS n, count(*) FILTER (found) AS recovered FROM ({INJECTED}) GROUP BY GROUPING SETS ((r_bin), (p_bin), ())")
def sensitivity_marginals(lineitem):
    return lists.marginals(injected(lineitem))


@query("lineitem", sql="SELECT r_bin, " + ", ".join(f"{sql_r(f'100.0 * count(*) FILTER (found AND p_bin = {k}) / nullif(count(*) FILTER (p_bin = {k}), 0)', 2)} AS p{k}" for k in range(4)) + f" FROM ({INJECTED}) GROUP BY r_bin")
def sensitivity_pivot(lineitem):
    wide = injected(lineitem).where("p_bin < 4").groupBy("r_bin").pivot("p_bin", list(range(4))).agg(rounded(F.avg(F.col("found").cast("int")) * 100.0, 2))
    return wide.select("r_bin", *[F.col(str(k)).alias(f"p{k}") for k in range(4)])


@query("orders", sql="SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(orders):
    return orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("events", sql="SELECT event_type, CAST(props->>'k' AS INT) % 10 AS reason, count(*) AS n FROM events GROUP BY ALL")
def reason_histogram(events):
    return events.groupBy("event_type", (F.get_json_object("props", "$.k").cast("int") % 10).alias("reason")).agg(F.count("*").alias("n"))


@query("events", sql="SELECT user_id, count(*) FILTER (CAST(props->>'k' AS INT) >= 50) AS high, count(*) FILTER (CAST(props->>'k' AS INT) < 50) AS low FROM events GROUP BY user_id")
def json_conditional_counts(events):
    k = F.get_json_object("props", "$.k").cast("int")
    return events.groupBy("user_id").agg(F.count_if(k >= 50).alias("high"), F.count_if(k < 50).alias("low"))


@query("conversations", sql=r"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'new\s+planets', 'planet candidates', 'gi'), 'new\s+planet', 'planet candidate', 'gi'), 'undiscovered', 'not yet catalogued', 'gi'), 'discovered', 'detected', 'gi')) AS softened FROM conversations")
def honesty_soften(conversations):
    return conversations.select("conv_id", "turn", F.md5(text.soften(F.col("text"))).alias("softened"))


@query("conversations", sql=r"SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(?i)new\s+planets?|discovered')")
def honesty_scan(conversations):
    return conversations.where(text.is_banned(F.col("text"))).select("conv_id", "turn")


@query("part", sql="SELECT p_partkey, substr(trim(regexp_replace(replace(p_name, '|', '/'), '\\s+', ' ', 'g')), 1, 120) AS cell FROM part")
def text_clean_truncate(part):
    return part.select("p_partkey", F.substring(clean_cell(F.col("p_name")), 1, 120).alias("cell"))


@query("orders", sql="SELECT o_orderkey, strftime(to_timestamp(CAST(floor((o_orderkey % 3000 + 2457000.0 - 2440587.5) * 86400.0 + 0.5) AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def btjd_iso(orders):
    return orders.select("o_orderkey", astro.iso_of_btjd((F.col("o_orderkey") % 3000).cast("double")).alias("iso"))


@query("events", sql="SELECT event_id, CAST(ts - INTERVAL 6 HOUR AS DATE) AS day FROM events")
def run_day(events):
    return events.select("event_id", astro.run_day(F.col("ts"), 6).alias("day"))


A_OVER_R = "power(6.6743e-11 * (0.5 + p_partkey % 10) * 1410.0 * p_size * 86400.0 * p_size * 86400.0 / (3 * pi()), 1.0/3)"


@query("part", sql=f"SELECT p_partkey, {sql_r(f'p_size / pi() * asin(least(1.0, 1.0 / {A_OVER_R}))', 5)} AS days FROM part")
def kepler_duration(part):
    return part.select("p_partkey", rounded(astro.central_duration(F.col("p_size").cast("double"), 0.5 + F.col("p_partkey") % 10), 5).alias("days"))


@query("part", sql="WITH p AS (SELECT p_partkey, p_size / 1000.0::DOUBLE AS depth, 0.5 + p_partkey % 5 AS rad FROM part), s AS (SELECT p_partkey, rad * sqrt(depth) * 9.731 AS r, sqrt(power(rad * 0.1 / rad, 2) + power(0.001 / depth * 0.5, 2)) AS share FROM p) SELECT p_partkey, " + sql_r("r") + " AS radius_rjup, " + sql_r("r * greatest(1 - share, 0)") + " AS radius_low, " + sql_r("r * (1 + share)") + " AS radius_high FROM s")
def radius_error(part):
    made = astro.implied_radius(F.col("p_size") / 1000.0, 0.5 + F.col("p_partkey") % 5, F.lit(0.001), F.lit(None).cast("double"))
    return part.select("p_partkey", *[rounded(c).alias(n) for n, c in made.items()])


@query("part", sql="SELECT p_partkey, " + sql_r("power(10.0, 3.5821 + 0.3153 * (p_size / 5.0 + 5 - 14) + 0.0504 * power(p_size / 5.0 + 5 - 14, 2))", 2) + " AS ppm FROM part")
def noise_model(part):
    return part.select("p_partkey", rounded(astro.noise_1h(F.col("p_size") / 5.0 + 5), 2).alias("ppm"))


@query("lineitem", sql="SELECT l_suppkey, bit_or(1::BIGINT << (CAST(l_quantity AS INT) - 1)) AS bits FROM lineitem GROUP BY l_suppkey")
def bitmask_sectors(lineitem):
    return lineitem.groupBy("l_suppkey").agg(astro.sectors_mask("l_quantity").alias("bits"))


@query("part", "supplier", sql="SELECT p_partkey, concat_ws('; ', CASE WHEN p_size > 40 THEN 'too large' END, CASE WHEN p_retailprice > 1500 THEN 'too bright' END) AS fails, CASE WHEN p_size > 40 OR p_retailprice > 1500 THEN 'fail' WHEN p_size > 30 THEN 'flag' ELSE 'pass' END AS verdict FROM part")
def verdict_rules(part, supplier):
    fails = F.array_compact(F.array(F.when(F.col("p_size") > 40, "too large"), F.when(F.col("p_retailprice") > 1500, "too bright")))
    return part.select("p_partkey", F.array_join(fails, "; ").alias("fails"), F.when(F.size(fails) > 0, "fail").when(F.col("p_size") > 30, "flag").otherwise("pass").alias("verdict"))


@query("part", sql="SELECT p_partkey, " + sql_r("0.40 * (1 - exp(-greatest(p_size - 10.0, 0) / 20)) + 0.20 * (1 - exp(-greatest(p_partkey % 12 - 3.0, 0) / 6)) + 0.15 * least(1.0, greatest(0.0, (13 - p_retailprice / 150) / 5))") + " AS score FROM part")
def score_parts(part):
    snr = 1 - F.exp(-F.greatest(F.col("p_size") - 10.0, F.lit(0.0)) / 20)
    orbit = 1 - F.exp(-F.greatest(F.col("p_partkey") % 12 - 3.0, F.lit(0.0)) / 6)
    bright = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (13 - F.col("p_retailprice") / 150) / 5))
    return part.select("p_partkey", rounded(0.40 * snr + 0.20 * orbit + 0.15 * bright).alias("score"))


@query("part", sql="SELECT concat_ws('|', p_partkey, replace(p_name, '|', '/'), p_brand, p_size) AS line FROM part")
def export_pipe_rows(part):
    return pipe_rows(part, ["p_partkey", "p_name", "p_brand", "p_size"])
