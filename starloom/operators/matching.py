"""Joins of catalogues: by period, by predicted time, by position, by nearest time.

Range and distance joins get equality keys from cells (of the sky, of time) and keep an exact test
after them, so Spark can plan a hash or sort-merge join; cells are as wide as the tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.functions.astro import alias_of, separation


def period_aliases(found: DataFrame, listed: DataFrame, on: str = "star") -> DataFrame:
    """Pairs of the same ``on`` whose periods stand in one of the ratios; alias: the first that fits."""
    return found.join(listed, on).withColumn("alias", alias_of(F.col("period"), F.col("listed_period"))).where("alias is not null")


def predicted_epochs(events: DataFrame, listed: DataFrame, slack: float, on: str = "star") -> DataFrame:
    """Events within ``slack`` of the epoch nearest to them that ``listed`` (t0, period) predicts."""
    j = events.join(listed, on).withColumn("n", F.bround((F.col("t") - F.col("t0")) / F.col("period")).cast("long"))
    return j.withColumn("off", F.abs(F.col("t") - F.col("t0") - F.col("n") * F.col("period"))).where(F.col("off") < slack)


def cone_join(left: DataFrame, right: DataFrame, degrees: float) -> DataFrame:
    """Pairs (l_*, r_*) less than ``degrees`` apart; columns id, ra, dec on both sides.

    Bands of declination are the keys, with cells of right ascension inside; the right side goes to
    its own cell and those next to it, over as many of them as the pole's convergence asks for.
    """
    bands = F.floor((F.col("dec") + 90) / degrees)
    # The widest step in right ascension that a band's pairs can span; a band near a pole is one cell.
    edge = F.greatest(F.abs(bands * degrees - 90), F.abs((bands + 1) * degrees - 90)) + degrees
    cells = F.when(edge >= 89, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(edge)) / (degrees * 1.01)).cast("int")))
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], bands.alias("l_band"), cells.alias("l_cells"), F.floor(F.pmod("ra", F.lit(360.0)) / 360.0 * cells).alias("l_cell"))
    at = right.withColumn("band", F.explode(F.sequence(bands - 1, bands + 1)))
    edge_of = F.greatest(F.abs(F.col("band") * degrees - 90), F.abs((F.col("band") + 1) * degrees - 90)) + degrees
    n = F.when(edge_of >= 89, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(edge_of)) / (degrees * 1.01)).cast("int")))
    own = F.floor(F.pmod("ra", F.lit(360.0)) / 360.0 * F.col("n"))
    at = at.withColumn("n", n).withColumn("cell", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(own + k, F.col("n"))))))
    r = at.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.col("band").alias("r_band"), F.col("cell").alias("r_cell"))
    apart = separation(F.col("l_ra"), F.col("l_dec"), F.col("r_ra"), F.col("r_dec"))
    j = l.join(r, (F.col("l_band") == F.col("r_band")) & (F.col("l_cell") == F.col("r_cell"))).withColumn("apart", apart)
    return j.where(F.col("apart") < degrees).drop("l_band", "r_band", "l_cell", "r_cell", "l_cells")


def near_in_time(left: DataFrame, right: DataFrame, within: float, on: str) -> DataFrame:
    """Pairs of equal ``on`` at most ``within`` apart in t; right columns get the prefix r_."""
    cell = lambda c: F.floor(c / F.lit(within))
    l = left.withColumn("_cell", cell(F.col("t")))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.explode(F.sequence(cell(F.col("t")) - 1, cell(F.col("t")) + 1)).alias("r_cell"))
    j = l.join(r, (F.col(on) == F.col(f"r_{on}")) & (F.col("_cell") == F.col("r_cell")))
    return j.where(F.abs(F.col("t") - F.col("r_t")) <= within).drop("_cell", "r_cell")


#: A share of a number that moves it by its last bit.
LAST_BIT = 1.5 * 2.0**-53


def others_near(d: DataFrame, within: float, on: str, who: str) -> DataFrame:
    """``d`` with neighbours: how many other ``who`` have a row of equal ``on`` at most ``within`` away in t. Rows without one of the three go.

    No pairs: what a ``who`` covers begins where it reaches no row of its own before, and ends likewise;
    a row's neighbours are what has begun and not ended by its time. Sums run inside cells of time, one
    row for each cell carries what is open at its beginning.
    """
    t = F.col("t")
    low, high = t - within, t + within
    # The outermost numbers that a difference of doubles puts within reach.
    d = d.where(f"`{on}` is not null and `{who}` is not null and t is not null and not isnan(t)")
    d = d.withColumns({"_low": F.when(t - low > within, low + F.abs(low) * LAST_BIT).otherwise(low), "_high": F.when(high - t > within, high - F.abs(high) * LAST_BIT).otherwise(high)})
    w = W.partitionBy(on, who).orderBy("t")
    begins = F.coalesce(F.col("_low") > F.lag("_high").over(w), F.lit(True))
    ends = F.coalesce(F.col("_high") < F.lead("_low").over(w), F.lit(True))
    d = d.withColumns({"_begins": begins, "_ends": ends})
    names = [c for c in d.columns if not c.startswith("_")]
    mark = lambda x, kind, step: F.struct(x.alias("x"), F.lit(kind).alias("kind"), F.lit(step).cast("long").alias("step"))
    marks = F.array(F.when(F.col("_begins"), mark(F.col("_low"), 0, 1)), mark(t, 1, 0), F.when(F.col("_ends"), mark(F.col("_high"), 2, -1)))
    m = d.select(*names, F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("_m")).select(*names, F.col("_m.x").alias("_x"), F.col("_m.kind").alias("_kind"), F.col("_m.step").alias("_step"))
    m = m.withColumn("_cell", F.floor(F.col("_x") / within))
    before = W.partitionBy("_on").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    cells = m.groupBy(F.col(on).alias("_on"), F.col("_cell").alias("_at")).agg(F.sum("_step").alias("_sum")).select("_on", "_at", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_open"))
    here = F.sum("_step").over(W.partitionBy(on, "_cell").orderBy("_x", "_kind").rowsBetween(W.unboundedPreceding, 0))
    rows = m.withColumn("_here", here).where("_kind = 1")
    return rows.join(cells, (F.col(on) == F.col("_on")) & (F.col("_cell") == F.col("_at"))).select(*names, (F.col("_open") + F.col("_here") - 1).alias("neighbours"))


def last_before(left: DataFrame, right: DataFrame, on: str, value: str) -> DataFrame:
    """``left`` with the ``value`` and time (r_t) of the last row of ``right`` at or before t; null if none.

    A union in order of time instead of a range join: rows of a key are sorted once.
    """
    l = left.select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias(f"_{value}"), F.lit(None).cast("double").alias("_t"), F.lit(1).alias("_side"))
    keep = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in (on, "t") else F.col(f.name) for f in left.schema]
    r = right.select(*keep, F.col(value).alias(f"_{value}"), F.col("t").alias("_t"), F.lit(0).alias("_side"))
    w = W.partitionBy(on).orderBy("t", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = l.unionByName(r).withColumns({f"r_{value}": F.last(f"_{value}", True).over(w), "r_t": F.last("_t", True).over(w)})
    return both.where("_side = 1").select(*left.columns, f"r_{value}", "r_t")


def requeue(items: DataFrame, done: DataFrame, on: str, failed: Column, attempts: int) -> DataFrame:
    """Items without a result, or whose result ``failed`` with attempts left."""
    return items.join(done, on, "left").where(F.col("tries").isNull() | (failed & (F.col("tries") < attempts)))


def drop_reasons(d: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """reason, n: how many rows the first reason that holds drops; those that none drops are 'kept'."""
    reason = F.coalesce(*[F.when(c, name) for name, c in reasons], F.lit("kept"))
    return d.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
