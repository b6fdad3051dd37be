"""Connected components of a graph given as a table of edges, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import discard, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) of every node on an edge (long ids).

    Alternates large-star and small-star steps until the edges are stars around the smallest node
    of each component. Each step is one minimum per node (combined before the shuffle) and one join
    that skewed keys don't gather in a task; every round is written to the shared folder, so the
    plan stays short and a lost executor costs one round. Nothing is collected but a count.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    e = materialise(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not are_stars(e):
        large = star(both_ways(e), larger_only=True)
        discard(e)
        e = star(large, larger_only=False)
        discard(large)
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = materialise(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), "components")
    discard(e)
    return out


def are_stars(e: DataFrame) -> bool:
    """Whether every larger end a has one edge, to a node that is itself the larger end of none."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def star(e: DataFrame, larger_only: bool) -> DataFrame:
    """Links neighbours of each node a to the smallest of them and itself: the larger ones, or the smaller and itself.

    The minima are written first: both sides of the join are then plain shuffles, of which Spark
    can split a partition that one node's edges fill.
    """
    least = materialise(e.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m")), "least")
    j = e.join(least, F.col("a") == F.col("n"))
    if larger_only:
        out = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
    out = materialise(out.where("a <> b").distinct(), "edges")
    discard(least)
    return out
