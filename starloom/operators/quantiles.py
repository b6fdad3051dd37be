"""Exact quantiles of groups of any size.

A sketch of each group bounds the wanted rank from both sides; only values between the bounds, less
than a hundredth of the rows, are counted one by one. No group is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.operators.shared import checkpointed

#: The sketch's rank error is one in so many; groups of up to FEW times as many rows are counted whole.
ACCURACY, FEW = 1000, 4


def quantiles(d: DataFrame, keys: tuple[str, ...], value: Column, wanted: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """keys, n, and for each name the value of the given rank (from 0 on), which is a function of n and lies near the given share of n. Nulls don't count."""
    d = d.select(*keys, value.cast("double").alias("_x")).where("_x is not null")
    e = 2 / ACCURACY
    shares = sorted({s for s, _ in wanted.values()})
    ends = [min(max(s + side, 0.0), 1.0) for s in shares for side in (-e, e)]
    sketch = d.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.percentile_approx("_x", ends, ACCURACY).alias("_ends"))
    few = F.col("n") <= FEW * ACCURACY
    bound = lambda k, end, other: F.when(few | F.lit(ends[k] == end), F.col(other)).otherwise(F.col("_ends")[k])
    bounds = [(bound(2 * i, 0.0, "_min"), bound(2 * i + 1, 1.0, "_max")) for i in range(len(shares))]
    joined = d.join(sketch, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]) if keys else d.crossJoin(F.broadcast(sketch))  # one row
    x = F.col("_x")
    # Number of bounds at or below a value: odd between a pair of them, or on a bound itself.
    inside = F.lit(False)
    for low, high in bounds:
        inside = inside | ((x >= low) & (x <= high))
    zone = sum(((x > high).cast("int") for _, high in bounds), F.lit(0))
    counted = joined.groupBy(*keys, "n", zone.alias("_zone"), F.when(inside, x).alias("_v")).agg(F.count("*").alias("_c"))
    # Rows between two zones stand before the zone's own values, after those of the zone before.
    order = ["_zone", F.asc_nulls_first("_v")]
    upto = F.sum("_c").over(W.partitionBy(*keys, "n").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    placed = counted.withColumn("_upto", upto)
    at = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank), F.col("_v")))
    return placed.groupBy(*keys, "n").agg(*[at(rank(F.col("n"))).alias(name) for name, (_, rank) in wanted.items()])


def medians(d: DataFrame, keys: tuple[str, ...], value: Column, name: str = "median") -> DataFrame:
    """keys, n and the middle value, the mean of the two middle ones."""
    found = quantiles(d, keys, value, {"_a": (0.5, lambda n: F.floor((n - 1) / 2)), "_b": (0.5, lambda n: F.floor(n / 2))})
    return found.select(*keys, "n", ((F.col("_a") + F.col("_b")) / 2).alias(name))


def with_medians(d: DataFrame, keys: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """Adds the middle value of each row's group."""
    of = medians(d, keys, value, name).drop("n").withColumnsRenamed({k: f"_{k}" for k in keys})
    return d.join(of, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])


def robust_sigmas(d: DataFrame, keys: tuple[str, ...], value: Column, factor: float = 1.4826) -> DataFrame:
    """keys, n, median, sigma: ``factor`` times the middle distance from the middle. ``d`` is read several times."""
    d = d.select(*keys, value.alias("_y"))
    of = checkpointed(medians(d, keys, F.col("_y"), "median")).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    away = d.join(of.drop("n"), same).select(*keys, F.abs(F.col("_y") - F.col("median")).alias("_d"))
    return medians(away, keys, F.col("_d"), "_away").drop("n").join(of, same).select(*keys, "n", "median", (F.col("_away") * factor).alias("sigma"))


def nearest_rank(share: float) -> tuple[float, Callable[[Column], Column]]:
    """The value whose place is nearest to ``share`` of the way, halves upward."""
    return share, lambda n: F.floor((n - 1) * F.lit(share) + 0.5)


def upper_middle() -> tuple[float, Callable[[Column], Column]]:
    return 0.5, lambda n: F.floor(n / 2)
