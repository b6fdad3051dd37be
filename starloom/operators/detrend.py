"""Detrending of curves by a sliding biweight, in chunks of time with a halo of half a window.

Each task holds one chunk of a star and the rows within half a window of it, so every window is whole
and the result is the same for any width of chunks. Runs (a new one begins after a gap) break windows.
Between the places where the trend was estimated it runs on straight lines, however far they lie apart.

Columns: star, t, flux (finite), masked (rows to leave out of the estimate; they get a trend as well).
Rows with a null or NaN time or flux are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators import quantiles as q
from starloom.operators.chunks import carried, chunk_of, runs, with_halo
from starloom.operators.kernels import spread_out
from starloom.operators.shared import checkpointed

#: Gap that ends a run, rows that a run and a window need, upward limit in sigmas, steps a window.
GAP_D, LEAST_IN_RUN, LEAST_IN_WINDOW, UPWARD, STEPS = 0.5, 10, 5, 3.0, 12
#: Windows in a chunk.
WINDOWS_A_CHUNK = 8
#: Values in one block of windows.
CELLS = 400_000


def biweights(y: np.ndarray, low: np.ndarray, high: np.ndarray, c: float = 5.0, rounds: int = 5) -> np.ndarray:
    """Tukey's biweight location of y[low:high] for each pair, from the median on; all windows advance together."""
    out = np.empty(len(low))
    step = max(1, CELLS // max(int((high - low).max(initial=1)), 1))
    for begin in range(0, len(low), step):
        a, n = low[begin : begin + step], (high - low)[begin : begin + step]
        column, row = np.arange(n.max()), np.arange(len(n))
        inside = column < n[:, None]
        v = np.where(inside, y[np.minimum(a[:, None] + column, len(y) - 1)], 0.0)

        def middle(x: np.ndarray) -> np.ndarray:
            s = np.sort(np.where(inside, x, np.inf), axis=1)
            return (s[row, (n - 1) // 2] + s[row, n // 2]) / 2

        at, moving = middle(v), np.ones(len(n), bool)
        for _ in range(rounds):
            spread = middle(np.abs(v - at[:, None]))
            moving &= spread > 0
            u = (v - at[:, None]) / np.where(moving, c * spread, 1.0)[:, None]
            w = np.where(inside & (np.abs(u) < 1), (1 - u * u) ** 2, 0.0)
            total = w.sum(axis=1)
            moving &= total > 0
            at = np.where(moving, (w * v).sum(axis=1) / np.where(moving, total, 1.0), at)
        out[begin : begin + step] = at
    return out


def finite(d: DataFrame) -> DataFrame:
    return d.where("t is not null and flux is not null and not isnan(t) and not isnan(flux) and abs(t) < double('inf') and abs(flux) < double('inf')")


#: (t, begins, ends, low, high): times to estimate at and the least number of rows.
Places = Callable[[np.ndarray, float, float, float, float], tuple[np.ndarray, int]]


def estimates(used: DataFrame, width: float, half: float, places: Places, rounds: int) -> DataFrame:
    """star, begins, node, value: the biweight at the places that a chunk's rows call for, where a window holds enough rows.

    ``places`` gives, for the times of a run's rows in and around a chunk, the times to estimate at and
    the least number of rows. A run's rows in a chunk are one row of arrays; the windows of all rows of
    a batch advance together.
    """

    def windows(x) -> tuple[np.ndarray, ...]:
        t = np.asarray(x.t, dtype=float)
        nodes, least = places(t, x.begins, x.ends, x.chunk * width, (x.chunk + 1) * width)
        nodes = nodes[np.floor(nodes / width) == x.chunk]
        a, b = np.searchsorted(t, nodes - half), np.searchsorted(t, nodes + half)
        enough = b - a >= least
        return nodes[enough], a[enough], b[enough]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            found = [windows(x) for x in pdf.itertuples(index=False)]
            begin = np.cumsum([0, *map(len, pdf["flux"])])
            low, high = (np.concatenate([w[i] + k for w, k in zip(found, begin)]) for i in (1, 2))
            n = [len(w[0]) for w in found]
            value = biweights(np.concatenate(pdf["flux"].to_list()), low, high, rounds=rounds)
            yield pdf[["star", "begins"]].loc[pdf.index.repeat(n)].assign(node=np.concatenate([w[0] for w in found]), value=value)

    star = used.schema["star"].dataType.simpleString()
    near = with_halo(used.select("star", "t", "flux", "begins", "ends"), width, half)
    g = near.groupBy("star", "chunk", "begins").agg(F.max("ends").alias("ends"), F.array_sort(F.collect_list(F.struct("t", "flux"))).alias("r"))
    rows = g.select("star", "chunk", "begins", "ends", F.col("r.t").cast("array<double>").alias("t"), F.col("r.flux").cast("array<double>").alias("flux"))
    return spread_out(rows, "star", "chunk", "begins").mapInPandas(run, f"star {star}, begins double, node double, value double")


def on_lines(rows: DataFrame, nodes: DataFrame, width: float, within_runs: bool) -> DataFrame:
    """Adds trend: straight lines between the nodes around each row, level beyond the first and last one; null without any."""
    names = [c for c in rows.columns if c != "chunk"]
    node = F.struct(F.col("node").alias("t"), "value", "begins")
    kind = "struct<t:double,value:double,begins:double>"
    both = rows.select("star", "t", F.struct(*names).alias("_row"), F.lit(None).cast(kind).alias("_node")).unionByName(
        nodes.select("star", F.col("node").alias("t"), F.lit(None).cast(rows.select(F.struct(*names).alias("r")).schema["r"].dataType).alias("_row"), node.alias("_node"))
    )
    both = both.withColumn("chunk", chunk_of(F.col("t"), width))
    if within_runs:
        # The key is the run, so that its ends are level.
        both = both.withColumn("_run", F.coalesce("_row.begins", "_node.begins"))
    keys = ("star", "_run") if within_runs else ("star",)
    both = carried(both, "_node", "_a", "_b", keys).where("_row is not null")
    along = (F.col("t") - F.col("_a.t")) / F.nullif(F.col("_b.t") - F.col("_a.t"), F.lit(0.0))
    line = F.coalesce(F.col("_a.value") + (F.col("_b.value") - F.col("_a.value")) * along, F.col("_a.value"), F.col("_b.value"))
    return both.select("_row.*", line.alias("trend"))


def sliding_biweight(d: DataFrame, window: float, step: float | None = None, gap: float = GAP_D, chunk: float | None = None, rounds: int = 5) -> DataFrame:
    """Adds trend: the biweight of the rows within half a window of a grid's nodes, a node each ``step`` from a run's first row on.

    A run with fewer than ten rows to use has its middle value; one in which no window holds five rows
    has the middle of those that may be used.
    """
    step, half = step or window / STEPS, window / 2
    width = chunk or WINDOWS_A_CHUNK * window
    d = checkpointed(runs(finite(d), gap, width))

    def places(t: np.ndarray, begins: float, ends: float, low: float, high: float) -> tuple[np.ndarray, int]:
        count = int(np.ceil((ends + step - begins) / step))
        first, last = max(int((low - begins) / step) - 1, 0), min(int((high - begins) / step) + 2, count)
        return begins + np.arange(first, max(last, first)) * step, LEAST_IN_WINDOW

    nodes = checkpointed(estimates(d.where("not masked"), width, half, places, rounds))
    # Runs without nodes to go by: short ones take all their rows, others those that may be used.
    held = nodes.groupBy(F.col("star").alias("n_star"), F.col("begins").alias("n_begins")).agg(F.lit(True).alias("held"))
    of_runs = d.groupBy("star", "begins").agg(F.count_if(~F.col("masked")).alias("n_used"))
    of_runs = of_runs.join(held, F.col("star").eqNullSafe(F.col("n_star")) & (F.col("begins") == F.col("n_begins")), "left")
    short = F.col("n_used") < LEAST_IN_RUN
    level = of_runs.where(short | F.col("held").isNull()).select(F.col("star").alias("l_star"), F.col("begins").alias("l_begins"), short.alias("short"))
    same = F.col("star").eqNullSafe(F.col("l_star")) & (F.col("begins") == F.col("l_begins"))
    rows = d.join(level, same).select("star", "begins", F.when(F.col("short") | ~F.col("masked"), F.col("flux")).alias("_y"))
    level = q.medians(rows, ("star", "begins"), F.col("_y"), "_level").select(F.col("star").alias("l_star"), F.col("begins").alias("l_begins"), "_level")
    out = on_lines(d, nodes, width, True).join(level, same, "left")
    return out.withColumn("trend", F.coalesce("_level", "trend")).drop("_level", "l_star", "l_begins", "begins", "ends")


def biweight_at_rows(d: DataFrame, window: float, gap: float = GAP_D, chunk: float | None = None, rounds: int = 15) -> DataFrame:
    """Adds trend: the biweight around every row that may be used, and straight lines over the others.

    A star with fewer than ten rows to use has their middle value, without any it has 1.
    """
    half, width = window / 2, chunk or WINDOWS_A_CHUNK * window
    d = checkpointed(finite(d))
    used = runs(d.where("not masked"), gap, width)
    few = d.groupBy("star").agg(F.count_if(~F.col("masked")).alias("n_used")).where(F.col("n_used") < LEAST_IN_RUN).select(F.col("star").alias("l_star"))
    places = lambda t, begins, ends, low, high: (np.unique(t), 1)
    nodes = checkpointed(estimates(used.drop("chunk"), width, half, places, rounds))
    same = F.col("star").eqNullSafe(F.col("l_star"))
    level = q.medians(d.where("not masked").join(few, same, "left_semi"), ("star",), F.col("flux"), "_level").select(F.col("star").alias("m_star"), "_level")
    few = few.join(level, F.col("l_star").eqNullSafe(F.col("m_star")), "left").select("l_star", F.coalesce("_level", F.lit(1.0)).alias("_level"))
    return on_lines(d, nodes, width, False).join(few, same, "left").withColumn("trend", F.coalesce("_level", "trend")).drop("_level", "l_star")


def flattened(d: DataFrame, limit: float = UPWARD) -> DataFrame:
    """Adds flat (flux over trend) and keep: finite and strictly below the star's middle by ``limit`` robust sigmas upward; dips are never clipped."""
    d = checkpointed(d.withColumn("flat", F.try_divide("flux", "trend")))
    good = F.col("flat").isNotNull() & ~F.isnan("flat") & (F.abs("flat") < float("inf"))
    s = q.robust_sigmas(d.where(good), ("star",), F.col("flat")).drop("n").withColumnsRenamed({"star": "s_star", "median": "_median", "sigma": "_sigma"})
    j = d.join(s, F.col("star").eqNullSafe(F.col("s_star")), "left")
    return j.withColumn("keep", F.coalesce(good & (F.col("flat") < F.col("_median") + limit * F.col("_sigma")), F.lit(False))).drop("s_star", "_median", "_sigma")
