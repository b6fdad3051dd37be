"""Ranked lists, pages, shards, latest states, votes and tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.operators.shared import checkpointed


def top_per_group(d: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts groups before the shuffle too."""
    return d.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def interleaved(ranked: list[DataFrame]) -> DataFrame:
    """Lists with a rank, dealt in turn: adds source (place of the list), keeps the first row of each id."""
    both = None
    for k, d in enumerate(ranked):
        own = d.withColumn("source", F.lit(k))
        both = own if both is None else both.unionByName(own)
    first = both.groupBy("id").agg(F.min(F.struct("rank", "source")).alias("f"))
    return first.select("id", F.col("f.rank").alias("rank"), F.col("f.source").alias("source"))


def page_after(d: DataFrame, value: str, key: str, cursor: tuple | None, size: int) -> DataFrame:
    """``size`` + 1 rows from the highest value on, after the cursor (value, key): one more tells of a next page."""
    if cursor:
        d = d.where((F.col(value) < cursor[0]) | ((F.col(value) == cursor[0]) & (F.col(key) < cursor[1])))
    return d.orderBy(F.col(value).desc(), F.col(key).desc()).limit(size + 1)


def by_precedence(sources: list[DataFrame], key: str) -> DataFrame:
    """One row a key, from the first source that has it."""
    both = None
    for k, d in enumerate(sources):
        own = d.withColumn("source", F.lit(k))
        both = own if both is None else both.unionByName(own)
    rest = [c for c in both.columns if c not in (key, "source")]
    best = both.groupBy(key).agg(F.min_by(F.struct("source", *rest), F.struct("source", *rest)).alias("b"))
    return best.select(key, "b.*")


def latest(d: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's row that is last in ``order``: combined before the shuffle."""
    return d.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last")).select(*key, "last.*")


def run_states(d: DataFrame) -> DataFrame:
    """run, started, done, finished: the first start and the first finish stand; done is for good."""
    done = F.col("state") == "done"
    return d.groupBy("run").agg(F.min("t").alias("started"), F.coalesce(F.bool_or(done), F.lit(False)).alias("done"), F.min(F.when(done, F.col("t"))).alias("finished"))


def progress(d: DataFrame) -> DataFrame:
    """run, done, shards: sum of each shard's last value."""
    last = latest(d, ["run", "shard"], ["t", "seq"], ["done"])
    return last.groupBy("run").agg(F.sum("done").alias("done"), F.count("*").alias("shards"))


def tally(votes: DataFrame) -> DataFrame:
    """candidate, vote, n of each voter's last vote; a null vote withdraws."""
    last = latest(votes, ["candidate", "voter"], ["t", "seq"], ["vote"])
    return last.where("vote is not null").groupBy("candidate", "vote").agg(F.count("*").alias("n"))


def upsert_plan(stored: DataFrame, incoming: DataFrame, key: str, hash_col: str = "hash") -> DataFrame:
    """key, action: created, updated or unchanged for every incoming row by its content hash."""
    s = stored.select(F.col(key).alias("s_key"), F.col(hash_col).alias("s_hash"))
    action = F.when(F.col("s_key").isNull(), "created").when(F.col("s_hash") == F.col(hash_col), "unchanged").otherwise("updated")
    return incoming.join(s, F.col(key) == F.col("s_key"), "left").select(key, action.alias("action"))


def sensitivity(d: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """r_bin, p_bin, n, recovered, fraction; bins of ``grid`` without injections have fraction null."""
    t = d.groupBy("r_bin", "p_bin").agg(F.count("*").alias("n"), F.count_if("found").alias("recovered"))
    if grid is not None:
        t = grid.join(t, ["r_bin", "p_bin"], "left").fillna(0, ["n", "recovered"])
    return t.withColumn("fraction", F.when(F.col("n") > 0, F.col("recovered") / F.col("n")))


def marginals(d: DataFrame) -> DataFrame:
    """Counts by radius bin, by period bin and overall in one pass of grouping sets."""
    g = d.groupingSets([[F.col("r_bin")], [F.col("p_bin")], []], F.col("r_bin"), F.col("p_bin"))
    return g.agg(F.count("*").alias("n"), F.count_if("found").alias("recovered"))


def token_bucket(hits: DataFrame, per_minute: float) -> DataFrame:
    """key, seq, t, allowed of each hit: a bucket starts full, refills all the time and pays one for a hit.

    Hits of a key in order, folded in a grouped function: the state is a number and a time.
    """
    import pandas as pd

    def fold(key: tuple, rows):
        tokens, last, out = per_minute, None, []
        at: tuple
        for batch in rows:
            for at in batch.itertuples(index=False):
                tokens = min(per_minute, tokens + (0.0 if last is None else at.t - last) * per_minute / 60)
                last = at.t
                out.append((at.key, at.seq, at.t, tokens >= 1))
                tokens -= tokens >= 1
        return pd.DataFrame(out, columns=["key", "seq", "t", "allowed"])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return fold(key, [pdf.sort_values(["t", "seq"])])

    return hits.select("key", "seq", "t").groupBy("key").applyInPandas(run, hits.select("key", "seq", "t").schema.simpleString()[7:-1].replace(":", " ") + ", allowed boolean")


def placed(d: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """Adds the place of each row in its group (in all rows without keys), however large: rows are dealt by ranges of the order, ranked in their range and moved on by the rows in the ranges before.

    ``order`` ends with something that tells rows apart, else a group of ties stays in one range.
    """
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = checkpointed(d.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    before = p.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_{k}") for k in keys], "_before")
    own = p.withColumn("_own", F.row_number().over(W.partitionBy("_part", *keys).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_part") == F.col("_p")]
    return own.join(before, same).withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_p", "_own", "_before", *[f"_{k}" for k in keys])
