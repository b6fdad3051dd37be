"""Live progress: latest states, run states and votes as Structured Streaming upserts.

Each micro-batch is reduced to one row a key and merged with the stored snapshot of that key; a new
snapshot is written beside the old one, so a restarted batch gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starloom.operators.lists import latest


def merge_latest(stored: DataFrame | None, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key, last in ``order``; equal order values: the batch's row wins over the stored one."""
    columns = batch.columns
    new = batch.withColumn("_new", F.lit(1))
    both = new if stored is None else new.unionByName(stored.withColumn("_new", F.lit(0)))
    return latest(both, key, [*order, "_new", *sorted(set(columns) - {*key, *order})], [c for c in columns if c not in key]).select(*columns)


def run_latest(source: DataFrame, folder: str, key: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps ``folder``/snapshot=N: the latest row of each key after batch N."""
    spark = source.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = snapshot(spark, folder, number - 1, batch) if number else None
        merge_latest(before, batch, key, order).write.mode("overwrite").parquet(f"{folder}/snapshot={number}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, folder: str, number: int, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(f"{folder}/snapshot={number}")


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts by event type and window of event time; rows later than ``late`` are dropped by the watermark. Times without a zone count in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
