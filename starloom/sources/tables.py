"""Tables in and out: Parquet, CSV lists with comments, JSON records, pipe-delimited exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def curve(events: DataFrame) -> DataFrame:
    """Events as a light curve: event_id, star, sector, t (days), flux."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86400e6)
    return events.select("event_id", F.col("user_id").alias("star"), F.col("event_type").alias("sector"), t.alias("t"), F.col("value").alias("flux"))


def read_list(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A delimited list whose lines may begin with # as comments; all columns are strings."""
    return spark.read.option("sep", sep).option("comment", "#").option("header", header).csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """tic of each line that names one, with or without a TIC prefix; comments go."""
    return spark.read.text(path).select(F.regexp_extract(F.regexp_replace("value", "#.*", ""), r"(?i)^\s*(?:TIC\s*)?([0-9]+)", 1).alias("tic")).where("tic <> ''").select(F.col("tic").cast("long"))


def read_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, broken files) of a folder of JSON documents, one a file; a broken file keeps its text and name."""
    parsed = F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    d = spark.read.text(path, wholetext=True).select(parsed.alias("r"), F.col("_metadata.file_name").alias("file"))
    broken = F.col("r").isNull() | F.col("r._broken").isNotNull()
    return d.where(~broken).select("r.*", "file").drop("_broken"), d.where(broken).select("file", F.col("r._broken").alias("_broken"))


def number(text) -> Column:
    """A finite number, or null where the text holds none."""
    x = F.expr(f"try_cast({text} as double)")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clean_cell(value) -> Column:
    """Text that a pipe-delimited line can hold: no pipes, single spaces, null as empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\|", "/"), r"\s+", " "))


def pipe_rows(d: DataFrame, columns: list[str]) -> DataFrame:
    """One line for each row, its cells joined by pipes."""
    return d.select(F.concat_ws("|", *[clean_cell(F.col(c)) for c in columns]).alias("line"))


def write_pipe(d: DataFrame, columns: list[str], path: str) -> None:
    pipe_rows(d, columns).write.text(path)
