"""The streaming jobs over files, against their batch forms."""

from pyspark.sql import functions as F

from starloom.operators.lists import latest
from starloom.streaming.monitor import run_latest, snapshot, windowed_counts


def files(spark, tmp_path, sf, parts=3):
    """events in files by a part of their id, so that later files bring late rows too."""
    d = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(parts):
        d.where(F.col("event_id") % parts == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    return d, spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def test_latest_states_equal_the_batch(spark, tmp_path, sf):
    d, source = files(spark, tmp_path, sf)
    run = run_latest(source, str(tmp_path / "out"), ["user_id"], ["ts", "event_id"], str(tmp_path / "check"))
    run.awaitTermination()
    done = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir() if p.name.startswith("snapshot="))
    got = snapshot(spark, str(tmp_path / "out"), done[-1], d).select("user_id", "ts", "event_id").collect()
    want = latest(d, ["user_id"], ["ts", "event_id"], ["ts", "event_id"]).select("user_id", "ts", "event_id").collect()
    assert len(done) == 3
    assert sorted(got) == sorted(want)


def test_a_second_start_adds_nothing(spark, tmp_path, sf):
    d, source = files(spark, tmp_path, sf, 2)
    for _ in range(2):
        run_latest(source, str(tmp_path / "out"), ["user_id"], ["ts", "event_id"], str(tmp_path / "check")).awaitTermination()
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("snapshot=")]) == 2


def test_windowed_counts_equal_the_batch(spark, tmp_path, sf):
    d, source = files(spark, tmp_path, sf, 1)
    q = windowed_counts(source).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = d.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    got = spark.table("windows")
    assert sorted(got.selectExpr("window.start", "event_type", "n").collect()) == sorted(want.selectExpr("window.start", "event_type", "n").collect())
