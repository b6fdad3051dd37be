import random

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from starloom.llm import stages
from starloom.llm.common import BATCH_BYTES, BATCH_SETTING

from .conftest import SCHEMA, prose


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "secrets", "packing"]
    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))


def test_each_stage_keeps_columns_and_clean_rows(spark, tmp_path):
    rows = [(i, " ".join(prose(i, 120)), "en", "a", 0) for i in range(30)]
    rows += [(50, rows[0][1] + " more", "en", "b", 0), (50, rows[0][1] + " more", "en", "b", 0), (51, "too short", "en", "b", 0), (52, None, None, None, None), (53, "12 " * 100, "en", "b", 0), (None, " ".join(prose(77, 90)), "en", "b", 0)]
    rows.append((54, " ".join(prose(78, 90)) + ' token = "abcdef0123456789" end', "en", "b", 0))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("mine"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = stages.quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {*range(30), 50, 54, None}
    kept = stages.language(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*range(30), 50, 51, 54, None}
    found = stages.near_duplicates(spark, docs, str(tmp_path))
    got = [r["doc_id"] for r in found.collect()]
    assert found.columns == docs.columns and sorted(i for i in got if i is not None and i not in (0, 50)) == [*range(1, 30), 51, 52, 53, 54]
    assert len({0, 50} & set(got)) == sum(i in (0, 50) for i in got) == 1 and got.count(None) == 1
    clean = {r["doc_id"]: r["text"] for r in stages.secrets(spark, docs, str(tmp_path)).collect()}
    assert clean[54].endswith(" [secret]\" end") and "abcdef0123456789" not in clean[54] and clean[3] == rows[3][1] and clean[52] is None
    assert stages.packing_stage(spark, docs, str(tmp_path)).where("doc_tokens = 1").count() == 1


def test_ids_that_repeat_are_judged_by_their_texts(spark, tmp_path):
    a, b, c = (" ".join(prose(i, 120)) for i in (200, 201, 202))
    rows = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (2, c, "en", "s", 0), (3, b + " more", "en", "s", 0), (None, c, "en", "s", 0), (None, None, "en", "s", 0)]
    kept = stages.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert len(kept) == 4 and {" ".join(r["text"].split()[:3]) for r in kept if r["text"]} == {" ".join(t.split()[:3]) for t in (a, b, c)}


def test_run_is_the_stages_in_turn(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 50


def test_language_stage_rejects_what_was_never_learned(spark, sf):
    r = random.Random(5)
    alphabets = ["bcdfghjklmnpqrstvwxz", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x5200)))]
    foreign = [(10_000_000 + 100 * k + i, " ".join("".join(r.choice(a) for _ in range(r.randint(3, 9))) for _ in range(80)), None, "x", 0) for k, a in enumerate(alphabets) for i in range(20)]
    clean = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    unlabelled = F.when(F.col("doc_id") % 4 != 0, F.col("lang"))
    given = clean.withColumn("lang", unlabelled)
    for rows in (given, given.where("lang = 'en'")):
        docs = rows.unionByName(spark.createDataFrame(foreign, SCHEMA))
        kept = stages.language(spark, docs, sf)
        assert kept.where("doc_id >= 10000000").count() == 0
        assert rows.where(F.col("text").rlike(r"\p{L}")).select("doc_id").subtract(kept.select("doc_id")).count() == 0


def batch_bytes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])


@pytest.mark.parametrize("stage", [stages.language, stages.near_duplicates, stages.packing_stage])
def test_python_gets_texts_in_bounded_batches(spark, tmp_path, stage):
    """Whatever the number of rows; a limit that the session names stays, and results don't depend on it."""
    texts = [" ".join(prose(i // 2, 150)) + " more" * (i % 2) for i in range(24)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    long = spark.range(20, numPartitions=1).select(F.repeat(F.lit("word "), 200_000).alias("text"))
    out = {}
    try:
        for own in ("none", "2000"):
            spark.conf.set(BATCH_SETTING, own) if own != "none" else spark.conf.unset(BATCH_SETTING)
            out[own] = sorted(map(tuple, stage(spark, docs, str(tmp_path)).collect()))
            if own == "none":
                sizes = [r["n"] for r in long.mapInArrow(batch_bytes, "n long").collect()]
                assert len(sizes) > 1 and max(sizes) < BATCH_BYTES + 1_100_000
            else:
                assert spark.conf.get(BATCH_SETTING) == own
    finally:
        spark.conf.unset(BATCH_SETTING)
    assert out["none"] == out["2000"] and out["none"]
