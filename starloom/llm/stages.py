"""Stages of the corpus pipeline: each works on all rows of ``docs`` and keeps their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import langid, minhash, packing
from starloom.llm import quality as rules
from starloom.llm import secrets as scans
from starloom.llm.common import bound_batches, materialise
from starloom.llm.queries import byte_bpe_encoder

#: Least score of a language that is believed.
LEAST_SCORE = 0.5
#: Bits that a text may take beyond its language's bound, so that short ones aren't judged by a few new bytes.
SPARE_BITS = 64
MASK = "[secret]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.judge(docs, labels).where("kept").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned from the rows' own labels: by score, and by the code length of their words."""
    bound_batches(spark)
    trees = langid.learn_words(docs)
    bound = F.lit(float(langid.UNLEARNED))
    for lang, rate in langid.bounds(docs, trees).items():
        bound = F.when(F.col("lang_pred") == lang, F.lit(rate)).otherwise(bound)
    found = langid.identify(docs, langid.learn(docs), trees=trees).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.where(F.col("bits") <= bound * F.octet_length("words") + SPARE_BITS).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates at five words and 0.8.

    Rows are told apart by a number of their own, so that null ids and ids that repeat with other
    texts are judged by their texts alone; the first row of a group stays. Rows without words stay.
    """
    bound_batches(spark)
    numbered = materialise(docs.select(F.monotonically_increasing_id().alias("number"), F.struct("*").alias("row")), "numbered")
    gone = minhash.near_duplicates(numbered.select("number", F.col("row.text").alias("text")), id_col="number").where("not kept").select(F.col("doc_id").alias("gone"))
    return numbered.join(gone, F.col("number") == F.col("gone"), "left_anti").select("row.*")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span, and what overlaps it, replaced by MASK. Spans stand in order of start."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        before = F.when(fresh, F.concat(F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit(MASK))).otherwise("")
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], before).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, F.char_length(text))))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    found = scans.scan(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("s_id"), F.col("key").alias("s_key"), "spans").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("d_key"))
    joined = rows.join(found, F.col("d_id").eqNullSafe(F.col("s_id")) & (F.col("d_key") == F.col("s_key")), "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(masked(F.col("row.text"), F.col("spans")))
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    bound_batches(spark)
    return packing.pack(packing.token_pieces(docs, byte_bpe_encoder()))
