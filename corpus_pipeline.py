"""The corpus pipeline: quality rules, language ID, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the
shared folder and rereads it as the next stage's docs. All stages but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starloom.llm import stages
from starloom.llm.common import discard, materialise

STAGES = [
    ("quality", stages.quality),
    ("language", stages.language),
    ("near_duplicates", stages.near_duplicates),
    ("secrets", stages.secrets),
    ("packing", stages.packing_stage),
]

#: Near-duplicate components and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
