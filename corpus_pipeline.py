"""The corpus pipeline: five operators in a row, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringwarden.llm.stages import keep_identified, keep_mixed, keep_representatives, keep_uncontaminated, shard
from ringwarden.staging import Staging

#: Mixture inference and fitted rates have no SQL form.
ORACLE_SQL = None

STAGES = [
    ("language_id", keep_identified),
    ("near_duplicates", keep_representatives),
    ("decontamination", keep_uncontaminated),
    ("mixing", keep_mixed),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass all stages, with shard and slot; each stage reads what the one before it wrote."""
    stage = Staging(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage.save(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
