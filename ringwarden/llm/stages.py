"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and applies one operator to all of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwarden.llm.decontaminate import uncontaminated
from ringwarden.llm.jaccard_join import representatives
from ringwarden.llm.language_id import identify
from ringwarden.llm.mixing import label_domains, mix
from ringwarden.llm.sharding import assign_shards

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Wanted shares of tokens; only the domains above their share are thinned.
PIPELINE_WEIGHTS = {"q1t0": 0.95, "q0t0": 0.04, "q1t1": 0.01}


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which one language makes up half of the words or more; ``und`` goes.

    So null texts and texts without letters go; null and repeated ids, repeated rows
    and very long texts are judged like others.  An empty table gives an empty result.
    """
    found = identify(docs, docs.select("text", "lang"))
    return found.where("lang_pred <> 'und' and score >= 0.5").select(*COLUMNS)


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group (five words, similarity 0.8), that with the smallest id.

    Null and repeated ids, null, empty and very long texts and repeated rows: see
    ``representatives``.  An empty table gives an empty result.
    """
    return representatives(docs.select(*COLUMNS), n=5, percent=80)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item, or all of a shorter one.

    Null, empty and very long texts, null and repeated ids and repeated rows: see
    ``contamination``; every row is judged by its own text.  An empty table gives an
    empty result, an empty benchmark drops nothing.
    """
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return uncontaminated(docs.select(*COLUMNS), items)


def keep_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thin the domains that are above their target share, each document by its fitted rate.

    The draw is a hash of id and text, so it is the same in every run, null and
    repeated ids are drawn by their own texts, and repeated rows share one draw.
    Null, empty and very long texts: see ``mix``.  An empty table gives an empty
    result; without labels every document stays.
    """
    rated = mix(docs.select(*COLUMNS), label_domains(spark, sf_dir), PIPELINE_WEIGHTS, only_less=True)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("mix")), F.lit(1_000_000)) / 1_000_000
    return rated.where(draw < F.col("rate")).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for every row that is left, those with null or repeated ids too; see ``assign_shards``."""
    return assign_shards(docs.select("doc_id", "text")).select("doc_id", "size", "text_crc32", "shard", "slot")
