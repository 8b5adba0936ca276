"""Which rows of a labelled corpus are kept, and why the others go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwarden.functions.scalar import clean_text, duplicate_key

REASONS = ["missing_text", "empty_text", "invalid_label", "conflicting_label", "exact_duplicate"]


def audited(rows: DataFrame) -> DataFrame:
    """``rows`` (id, source, text, label) with clean text and ``reason``: the first thing wrong, null for a row that is kept.

    Null texts are missing, texts of white space alone empty, labels other than 0 and 1
    invalid.  Of the rest, rows of one source with one key are copies: all go if their
    labels differ, else all but the least id, which should be unique.  Copies are summed
    to one row a key before they meet their rows again; a null source is a source.
    """
    clean = clean_text(F.col("text"))
    early = (F.when(F.col("text").isNull(), REASONS[0]).when(F.col("clean") == "", REASONS[1])
             .when(~F.coalesce(F.trim(F.col("label").cast("string")).isin("0", "1"), F.lit(False)), REASONS[2]))
    all_ = rows.withColumns({"clean": clean, "key": duplicate_key(F.col("text"))}).withColumn("_early", early)
    label = F.trim(F.col("label").cast("string"))
    copies = (all_.where("_early is null").groupBy(F.col("source").alias("_source"), F.col("key").alias("_key"))
              .agg(F.min("id").alias("_first"), (F.min(label) != F.max(label)).alias("_differ")))
    met = all_.join(copies, F.col("_early").isNull() & F.col("source").eqNullSafe(F.col("_source")) & (F.col("key") == F.col("_key")), "left")
    reason = F.coalesce("_early", F.when(F.col("_differ"), REASONS[3]).when(F.col("id") != F.col("_first"), REASONS[4]))
    return met.withColumn("reason", reason).drop("_early", "_source", "_key", "_first", "_differ", "key")


def audit_report(checked: DataFrame, marked: str, short: int = 3, long: int = 1500) -> DataFrame:
    """One row a source of ``audited`` rows: rows, rows by reason, rows kept, and of those the short, the long and the ones without a mark."""
    kept, words = F.col("reason").isNull(), F.size(F.split("clean", " "))
    return checked.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(r) for r in REASONS], F.count_if(kept).alias("kept"),
        F.count_if(kept & (words < short)).alias("short"), F.count_if(kept & (words > long)).alias("long"), F.count_if(kept & ~F.col("text").rlike(marked)).alias("without_marks"))
