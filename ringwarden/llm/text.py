"""Columns for words and checksums that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Runs of anything but the ASCII white space.
SPACED = r"[^\x20\x09-\x0D]+"
#: Runs of digits, small letters and everything beyond ASCII (after lower-casing).
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, pattern: str = SPACED) -> Column:
    """The matches of ``pattern`` in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                      F.array().cast("array<string>"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string")) % n


def row_key() -> Column:
    """A number shared by rows with the same doc_id and text, never null."""
    return F.xxhash64("doc_id", "text")


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its size is proven small, else as it is."""
    return F.broadcast(df) if small_enough(df, rows) else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a dataset folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def unnest(df: DataFrame, array: str, name: str, *keep: str) -> DataFrame:
    """A row for each element of ``array``, none for an empty one.

    ``explode`` would add a filter on the array's size, and the optimiser moves
    that filter below the projection that computes the array, which then runs
    the whole tokenisation once per use.  The outer form has no such filter.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
