"""Newest row of each key, pages, fixed key lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest row of each key by ``order`` (then by nothing: give a total order).

    A maximum of structs, so it is summed before the exchange and a key with very
    many rows is one running maximum, not a sorted group.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows (1 to 100) in ``order``."""
    size, number = max(1, min(100, size)), max(0, number)
    return df.orderBy(*order).offset(number * size).limit(size)


def page_info(df: DataFrame, size: int) -> DataFrame:
    """(total, pages) for pages of ``size`` rows."""
    size = max(1, min(100, size))
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def zero_filled(counts: DataFrame, key: str, value: str, wanted: list[str]) -> DataFrame:
    """Counts by key in which every wanted key appears, 0 where it has no row; other keys stay."""
    fixed = counts.sparkSession.createDataFrame([(k,) for k in wanted], f"{key} string")
    return fixed.join(counts, key, "full").select(key, F.coalesce(value, F.lit(0)).cast("long").alias(value))


def optional(*conditions: Column | None) -> Column:
    """All given conditions; None means no filter."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out
