"""Global ranks without one sorted task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwarden.staging import Staging


def rank_within(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, buckets: int,
                name: str = "rank") -> DataFrame:
    """Number the rows of each key from 0, gapless, even when a key holds most rows.

    Rows are dealt to ``buckets`` numbered slices by ``bucket`` (an integer in
    0..buckets-1, a function of the row); each slice is ranked alone and offset
    by the sizes of the slices before it.  So the order is (bucket, order), and
    no task holds more than one slice of a key.  ``df`` is read twice and should
    be a stored table; ``order`` must be total for a repeatable result.
    """
    dealt = df.withColumn("_bucket", bucket.cast("int"))
    sizes = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_inside", F.row_number().over(inside) - 1)
    return (ranked.join(offsets, [*keys, "_bucket"])
            .withColumn(name, (F.col("_inside") + F.col("_before")).cast("long"))
            .drop("_bucket", "_inside", "_before"))


def rank_by_range(df: DataFrame, keys: list[str], column: str, name: str = "rank") -> DataFrame:
    """Number the rows of each key from 0 in the order of ``column``, nulls first; equal values in any order.

    Rows are cut into ranges of about equal numbers of rows, whatever the values
    are: small, sparse, negative or text.  So neither the span of the values nor the
    size of a key decides how much a task sorts.
    """
    spark = df.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = Staging(spark).save(df.repartitionByRange(slices, column).withColumn("_slice", F.spark_partition_id()), "ranges")
    return rank_within(cut, keys, [F.col(column)], F.col("_slice"), slices, name).drop("_slice")
