"""Points in ranges by an equal join: every range lies in at most two bins of its own size class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _class(length: Column) -> Column:
    """The least power of two that is no shorter than a range, as its exponent; -20 for the shortest."""
    return F.greatest(F.lit(-20), F.ceil(F.log2(F.greatest(length, F.lit(1e-6))))).cast("int")


def in_ranges(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """The pairs of a point and a range of one ``key`` with ``start`` <= ``at`` <= ``end``.

    A range goes to the bins of its size class in which it begins and ends, a point to one
    bin of each class that occurs (a few dozen at most), so neither long ranges nor
    many points of one key make long lists: bins are keys of an ordinary join.
    Ranges that end before they begin and null ends hold nothing.  Columns other than
    ``key`` must have different names.
    """
    low, high = F.col(start).cast("double"), F.col(end).cast("double")
    real = ranges.where(low <= high).withColumn("_class", _class(high - low))
    width = F.pow(F.lit(2.0), F.col("_class"))
    begin, stop = F.floor(low / width), F.floor(high / width)
    dealt = real.withColumn("_bin", F.explode(F.array_distinct(F.array(begin, stop))))
    classes = [r[0] for r in real.select("_class").distinct().collect()]  # powers of two of lengths
    steps = F.array(*[F.struct(F.lit(c).alias("_class"), F.floor(F.col(at).cast("double") / 2.0 ** c).alias("_bin")) for c in classes]) if classes else F.array().cast("array<struct<_class:int,_bin:bigint>>")
    placed = points.where(F.col(at).isNotNull()).withColumn("_b", F.explode(steps)).withColumns({"_class": F.col("_b._class"), "_bin": F.col("_b._bin")}).drop("_b")
    return placed.join(dealt, [key, "_class", "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_class", "_bin")
