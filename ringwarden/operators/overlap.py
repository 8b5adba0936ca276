"""Texts of one set that are near duplicates of any text of another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwarden.operators.near_duplicates import few, key_grams, numbered, with_partners
from ringwarden.operators.ranking import rank_within
from ringwarden.staging import Staging

#: Slices in which the list of an n-gram is ranked.
SLICES = 64


def similar_to_any(rows: DataFrame, others: DataFrame, percent: int = 85, n: int = 3) -> DataFrame:
    """The ids of ``rows(id, key)`` whose n-grams have a Jaccard similarity of ``percent`` / 100 or more to some of ``others(id, key)``.

    Rows of both sets that by ``with_partners`` are similar to none of the other go first.
    Among the rest, a similar pair shares one of the rarest n-grams of each (as many as the misses
    that the similarity allows, plus one), so only the other set's are indexed.  The list of
    an n-gram is tried a few texts at a time, fourfold each round, and a row that is
    found goes: in a group of near copies most rows need one try.  Empty keys are similar to nothing.
    """
    stage = Staging(rows.sparkSession)
    sides = rows.select("id", "key", F.lit(0).alias("side")).unionByName(others.select(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "key", F.lit(1).alias("side")))
    all_ = stage.save(numbered(sides.where("key <> ''"), "side"), "texts")
    texts = stage.save(all_.groupBy("side", "t").agg(F.min("row").alias("row")), "keys")
    equal = texts.where("side = 0").select("t").join(texts.where("side = 1").select("t"), "t", "left_semi")
    maybe = with_partners(key_grams(all_, n, "row", "side"), percent, F.min("side"), F.max("side"))
    live = stage.save(texts.join(maybe, "row", "left_semi").select("row"), "live")
    sets = stage.save(key_grams(all_.join(few(live), "row", "left_semi"), n, "side", "t"), "sets")
    a, b = (sets.where(F.col("side") == side).select("t", "grams") for side in (0, 1))
    a = a.join(equal, "t", "left_anti")
    df = stage.save(b.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "frequencies")

    def prefix(s: DataFrame, name: str) -> DataFrame:
        """(t, size, gram): the rarest n-grams; those that the other set lacks come first and are not listed."""
        each = s.select("t", F.size("grams").alias("size"), F.explode("grams").alias("gram")).join(df, "gram")
        known = each.groupBy("t", "size").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
        room = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - (F.col("size") - F.size("g"))
        return stage.save(known.where(room > 0).select("t", "size", F.explode(F.slice("g", F.lit(1), room.cast("int"))["gram"]).alias("gram")), name)

    open_ = prefix(a, "open").withColumnsRenamed({"t": "a", "size": "sa"})
    posts = prefix(b, "posts").withColumnsRenamed({"t": "b", "size": "sb"})
    index = stage.save(rank_within(posts, ["gram"], [F.col("b")], F.pmod(F.xxhash64("b"), F.lit(SLICES)), SLICES, "place"), "index")
    longest = index.agg(F.max("place")).first()[0]
    ga, gb = a.withColumnsRenamed({"t": "a", "grams": "ga"}), b.withColumnsRenamed({"t": "b", "grams": "gb"})
    found, lo, hi = None, 0, 1
    while longest is not None and lo <= longest:
        near = (F.col("sa") * 100 >= F.col("sb") * percent) & (F.col("sb") * 100 >= F.col("sa") * percent)
        pairs = open_.join(index.where((F.col("place") >= lo) & (F.col("place") < hi)), "gram").where(near).select("a", "b").distinct()
        both = pairs.join(ga, "a").join(gb, "b").withColumn("n", F.size(F.array_intersect("ga", "gb")))
        hit = stage.save(both.where(F.col("n") * 100 >= percent * (F.size("ga") + F.size("gb") - F.col("n"))).select("a").distinct(), "hits")
        found = hit if found is None else found.unionByName(hit)
        open_ = stage.save(open_.join(hit, "a", "left_anti"), "open")
        lo, hi = hi, hi * 4
    named = all_.where("side = 0").select("id", F.col("t").alias("a"))
    same = named.join(equal.withColumnRenamed("t", "a"), "a", "left_semi").select("id")
    return same if found is None else same.unionByName(named.join(found, "a", "left_semi").select("id"))
