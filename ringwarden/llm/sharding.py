"""Sharding by balanced label propagation.

Documents with equal texts are linked.  All copies of a text that lie in one
shard are one row (group, shard, n) of the state, so a round costs joins of those
rows, never the links between all copies.  A round: every group looks at where
its neighbours are, the copies outside the fullest shard ask to move there, and a
shard admits them, largest block first, while its quota lasts.  Movers leave, so
room opens for the next round.  Documents without a copy have no link and no
wish; they fill what the groups leave, to an exact balance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwarden.llm.text import documents
from ringwarden.operators.ranking import rank_within
from ringwarden.staging import Staging

#: Rows that one slice of a ranked key holds, about.
SLICE_ROWS = 20_000


def _slice(buckets: int, *seed: Column) -> Column:
    return F.pmod(F.xxhash64(*seed), F.lit(buckets)).cast("int")


def _running(df: DataFrame, keys: list[str], value: str, order: list[Column], bucket: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before this one within the keys, order (bucket, order); see rank_within."""
    from pyspark.sql import Window

    dealt = df.withColumn("_bucket", bucket)
    sizes = dealt.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(offsets, [*keys, "_bucket"]).withColumn(name, F.col("_inside") + F.col("_before"))
            .drop("_bucket", "_inside", "_before"))


def propagate(state: DataFrame, quotas: DataFrame, buckets: int, rounds: int, stage: Staging) -> DataFrame:
    """(group, shard, n) after at most ``rounds`` rounds of capacity-bound moves.

    ``quotas`` is (shard, quota) with one row a shard.  A group wishes for the
    shard with most of its copies that has room for one more (the lower shard on
    a tie).  Stops early when no group can gain.
    """
    for _ in range(rounds):
        load = state.groupBy("shard").agg(F.sum("n").alias("load"))
        room = stage.save(quotas.join(load, "shard", "left")
                          .select("shard", (F.col("quota") - F.coalesce("load", F.lit(0))).alias("room")), "room")
        open_shards = F.broadcast(room.where("room > 0"))
        best = (state.join(open_shards, "shard").groupBy("group")
                .agg(F.max(F.struct("n", (-F.col("shard")).alias("s"))).alias("b"))
                .select("group", (-F.col("b.s")).alias("to"), F.col("b.n").alias("there")))
        wish = stage.save(state.join(best, "group").where("shard <> to and (n < there or (n = there and to < shard))"), "wishes")
        # Large blocks first: the slices are ranges of block size, then of the group's hash.
        size_class = F.least(F.floor(F.log2(F.col("n"))), F.lit(30))
        sliced = ((30 - size_class) * buckets + _slice(buckets, F.col("group"))).cast("int")
        queued = _running(wish, ["to"], "n", [F.col("group"), F.col("shard")], sliced, "before")
        admitted = stage.save(queued.join(F.broadcast(room.withColumnRenamed("shard", "to")), "to")
                              .withColumn("moved", F.greatest(F.least("n", F.col("room") - F.col("before")), F.lit(0)))
                              .where("moved > 0").select("group", "shard", "to", "moved"), "moves")
        if admitted.isEmpty():
            break
        change = (admitted.select("group", "shard", (-F.col("moved")).alias("n"))
                  .unionByName(admitted.select("group", F.col("to").alias("shard"), F.col("moved").alias("n"))))
        state = stage.save(state.unionByName(change).groupBy("group", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "state")
    return state


def first_labels(groups: DataFrame, total: int, shards: int, buckets: int, stage: Staging) -> DataFrame:
    """(group, shard, n) to start from: groups laid in a line that is cut into equal pieces.

    A group that fills whole shards gets them first (there are at most ``shards``
    such groups); the line of all others, and of what is left of those, is spread
    over the other shards, so that each has room for its neighbours to move in.
    """
    spark, quota = groups.sparkSession, max(1, total // shards)
    blocks, used, left = [], 0, []
    for r in groups.where(F.col("copies") >= quota).orderBy(F.desc("copies"), "group").collect() if total >= shards else []:
        whole = min(r["copies"] // quota, shards - 1 - used)
        blocks += [(r["group"], used + k, quota) for k in range(whole)]
        used += whole
        left.append((r["group"], r["copies"] - whole * quota))
    full = spark.createDataFrame(blocks, "group string, shard int, n long")
    rest = spark.createDataFrame([x for x in left if x[1]], "group string, n long").unionByName(
        groups.where(F.col("copies") < quota).select("group", F.col("copies").alias("n")) if total >= shards else groups.select("group", F.col("copies").alias("n")))
    rest = stage.save(rest, "line")
    length = rest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    piece = max(1, -(-length // (shards - used)))
    at = _running(rest.withColumn("all", F.lit(0)), ["all"], "n", [F.col("group")], _slice(buckets, F.col("group")), "before")
    lo, hi = F.floor(F.col("before") / piece), F.floor((F.col("before") + F.col("n") - 1) / piece)
    cut = at.select("group", "before", "n", F.explode(F.sequence(lo, hi)).alias("k"))
    size = F.least(F.col("before") + F.col("n"), (F.col("k") + 1) * piece) - F.greatest(F.col("before"), F.col("k") * piece)
    return full.unionByName(cut.select("group", (F.col("k") + used).cast("int").alias("shard"), size.alias("n")))


def assign_shards(docs: DataFrame, shards: int = 16, rounds: int = 6) -> DataFrame:
    """Give every row of ``docs`` a shard and a slot, counts at most one apart, copies together.

    Returns (row, doc_id, size, text_crc32, shard, slot): row is a gapless number
    of the rows (repeated ids are rows of their own), size the UTF-8 bytes of the
    text plus one, slot a gapless number in the shard from 0.  Equal texts are one
    group; null texts are a group too, as are empty ones.  A group larger than a
    shard's quota is spread over as few shards as propagation reaches.  Other
    columns of ``docs`` are not read; an empty table gives an empty result.
    """
    stage = Staging(docs.sparkSession)
    text = F.col("text")
    rows = stage.save(docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(text.isNull(), F.lit("-")).otherwise(F.md5(text.cast("binary"))).alias("group")), "rows")
    total = rows.count()
    buckets = max(1, total // SLICE_ROWS)
    quotas = docs.sparkSession.createDataFrame(
        [(k, total // shards + (k < total % shards)) for k in range(shards)], "shard int, quota long")

    by_group = stage.save(rows.groupBy("group").agg(F.count(F.lit(1)).alias("copies")), "groups")
    marked = stage.save(rows.join(by_group, "group"), "marked")
    # Copies are numbered in their group, so that a count of copies is a set of rows.
    spread = _slice(buckets, F.col("doc_id"), F.lit(1))
    total_order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    many = stage.save(rank_within(marked.where("copies > 1"), ["group"], total_order, spread, buckets, "nth"), "copies")
    started = first_labels(by_group.where("copies > 1"), total, shards, buckets, stage)
    state = propagate(stage.save(started, "state"), quotas, buckets, rounds, stage)

    # No shard may hold more copies than its quota: what is over goes back to the free rows.
    at = stage.save(_running(state, ["shard"], "n", [F.col("group")], _slice(buckets, F.col("group")), "before"), "placed")
    kept = (at.join(F.broadcast(quotas), "shard")
            .withColumn("n", F.greatest(F.least("n", F.col("quota") - F.col("before")), F.lit(0))).where("n > 0"))
    ranges = stage.save(_running(kept.select("group", "shard", "n"), ["group"], "n", [F.col("shard")], F.lit(0), "lo"), "ranges")
    by_place = many.join(ranges.groupBy("group").agg(F.collect_list(F.struct("lo", "n", "shard")).alias("r")), "group")
    hit = F.filter("r", lambda x: (F.col("nth") >= x["lo"]) & (F.col("nth") < x["lo"] + x["n"]))
    seated = stage.save(by_place.select("doc_id", "size", "text_crc32", "group", "nth", F.get(hit, 0)["shard"].alias("shard")), "seated")

    free = stage.save(marked.where("copies = 1").select("doc_id", "size", "text_crc32", "group", F.lit(0).cast("long").alias("nth"))
                      .unionByName(seated.where("shard is null").drop("shard"))
                      .unionByName(many.join(ranges.select("group").distinct(), "group", "left_anti").select("doc_id", "size", "text_crc32", "group", "nth")), "free")
    taken = seated.where("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("taken"))
    gaps = [(r["shard"], r["gap"]) for r in quotas.join(taken, "shard", "left").select(
        "shard", (F.col("quota") - F.coalesce("taken", F.lit(0))).alias("gap")).orderBy("shard").collect()]
    ends, end = [], 0
    for shard, gap in gaps:
        ends.append((end, end + gap, shard))
        end += gap
    line = rank_within(free.withColumn("all", F.lit(0)), ["all"], [*total_order, F.col("nth")], _slice(buckets * shards, F.col("group")), buckets * shards, "place")
    pick = F.coalesce(*[F.when((F.col("place") >= lo) & (F.col("place") < hi), F.lit(k)) for lo, hi, k in ends])
    both = stage.save(line.select("doc_id", "size", "text_crc32", "group", "nth", pick.cast("int").alias("shard"))
                      .unionByName(seated.where("shard is not null")), "dealt")
    slots = rank_within(both, ["shard"], [*total_order, F.col("nth")], spread, buckets, "slot")
    return slots.select("doc_id", "size", "text_crc32", "group", "shard", "slot")


def op2_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law ``rows``; equal texts share a shard where it has room."""
    out = assign_shards(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
