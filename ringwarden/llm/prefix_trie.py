"""The trie of conversation prefixes by whole-sequence collapse.

Conversations that are rebuilt to the same turns become one weighted sequence
with a list of those that end there.  Sequences that are proper prefixes of others
are dropped by an anti-join; what is left are the leaves.  All counts of a node
are sums over the weighted prefixes of the sequences or of the leaves through it,
so the number of shuffles does not depend on the depth of the trie.

A prefix is known by its depth and 128 bits: the exclusive or of two hashes of
each turn and its place.  So the key of a node's parent is the node's own key
less its last turn, and running keys can be taken in slices of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringwarden.operators.ranking import rank_within
from ringwarden.staging import Staging

#: Turns of a conversation that one slice of a running value holds.
SLICE = 4096
#: Ids in one packed piece of a list of ends.
PIECE = 50_000
KEY = ["depth", "p1", "p2"]
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 6).cast("int")


def running(df: DataFrame, key: str, at: str, values: dict[str, str], agg: Callable[[str], Column], backwards: bool = False) -> DataFrame:
    """``df`` with running values of each key in order of ``at``, in slices that are offset by those before them.

    ``values`` maps new columns to old ones, ``agg`` is the aggregate.  ``df`` is read twice.
    """
    cut = df.withColumn("_slice", F.floor(F.col(at) / SLICE))
    order = lambda c: F.col(c).desc() if backwards else F.col(c)
    inside = Window.partitionBy(key, "_slice").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(order("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(key, "_slice").agg(*[agg(old).alias(f"_{new}") for new, old in values.items()])
    offsets = totals.select(key, "_slice", *[agg(f"_{new}").over(before).alias(f"_{new}") for new in values]).where(F.col(f"_{next(iter(values))}").isNotNull())
    run = cut.withColumns({new: agg(old).over(inside) for new, old in values.items()}).join(offsets, [key, "_slice"], "left")
    both = {new: F.when(F.col(f"_{new}").isNull(), F.col(new)).otherwise(_plus(agg, new)) for new in values}
    return run.withColumns(both).drop("_slice", *[f"_{new}" for new in values])


def _plus(agg: Callable[[str], Column], name: str) -> Column:
    a, b = F.col(name), F.col(f"_{name}")
    return a.bitwiseXOR(b) if agg is F.bit_xor else a + b


def rebuilt_turns(conversations: DataFrame, stage: Staging) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, t1, t2, chars): the turns of every rebuilt conversation; and (conv_id): all conversations."""
    said = [F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")]
    turns = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.xxhash64(F.lit(1), *said).alias("k1"), F.xxhash64(F.lit("2"), *reversed(said)).alias("k2"),
        F.length(said[1]).cast("long").alias("chars"))
    order = [F.col("turn").asc_nulls_first(), F.col("k1"), F.col("k2")]
    dealt = stage.save(turns.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()), "turns")
    ranked = stage.save(rank_within(dealt, ["conv_id"], order, F.col("part"), 0, "at").select("conv_id", (F.col("at") + 1).alias("at"), "k1", "k2", "chars"), "ranked")

    h = shared_turns(F.col("conv_id"))
    sizes = ranked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = (F.col("conv_id") - F.col("conv_id") % 100).alias("base")
    have = sizes.select(F.col("conv_id").alias("base"), F.least("n", F.lit(5)).alias("most"))
    convs = stage.save(sizes.select("conv_id", base, h.alias("h")).join(have, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("most", F.lit(0))).cast("long").alias("got")), "convs")
    own = ranked.join(convs, "conv_id").where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("got")).alias("depth"), "k1", "k2", "chars")
    heads = ranked.where("at <= 5").withColumnRenamed("conv_id", "base")
    first = heads.join(convs, "base").where("at <= h").select("conv_id", F.col("at").alias("depth"), "k1", "k2", "chars")
    placed = own.unionByName(first).select("conv_id", "depth", F.xxhash64("depth", "k1", "k2").alias("t1"), F.xxhash64("k2", "k1", "depth").alias("t2"), "chars")
    return stage.save(placed, "rebuilt"), convs.select("conv_id")


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, first, ids): sorted ids written as text, a piece for each stretch of a key."""
    for frame in frames:
        keys, ids = list(zip(*[frame[c].tolist() for c in KEY])), frame["conv_id"].tolist()
        cuts = [i for i in range(len(ids)) if not i or keys[i] != keys[i - 1]] + [len(ids)]
        out = [(*keys[i], ids[i], ",".join(map(str, ids[i:min(i + PIECE, end)]))) for begin, end in zip(cuts, cuts[1:]) for i in range(begin, end, PIECE)]
        yield pd.DataFrame(out, columns=[*KEY, "first", "ids"])


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, sha): pieces in order, hashed as they come; no list is held."""
    open_key, sha = None, None
    for frame in frames:
        out = []
        for key, ids in zip(zip(*[frame[c].tolist() for c in KEY]), frame["ids"]):
            if key == open_key:
                sha.update(b"," + ids.encode())
                continue
            if open_key is not None:
                out.append((*open_key, sha.hexdigest()))
            open_key, sha = key, hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=[*KEY, "sha"])
    if open_key is not None:
        yield pd.DataFrame([(*open_key, sha.hexdigest())], columns=[*KEY, "sha"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, sha) of the ids (key, conv_id) of each key, ascending and joined by commas.

    Ids are sorted and packed in ranges of (key, id), so a key that holds most rows
    is shared by many tasks; only its packed pieces meet in one, as a stream.
    """
    types = "depth long, p1 long, p2 long"
    order = [*KEY, "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_pack, f"{types}, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInPandas(_digest, f"{types}, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations of (conv_id, turn, role, text).

    Returns COLUMNS, as the registered query names them, and ``leaf``.  A null role or
    text counts as empty; null turns come first; equal turns of a conversation are
    ordered by a hash of role and text, and repeated rows are turns of their own.
    Rows without a conv_id belong to no conversation and are left out.  Very long
    texts are hashed once and not carried on; a conversation of any length is
    handled in slices.  An empty table has no conversation and so no node; other
    columns are not read.  Prefixes are equal when depth and 128 bits are.
    """
    stage = Staging(conversations.sparkSession)
    turns, convs = rebuilt_turns(conversations, stage)
    prefixes = running(turns, "conv_id", "depth", {"p1": "t1", "p2": "t2"}, F.bit_xor).select(
        "conv_id", *KEY, F.col("p1").bitwiseXOR(F.col("t1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("t2")).alias("q2"), "chars")

    zero = F.lit(0).cast("long")
    last = turns.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.bit_xor("t1").alias("p1"), F.bit_xor("t2").alias("p2"))
    ends = stage.save(convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in KEY]), "ends")
    sequences = stage.save(ends.groupBy(*KEY).agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("weight")), "sequences")
    paths = stage.save(prefixes.join(sequences.select(F.col("seq").alias("conv_id"), "weight"), "conv_id").withColumnRenamed("conv_id", "seq"), "paths")
    below = stage.save(paths.groupBy(*KEY).agg(F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min("chars").alias("chars"),
                                               F.min("q1").alias("q1"), F.min("q2").alias("q2")), "nodes")
    worth = (F.col("n_convs") - 1) * F.col("chars")
    children = stage.save(below.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children")), "children")

    leaves = stage.save(sequences.join(children, KEY, "left_anti").select("seq"), "leaves")
    tips = stage.save(paths.join(leaves, "seq", "left_semi").select("seq", *KEY), "leaf-paths")
    through = stage.save(tips.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_leaves"), F.min("seq").alias("owner"))
                         .join(below.select(*KEY, worth.alias("worth")), KEY), "through")
    # Each node is counted on the path of its first leaf only; there it is one of the path's last nodes.
    owned = stage.save(tips.join(through.select(*KEY, "owner", "worth"), KEY).select(
        "seq", *KEY, F.when(F.col("seq") == F.col("owner"), F.col("worth")).otherwise(0).alias("worth")), "owned")
    saved = running(owned, "seq", "depth", {"saved": "worth"}, F.sum, backwards=True).groupBy(*KEY).agg(F.sum("saved").alias("saved_tokens"))

    least, n_convs = ends.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    n_leaves, all_saved = leaves.count(), below.agg(F.sum(worth)).first()[0]
    number = lambda x: F.lit(x).cast("long")
    root = stage.spark.range(1 if n_convs else 0).select(
        *[zero.alias(c) for c in KEY], number(least).alias("conv_id"), number(None).alias("parent_conv_id"), number(n_convs).alias("n_convs"),
        number(n_leaves).alias("n_leaves"), number(all_saved or 0).alias("saved_tokens"))
    first = below.where("depth = 1").withColumn("parent_conv_id", number(least))
    upper = below.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    deeper = below.where("depth > 1").join(upper, ["depth", "q1", "q2"])
    counts = through.select(*KEY, "n_leaves").join(saved, KEY)
    cells = [*KEY, "conv_id", "parent_conv_id", "n_convs"]
    inner = first.select(*cells).unionByName(deeper.select(*cells)).join(counts, KEY)
    return (inner.unionByName(root).join(children, KEY, "left").join(end_digests(ends), KEY, "left")
            .withColumn("n_children", F.coalesce("n_children", zero)).withColumn("leaf", F.col("n_children") == 0)
            .withColumn("ends_sha256", F.coalesce("sha", F.sha2(F.lit(""), 256))).select(*COLUMNS, "leaf"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")).select(*COLUMNS)


ORACLE_OP13 = r"""
WITH bits AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
ids AS (SELECT conv_id, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 6)::INT AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), bits),
own AS (SELECT conv_id, list(struct_pack(k := md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))), n := length(coalesce(text, ''))::BIGINT) ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS (SELECT i.conv_id, coalesce(b.t[1:i.h], []) || o.t[i.h + 1:] AS t FROM ids i JOIN own o USING (conv_id) LEFT JOIN own b ON b.conv_id = i.conv_id - i.conv_id % 100),
pre AS (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS depth FROM built),
keyed AS (SELECT conv_id, depth, array_to_string(list_transform(t[1:depth], lambda x: x.k), '') AS key, coalesce(t[depth].n, 0) AS n, len(t) = depth AS ends FROM pre),
node AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(CASE WHEN depth = 0 THEN 0 ELSE n END) AS n,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM keyed GROUP BY depth, key),
kids AS (SELECT depth - 1 AS depth, left(key, 32 * (depth - 1)::INT) AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1, 2),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (depth, key)),
up AS (SELECT a AS depth, left(key, 32 * a::INT) AS key, sum((n_convs - 1) * n)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM full_) GROUP BY 1, 2)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, up.n_leaves, up.saved_tokens, f.ends_sha256
FROM full_ f JOIN up USING (depth, key) LEFT JOIN node p ON p.depth = f.depth - 1 AND p.key = left(f.key, 32 * (f.depth - 1)::INT) AND f.depth > 0
"""
