"""Near-duplicate clusters of texts by exact Jaccard similarity of word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwarden.operators.components import connected_components
from ringwarden.staging import Staging

#: Central texts of a list grow by this factor each round.
GROWTH = 4
#: Rows that may go to every task, as numbers.
BROADCAST_ROWS = 1_000_000


def gram_set(w: Column, n: int = 3) -> Column:
    """Distinct hashed n-grams of a column of words; a shorter list is one gram, an empty one has none.

    ``w`` is to be a plain column: an expression would be worked out again for every gram.
    """
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    return (F.when(F.size(w) >= n, F.array_distinct(grams)).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
            .otherwise(F.array().cast("array<bigint>")))


def numbered(rows: DataFrame, *more: str) -> DataFrame:
    """(row, id, t, key, ...) of ``rows(id, key, ...)``: a number of the row and 128 bits of its key.  To be stored, as numbers are by partition."""
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", F.unhex(F.md5("key")).alias("t"), "key", *more)


def key_grams(texts: DataFrame, n: int, *columns: str) -> DataFrame:
    """``columns`` of texts(key) and the n-grams of each."""
    split = texts.select(*columns, F.filter(F.split("key", " "), lambda x: x != "").alias("w"))
    return split.select(*columns, gram_set(F.col("w"), n).alias("grams"))


def with_partners(sets: DataFrame, percent: int, low: Column, high: Column) -> DataFrame:
    """The rows of ``sets(row, grams)`` that may link to another: (row).

    N-grams are ordered by their hash.  A text of s n-grams misses at most m of them in a
    partner, so of the n-grams that two partners share the first k stand among the first
    m + k of each.  k is half of m, plus one; counted by the smallest
    partner possible, a row needs k of its first n-grams in other texts as well, which rows without partner seldom have.  An
    n-gram is in another text if ``low`` < ``high`` among its rows.  Only the first n-grams are shuffled, once.
    """
    def least(size: Column) -> Column:
        return F.ceil(size * percent / 100)

    def k(size: Column) -> Column:
        return F.ceil((size - least(size)) / 2) + 1

    size, same = F.size("grams"), Window.partitionBy("gram")
    first = F.slice(F.array_sort("grams"), F.lit(1), F.least(size - least(size) + k(size), size).cast("int"))
    posts = sets.select(*[c for c in sets.columns if c != "grams"], F.least(k(least(size)), least(size)).alias("need"), F.explode_outer(first).alias("gram")).where("gram is not null")
    shared = posts.select("row", "need", low.over(same).alias("low"), high.over(same).alias("high")).where("low < high")
    return shared.groupBy("row", "need").agg(F.count(F.lit(1)).alias("n")).where("n >= need").select("row")


def few(rows: DataFrame) -> DataFrame:
    """``rows``, a stored table, marked to go to every task if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _open(posts: DataFrame) -> DataFrame:
    """The rows of ``posts`` whose lists hold another cluster and, by their sizes, possibly a partner."""
    lists = posts.groupBy("gram").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.min("size").alias("least"), F.max("most").alias("reach"))
    return posts.join(lists.where("lo < hi"), "gram").where("size <= reach and least <= most").select(*posts.columns)


def near_duplicate_clusters(rows: DataFrame, percent: int = 85, n: int = 3) -> DataFrame:
    """(id, cluster) for ``rows(id, key)``: clusters linked by Jaccard similarity of ``percent`` / 100, named by their least id.

    Equal keys are one text to begin with, and rows that by ``with_partners`` link to no
    other stand alone.  Among the rest, two texts that link
    share one of their rarest n-grams (a prefix by document frequency as long as
    the misses that the similarity allows, plus one).  What a text holds from that
    n-gram on bounds the sizes of its partners there.  The list of an n-gram meets
    its most central texts (with the smallest share of n-grams of their own), fourfold
    each round; clusters grow together in between, texts of one cluster don't meet
    again, and a list of one cluster is closed.  So a group of n near copies costs
    about n pairs; no link between clusters is lost, for a text has met all others of
    a list, or is in their cluster, before the list closes.  Overlaps are counted exactly.
    """
    stage = Staging(rows.sparkSession)
    all_ = stage.save(numbered(rows.where("key is not null")), "texts")
    texts = stage.save(all_.groupBy("t").agg(F.min("id").alias("rep"), F.min("row").alias("row")), "keys")
    h = F.col("h")
    maybe = with_partners(key_grams(all_.withColumn("h", F.xxhash64("t")), n, "row", "h"), percent, F.min(h), F.max(h))
    live = stage.save(texts.select("row", "rep").join(maybe, "row"), "live")
    sets = stage.save(key_grams(all_.select("row", "key").join(few(live), "row"), n, "rep"), "sets")
    size = F.size("grams")
    grams = sets.select("rep", size.alias("size"), F.explode_outer("grams").alias("gram")).where("gram is not null")
    per = stage.save(grams.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("gram"))).where("df > 1").groupBy("rep", "size").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
                     .where(F.size("g") * 100 >= F.col("size") * percent), "repeated")
    stage.drop(sets)
    alone = F.col("size") - F.size("g")
    room = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - alone
    listed = per.select("rep", "size", alone.alias("alone"), F.posexplode_outer(F.slice("g", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))["gram"]).alias("i", "gram"))
    rest = F.col("size") - F.col("alone") - F.col("i")
    posts = stage.save(listed.where("gram is not null").select(
        "gram", "rep", "size", (F.floor(rest * (100 + percent) / percent) - F.col("size")).alias("most"), (F.col("alone") / F.col("size")).alias("own"), F.col("rep").alias("cluster")), "postings")
    whole = per.select("rep", "size", F.transform("g", lambda x: x["gram"]).alias("g"))
    names, pivots = stage.save(per.select("rep", F.col("rep").alias("cluster")), "names"), 1
    while True:
        live = stage.save(_open(posts), "open")
        stage.drop(posts)
        if live.isEmpty():
            break
        central = Window.partitionBy("gram").orderBy("own", "rep")
        pivot = stage.save(live.withColumn("k", F.row_number().over(central)).where(F.col("k") <= pivots)
                           .select("gram", *[F.col(c).alias(f"p_{c}") for c in ("rep", "size", "most", "cluster")]), "pivots")
        met = live.join(pivot, "gram").where("cluster <> p_cluster and size <= p_most and p_size <= most")
        pairs = stage.save(met.select(F.least("rep", "p_rep").alias("a"), F.greatest("rep", "p_rep").alias("b"),
                                      F.least("cluster", "p_cluster").alias("ca"), F.greatest("cluster", "p_cluster").alias("cb")).distinct(), "pairs")
        both = (pairs.join(whole.withColumnsRenamed({"rep": "a", "g": "ga", "size": "sa"}), "a").join(whole.withColumnsRenamed({"rep": "b", "g": "gb", "size": "sb"}), "b")
                .withColumn("n", F.size(F.array_intersect("ga", "gb"))))
        links = stage.save(both.where(F.col("n") * 100 >= percent * (F.col("sa") + F.col("sb") - F.col("n"))).select(F.col("ca").alias("a"), F.col("cb").alias("b")), "links")
        left = live.join(pivot.select("gram", F.col("p_rep").alias("rep")), ["gram", "rep"], "left_anti")
        if not links.isEmpty():
            # Clusters link, not texts: what was contracted before stays so.
            grown = connected_components(links, stage).select(F.col("id").alias("cluster"), "component")
            moved = F.coalesce("component", "cluster").alias("cluster")
            names = stage.save(names.join(grown, "cluster", "left").select("rep", moved), "names")
            left = left.join(grown, "cluster", "left").select("gram", "rep", "size", "most", "own", moved)
        posts = stage.save(left, "postings")
        stage.drop(live, pivot, pairs)
        pivots *= GROWTH
    named = texts.join(names, "rep", "left").select("t", F.coalesce("cluster", "rep").alias("cluster"))
    return all_.select("id", "t").join(named, "t").select("id", "cluster")
