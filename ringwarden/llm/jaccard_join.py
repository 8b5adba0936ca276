"""N-gram Jaccard join by vertical partitioning.

The n-grams of all documents get one global order, rarest first.  Only n-grams
that occur in two different word sequences can add to an overlap, so only those are
kept, and only sequences in which they make up the wanted share.  The order is cut
into fragments, and each document into segments along with it.  Two documents that
share an n-gram of both prefixes are a candidate pair; each fragment counts the
pair's partial overlap on its own segments, and the partial counts are summed per pair.

Documents with the same word sequence form a class, of which one row takes part.
What is asked for is who reaches whom, so pairs whose ends are already known to be
in one group need no count.  In every round each list of documents that share a
prefix n-gram is tried against its pivots, the documents with the smallest share of
n-grams of their own, which are the middle of a group of near copies.  Then the
groups grow together, documents that could link to no other group of their list go,
and the number of pivots a list grows fourfold, until no list is left.  So a list
of thousands of near copies costs about its length, no link between different
groups is lost, and a list is done in logarithmically many rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringwarden.llm.text import ascii_lower, documents, row_key, unnest, words
from ringwarden.operators.components import connected_components
from ringwarden.staging import Staging

#: Of the n-grams in the first part of the hash space so large a share must be repeated in a document that is counted in full.
REPEATED = 0.4
#: Pivots of a list grow by this factor from round to round.
GROWTH = 4


def shingle_hashes(tokens: Column, n: int) -> Column:
    """Distinct 64-bit hashes of the n-grams of an array of words ([] if it has fewer)."""
    gram = lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)])
    grams = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), gram)
    return F.when(F.size(tokens) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<bigint>"))


def needed(size: Column, percent: int) -> Column:
    """The least overlap of a set of ``size`` with any set that it may link to."""
    return F.ceil(size * percent / 100)


def keyed_documents(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, row, key, n_words, n_shingles, first_grams).

    row: a hash of id and text.  key: 128 bits of the lower-cased word sequence.
    first_grams: the part of the set in the lowest part of the hash space, the
    larger the less similar sets may be.
    """
    first = min(0.9, (1 - percent / 100) / (1 - REPEATED))
    split = docs.select("doc_id", row_key().alias("row"), words(ascii_lower(F.col("text"))).alias("w"))
    cut = split.select("doc_id", "row", F.when(F.size("w") > 0, F.md5(F.array_join("w", " "))).alias("key"), F.size("w").alias("n_words"), shingle_hashes(F.col("w"), n).alias("grams"))
    size = F.size("grams")
    return cut.select("doc_id", "row", "key", "n_words", F.when(F.col("n_words") >= n, size).otherwise(F.least("n_words", F.lit(1))).alias("n_shingles"),
                      F.filter("grams", lambda g: g < F.lit(int(first * 2 ** 64) - 2 ** 63)).alias("first_grams"))


def sequence_classes(table: DataFrame) -> DataFrame:
    """(unit, key, lead, n_words, size, first_grams): a row for each word sequence, numbered.

    lead names its first row: (no id, doc_id, row), the least one.  The number holds
    once the result is written.
    """
    lead = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    one = table.where("key is not null").groupBy("key").agg(
        F.min(lead).alias("lead"), F.first("n_words").alias("n_words"), F.first("n_shingles").alias("size"), F.first("first_grams").alias("first_grams"))
    return one.withColumn("unit", F.monotonically_increasing_id())


def counted(rows: DataFrame) -> DataFrame:
    """``rows(doc, gram)`` of the grams that occur in several documents, with their count df.

    Both branches want the same columns, so one exchange by gram serves both.
    """
    dealt = rows.where("doc is not null").repartition("gram")
    counts = dealt.groupBy("gram").agg(F.count(F.lit(1)).cast("int").alias("df"), F.min("doc").alias("least"), F.max("doc").alias("most"))
    counts = counts.where("least <> most").select("gram", "df")
    return dealt.join(counts.hint("shuffle_hash"), "gram")


def profiles(docs: DataFrame, classes: DataFrame, n: int, percent: int, stage: Staging) -> DataFrame:
    """(doc, size, grams): classes that may link, with their repeated n-grams in the global order; doc is the unit.

    A set that links misses at most ``size - needed`` of its grams in its partner,
    so of any part of it all but that many are repeated.  The first part of the
    hash space tells so for most documents; only those that pass are counted in full.
    """
    able = classes.where(F.col("n_words") >= n)
    first = able.select(F.col("unit").alias("doc"), "first_grams")
    repeated = counted(unnest(first, "first_grams", "gram", "doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("rep"))
    spare = F.col("size") - needed(F.col("size"), percent)
    wanted = stage.save(
        able.select(F.col("unit").alias("doc"), "lead.doc_id", "lead.row", "size", F.size("first_grams").alias("n_first")).join(repeated, "doc", "left")
        .where(F.coalesce("rep", F.lit(0)) >= F.col("n_first") - spare).select("doc", "doc_id", "row", "size"), "wanted")
    # The rows grow with the corpus, so they are merged and never broadcast.
    own = wanted.select("doc", F.col("doc_id").alias("own_id"), F.col("row").alias("own_row")).hint("merge")
    texts = docs.select("doc_id", "text", row_key().alias("row")).join(own, F.col("row").eqNullSafe(F.col("own_row")) & F.col("doc_id").eqNullSafe(F.col("own_id")))
    split = texts.select("doc", words(ascii_lower(F.col("text"))).alias("w"))
    rows = unnest(split.select("doc", shingle_hashes(F.col("w"), n).alias("grams")), "grams", "gram", "doc")
    per_doc = counted(rows).groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("df", "gram"))).alias("grams"))
    return per_doc.join(wanted.select("doc", "size"), "doc").where(F.size("grams") >= needed(F.col("size"), percent))


def segments(profile: DataFrame, n: int) -> DataFrame:
    """(doc, fragment, grams): each document cut at ``n - 1`` points of the global n-gram order."""
    place = lambda x: x["df"] + (x["gram"] / F.lit(2.0 ** 64) + 0.5)
    cuts = profile.select(F.explode(F.transform("grams", place)).alias("place")).approxQuantile("place", [k / n for k in range(1, n)], 0.01)
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]

    def part(k: int) -> Column:
        inside = F.filter("grams", lambda x: (place(x) >= edges[k]) & (place(x) < edges[k + 1]))
        return F.transform(inside, lambda x: x["gram"])

    return (profile.select("doc", F.posexplode(F.array(*[part(k) for k in range(len(edges) - 1)])).alias("fragment", "grams"))
            .where(F.size("grams") > 0))


def overlaps(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """(a, b, overlap) of candidate pairs: every fragment counts its own segments, the partial counts are summed per pair."""
    left = cut.select(F.col("doc").alias("a"), "fragment", F.col("grams").alias("left"))
    right = cut.select(F.col("doc").alias("b"), "fragment", F.col("grams").alias("right"))
    met = pairs.join(left, "a").join(right, ["b", "fragment"])
    partial = met.select("a", "b", F.size(F.array_intersect("left", "right")).alias("partial"))
    return partial.groupBy("a", "b").agg(F.sum("partial").alias("overlap"))


def prefix_postings(profile: DataFrame, percent: int) -> DataFrame:
    """(gram, doc, size, most, own, comp): the prefix n-grams of each document.

    most: the largest partner that the list of the gram could still join it to (a
    common gram has at most ``rest`` grams from it on, and all common ones of a pair
    must be among those of the first).  own: the share of grams of no other document.
    """
    alone = F.col("size") - F.size("grams")  # grams of no other document stand before all others
    room = F.col("size") - needed(F.col("size"), percent) + 1 - alone
    prefix = F.slice("grams", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))
    rest = F.col("size") - F.col("alone") - F.col("i")
    return (profile.select("doc", "size", alone.alias("alone"), F.posexplode(prefix).alias("i", "g"))
            .select(F.col("g.gram").alias("gram"), "doc", "size", (F.floor(rest * (100 + percent) / percent) - F.col("size")).alias("most"),
                    (F.col("alone") / F.col("size")).alias("own"), F.col("doc").alias("comp")))


def open_postings(posts: DataFrame) -> DataFrame:
    """The rows of ``posts`` that could link to another group of their list.

    Per list only the two best groups matter: a document's best partner is in the
    best group, or in the second where the best one is its own.
    """
    groups = posts.groupBy("gram", "comp").agg(F.min("size").alias("size"), F.max("most").alias("most"))

    def best(value: str, ascending: bool) -> DataFrame:
        order = Window.partitionBy("gram").orderBy(F.col(value).asc() if ascending else F.col(value).desc(), "comp")
        two = groups.select("gram", "comp", value, F.row_number().over(order).alias("k")).where("k <= 2")
        pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
        return two.groupBy("gram").agg(pick(1, "comp").alias(f"{value}_of"), pick(1, value).alias(f"{value}_1"), pick(2, value).alias(f"{value}_2"))

    def other(value: str) -> Column:
        return F.when(F.col("comp") == F.col(f"{value}_of"), F.col(f"{value}_2")).otherwise(F.col(f"{value}_1"))

    bounds = best("size", True).join(best("most", False), "gram").where("size_2 is not null")
    return posts.join(bounds, "gram").where((other("size") <= F.col("most")) & (other("most") >= F.col("size"))).select(*posts.columns)


def similar_groups(profile: DataFrame, cut: DataFrame, percent: int, stage: Staging) -> DataFrame | None:
    """(id, component) over documents that link to another one; None if none does."""
    posts = stage.save(prefix_postings(profile, percent), "postings")
    sizes = profile.select("doc", "size")
    links, groups, pivots = None, None, 1
    while True:
        live = stage.save(open_postings(posts), "open")
        stage.drop(posts)
        if live.isEmpty():
            return groups
        central = Window.partitionBy("gram").orderBy("own", "doc")
        pivot = stage.save(live.withColumn("k", F.row_number().over(central)).where(F.col("k") <= pivots)
                           .select("gram", *[F.col(c).alias(f"p_{c}") for c in ("doc", "size", "most", "comp")]), "pivots")
        met = live.join(pivot, "gram").where("comp <> p_comp and size <= p_most and p_size <= most")
        pairs = stage.save(met.select(F.least("doc", "p_doc").alias("a"), F.greatest("doc", "p_doc").alias("b")).distinct(), "pairs")
        a, b = sizes.select(F.col("doc").alias("a"), F.col("size").alias("sa")), sizes.select(F.col("doc").alias("b"), F.col("size").alias("sb"))
        found = stage.save(overlaps(pairs, cut).join(a, "a").join(b, "b")
                           .where(F.col("overlap") * 100 >= percent * (F.col("sa") + F.col("sb") - F.col("overlap"))).select("a", "b"), "links")
        left = live.join(pivot.select("gram", F.col("p_doc").alias("doc")), ["gram", "doc"], "left_anti")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            groups = connected_components(links, stage)
            now = groups.select(F.col("id").alias("doc"), F.col("component").alias("c"))
            left = left.join(now, "doc", "left").withColumn("comp", F.coalesce("c", "comp")).drop("c")
        posts = stage.save(left, "postings")
        stage.drop(live, pivot, pairs)
        pivots *= GROWTH


def jaccard_groups(docs: DataFrame, n: int, percent: int, n_fragments: int, stage: Staging) -> DataFrame:
    """(doc_id, row, n_shingles, lead): for every row of ``docs`` the first row (no_id, doc_id, row) of its group."""
    read = docs.select("doc_id", "text")
    table = stage.save(keyed_documents(read, n, percent), "keys")
    classes = stage.save(sequence_classes(table), "classes")
    profile = stage.save(profiles(read, classes, n, percent, stage), "profiles")
    cut = stage.save(segments(profile, n_fragments), "segments")
    groups = similar_groups(profile, cut, percent, stage)
    leads = classes.select("unit", "key", "lead")
    if groups is not None:
        named = leads.join(groups.withColumnRenamed("id", "unit"), "unit", "left").withColumn("component", F.coalesce("component", "unit"))
        first = named.groupBy("component").agg(F.min("lead").alias("first"))
        leads = named.join(first, "component").select("key", "lead", "first")
    else:
        leads = leads.select("key", "lead", F.col("lead").alias("first"))
    alone = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    return table.select("doc_id", "row", "key", "n_shingles").join(leads, "key", "left").select(
        "doc_id", "row", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("lead", alone).alias("class_lead"), F.coalesce("first", alone).alias("lead"))


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, n_fragments: int = 4) -> DataFrame:
    """Group documents whose n-gram sets reach a Jaccard similarity of ``percent`` / 100.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the
    distinct n-grams of the whole text, or the whole sequence if there are fewer
    words.  N-grams are compared by 64-bit hashes, whole sequences by 128 bits.
    Returns ``(doc_id, n_shingles, class_id, component_id)`` for every row: class_id
    is the smallest doc_id with the same word sequence, component_id the smallest
    that links reach (null only where no row of the group has an id).  Null or empty
    texts have no set and stand alone.  Rows with null or repeated ids take part
    with their own texts; ties are by id.  Very long texts are one set like others.
    Other columns of ``docs`` are not read; an empty table gives an empty result.
    """
    out = jaccard_groups(docs, n, percent, n_fragments, Staging(docs.sparkSession))
    return out.select("doc_id", "n_shingles", F.col("class_lead.doc_id").alias("class_id"), F.col("lead.doc_id").alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, percent: int = 80, n_fragments: int = 4) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each group of ``jaccard_components``.

    The row with the least doc_id stays (rows without id come last; of equal ids
    the one with the least hash of its text); of wholly repeated rows one stays.
    Rows without words, each a group of its own, all stay unless they are repeated.
    """
    stage = Staging(docs.sparkSession)
    out = jaccard_groups(docs, n, percent, n_fragments, stage)
    first = stage.save(out.where(F.col("row") == F.col("lead.row")).select(F.col("row").alias("_row")).distinct(), "first")
    return docs.withColumn("_row", row_key()).join(first.hint("merge"), "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents (word 4-grams, similarity 0.85)."""
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLE_OP7 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM t WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT s.doc_id, s.g FROM s JOIN k USING (g)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc_id, r) AS (
  SELECT a, a FROM e
  UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.doc_id WHERE c.r < e.b),
m AS (SELECT doc_id, min(r) AS r FROM c GROUP BY doc_id)
SELECT t.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(least(m.r, t.doc_id), t.doc_id) AS component_id
FROM t LEFT JOIN z USING (doc_id) LEFT JOIN m USING (doc_id)
"""
