"""Benchmark decontamination with a distributed positional inverted index.

The index stores one posting (term, row, pos) for every token of the training
texts whose term a benchmark item uses, and one of the end mark for every row, whose
position is the number of words; other postings could not be read by any phrase of
the benchmark.  Postings lie beside the other postings of their document, so
building the index moves no row.  A phrase is looked up from its two rarest terms: in
every document that has them their lists, shifted by the terms' offsets in the phrase,
are intersected (exact matches) and compared within the span of the phrase (proximity
matches); overlapping phrases share their pair of terms and so one intersection.  The few survivors are then compared with the words of their documents.
A document is known by a hash of its id and text, so null and repeated ids do no
harm, and where hashes clash the comparison still decides.  Main path: DataFrame
operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwarden.llm.text import PLAIN, ascii_lower, documents, maybe_broadcast, row_key, unnest, words
from ringwarden.staging import Staging

#: A benchmark with more distinct terms or phrases than this is joined, not broadcast.
BROADCAST_ROWS = 200_000
#: Blocks of positions are so many times as wide as a phrase with its slack, at least 2.
BLOCK = 4
#: Words that may stand between those of a phrase in a proximity match.
SLACK = 5
#: The term that stands behind the last word of every text; no word holds a space.
END = " "


def tokens(text: str = "text") -> Column:
    """The lower-cased words of a text column."""
    return words(ascii_lower(F.col(text)), PLAIN)


def phrases(items: DataFrame, n: int) -> DataFrame:
    """(phrase, terms, items): distinct windows of ``n`` words; a shorter item is one window."""
    split = items.select("item_id", tokens().alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    windows = unnest(split.select("item_id", F.transform(starts, lambda i: F.slice("w", i, n)).alias("p")), "p", "terms", "item_id")
    return (windows.groupBy("terms").agg(F.collect_set("item_id").alias("items"))
            .select(F.xxhash64("terms").alias("phrase"), "terms", "items"))


def build_index(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, row, pos): postings of the texts for the terms of ``wanted`` and the end mark, pos from 0."""
    terms = wanted.select(F.explode("terms").alias("term")).distinct()
    ended = terms.unionByName(docs.sparkSession.createDataFrame([(END,)], "term string"))
    split = docs.select(row_key().alias("row"), F.concat(tokens(), F.array(F.lit(END))).alias("w"))
    posted = split.select("row", F.posexplode_outer("w").alias("pos", "term")).where("term is not null")
    return posted.join(maybe_broadcast(ended, BROADCAST_ROWS), "term").select("term", "row", "pos")


def rarest_pairs(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(phrase, n_terms, a, a_at, b, b_at, pair): the two rarest places of each phrase, ``a`` the rarer one.

    b is null for a phrase of one word.  A phrase with a term that has no posting
    occurs nowhere and is left out.  Of equally rare terms the lesser comes first, so
    that phrases which overlap share their pair.  ``pair`` is a hash of both terms;
    a clash only brings more candidates.
    """
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    spots = wanted.select("phrase", F.posexplode("terms").alias("offset", "term"))
    ranked = (spots.join(counts, "term", "left").groupBy("phrase")
              .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))).alias("s"))
              .where(F.col("s")[0]["n"] > 0))
    rare, next_rare = F.col("s")[0], F.get("s", 1)
    return ranked.select("phrase", F.size("s").alias("n_terms"), rare["term"].alias("a"), rare["offset"].alias("a_at"),
                         next_rare["term"].alias("b"), next_rare["offset"].alias("b_at")).withColumn("pair", F.hash("a", "b"))


def candidates(wanted: DataFrame, index: DataFrame, n: int, slack: int, stage: Staging) -> DataFrame:
    """(row, phrase, starts, near): where the rarest terms of a phrase stand in a document.

    starts: begins at which both are in their places; near: places of the rarest
    one with the other as near as the phrase is long, and ``slack`` words.  Lists
    meet once for each pair of terms, whatever the number of phrases that share it,
    by blocks of positions a few times as wide as that (a place near an edge looks
    into two), so a very long document costs the length of its lists.
    """
    probes = stage.save(rarest_pairs(wanted, index), "probes")
    pairs = probes.where("b is not null").select("a", "b", "pair").distinct()
    reach = n - 1 + slack
    block = lambda pos: F.floor(pos / (BLOCK * (reach + 1))).cast("int")

    def posted(side: str) -> DataFrame:
        own = maybe_broadcast(pairs.select(F.col(side).alias("term"), "pair"), BROADCAST_ROWS)
        return index.join(own, "term").select("row", "pair", "pos")

    around = posted("a").withColumn("block", F.explode(F.sequence(block(F.col("pos") - reach), block(F.col("pos") + reach))))
    other = posted("b").select("row", "pair", F.col("pos").alias("pos_b"), block(F.col("pos")).alias("block"))
    gap = F.col("pos_b") - F.col("pos")
    met = around.join(other, ["row", "pair", "block"]).where(F.abs(gap) <= reach)
    shared = met.join(maybe_broadcast(probes.select("phrase", "n_terms", "a_at", "b_at", "pair"), BROADCAST_ROWS), "pair").where(F.abs(gap) < F.col("n_terms") + slack)
    start = F.col("pos") - F.col("a_at")
    found = shared.select("row", "phrase", "pos", F.when((gap == F.col("b_at") - F.col("a_at")) & (start >= 0), start).alias("start"))
    alone = probes.where("b is null").select("phrase", F.col("a").alias("term"))
    single = index.join(maybe_broadcast(alone, BROADCAST_ROWS), "term").select("row", "phrase", "pos", F.col("pos").alias("start"))
    return found.unionByName(single).groupBy("row", "phrase").agg(F.collect_set("start").alias("starts"), F.collect_set("pos").alias("near"))


def holds_all(span: Column, terms: Column) -> Column:
    """Whether a span of words holds every term as often as the phrase does."""
    often = lambda w, t: F.size(F.filter(w, lambda x: x == t))
    return F.forall(F.array_distinct(terms), lambda t: often(span, t) >= often(terms, t))


def matches(docs: DataFrame, wanted: DataFrame, index: DataFrame, n: int, slack: int, stage: Staging) -> DataFrame:
    """(row, spans, item_ids, near_ids): documents with exact or proximity matches, compared with their words.

    spans lists start, length and phrase of each exact occurrence, item_ids the items
    of these phrases, near_ids those with a phrase whose words all stand within its
    length and ``slack`` words.  Only texts of documents with candidates are read again.
    """
    found = stage.save(candidates(wanted, index, n, slack, stage), "candidates")
    some = maybe_broadcast(found.select("row").distinct(), BROADCAST_ROWS * 5)
    texts = docs.select(row_key().alias("row"), "text").join(some, "row", "left_semi")
    split = stage.save(texts.select("row", tokens().alias("w")), "texts")
    met = found.join(split, "row").join(wanted, "phrase")
    length = F.size("terms")
    exact = F.filter("starts", lambda s: F.slice("w", s + 1, length) == F.col("terms"))
    span = length + slack
    first = lambda p: F.greatest(p - span + 1, F.lit(0))
    close = F.exists("near", lambda p: F.exists(F.sequence(first(p), p), lambda s: holds_all(F.slice("w", s + 1, span), F.col("terms"))))
    told = met.select("row", "phrase", "items", length.alias("length"), exact.alias("exact"), (F.size(exact) > 0).alias("occurs"), close.alias("close"))
    hits = F.transform("exact", lambda s: F.struct(s.alias("start"), F.col("length").alias("length"), F.col("phrase").alias("phrase")))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return told.where("occurs or close").groupBy("row").agg(
        union(hits).alias("spans"), union(F.when(F.col("occurs"), F.col("items"))).alias("item_ids"), union(F.col("items")).alias("near_ids"))


def look_up(docs: DataFrame, items: DataFrame, n: int, slack: int, stage: Staging) -> tuple[DataFrame, DataFrame]:
    """(index, matches) of ``docs(doc_id, text)``, both stored."""
    wanted = stage.save(phrases(items.select("item_id", "text"), n), "phrases")
    index = stage.save(build_index(docs, wanted), "index")
    return index, stage.save(matches(docs, wanted, index, n, slack, stage), "matches")


def uncontaminated(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The rows of ``docs`` with all their columns that hold no window of an item (see ``contamination``)."""
    stage = Staging(docs.sparkSession)
    index, found = look_up(docs.select("doc_id", "text"), items, n, 0, stage)
    stage.drop(index)
    hit = found.where(F.size("spans") > 0).select(F.col("row").alias("_row"))
    return docs.withColumn("_row", row_key()).join(hit, "_row", "left_anti").drop("_row")


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, slack: int = SLACK) -> DataFrame:
    """Which words of which documents lie in windows of benchmark items.

    Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters;
    a window is ``n`` consecutive words of an item, or all words of a shorter one.
    Returns (doc_id, n_words, n_hit, n_items, item_ids, spans, n_near, near_ids,
    contaminated) for every row of ``docs``; item_ids are the items with occurring
    windows, near_ids (n_near of them) those with a window whose words, each as often
    as in it, stand in any order within its length and ``slack`` words; these do not
    make a document contaminated.  Null or empty texts have no words and no hits;
    null or empty items occur nowhere; items that share a text are all reported;
    rows that repeat a doc_id or have none each get the hits of their own text, very
    long texts are matched whole; columns other than doc_id, text and item_id are
    not read; empty tables give no hits.
    """
    stage = Staging(docs.sparkSession)
    read = docs.select("doc_id", "text")
    index, found = look_up(read, items, n, slack, stage)
    lengths = index.where(F.col("term") == END).groupBy("row").agg(F.max("pos").alias("n_words"))
    both = read.select("doc_id", row_key().alias("row")).join(lengths, "row", "left").join(found, "row", "left")
    none = {c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("spans", "item_ids", "near_ids")}
    hit = both.select("doc_id", F.col("n_words").cast("long").alias("n_words"), *none.values())
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    return hit.select("doc_id", "n_words", F.size(places).cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                      "item_ids", "spans", F.size("near_ids").cast("long").alias("n_near"), "near_ids", (F.size("spans") > 0).alias("contaminated"))


def items_digest(ids: Column) -> Column:
    """SHA-256 of the ids sorted as strings and joined by commas."""
    text = F.array_join(F.array_sort(F.transform(ids, lambda i: i.cast("string"))), ",")
    return F.sha2(text, 256)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark contamination of all documents, windows of 10 words; n_near counts items matched by proximity."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return contamination(documents(spark, sf_dir), items).select(
        "doc_id", "n_words", "n_hit", "n_items", items_digest(F.col("item_ids")).alias("items_sha256"), "n_near", "contaminated")


ORACLE_OP1 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM p),
s AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, k WHERE len(w) >= n)),
h AS (SELECT s.doc_id, s.i, s.n, p.item_id FROM s JOIN p USING (g, n)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id),
f AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM d) GROUP BY x),
a AS (SELECT g, t, min_by(x, (n, x)) AS rare FROM (SELECT DISTINCT g, string_split(g, ' ') AS t, unnest(string_split(g, ' ')) AS x FROM p) JOIN f USING (x) GROUP BY g, t),
q AS (SELECT doc_id, w, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
z AS (SELECT q.doc_id, a.g, a.t, q.w, unnest(range(greatest(i - len(a.t) - 4, 1), i + 1)) AS s FROM a JOIN q ON q.x = a.rare),
y AS (SELECT DISTINCT doc_id, g FROM z WHERE len(list_filter(t, lambda e:
        len(list_filter(w[s:s + len(t) + 4], lambda o: o = e)) < len(list_filter(t, lambda o: o = e)))) = 0),
v AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM y JOIN p USING (g) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(v.n_near, 0)::BIGINT AS n_near, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN v USING (doc_id)
"""
