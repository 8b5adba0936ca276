"""Queries on text corpora: audit, duplicates, splits, scoring, metrics, live turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringwarden.functions.risk import call_probability, risk, suspicious, token_windows
from ringwarden.functions.scalar import clean_text, duplicate_key, personal_data, tidy_dots, transcript_style
from ringwarden.operators.metrics import confusion, length_summary, mean_word_error, word_error_rate
from ringwarden.operators.near_duplicates import near_duplicate_clusters
from ringwarden.session import read_table
from ringwarden.staging import Staging

QUERIES, ORACLES = {}, {}

PRELUDE = r"""
WITH RECURSIVE corpus AS (SELECT d.doc_id AS id, d.text, d.lang, d.source, l.toxic AS label, l.quality,
  trim(regexp_replace(lower(d.text), '[^\p{L}\p{N}_]+', ' ', 'g')) AS key FROM documents d LEFT JOIN labels l USING (doc_id))
"""


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL of the same rows."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = PRELUDE + sql
        return f

    return add


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, lang, source, label, quality, key): documents with their labels and duplicate key."""
    d, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return (d.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), "text", "lang", "source", F.col("toxic").alias("label"), "quality",
                                                    duplicate_key(F.col("text")).alias("key")))


@query(r"""SELECT id, key, trim(regexp_replace(regexp_replace(text, chr(65279), '', 'g'), '\s+', ' ', 'g')) AS clean,
trim(regexp_replace(lower(regexp_replace(text, '[.,!?;:…]', '', 'g')), '\s+', ' ', 'g')) AS spoken FROM corpus""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate key, cleaned and transcript-like forms of the texts."""
    t = F.col("text")
    return corpus(spark, sf_dir).select("id", "key", clean_text(t).alias("clean"), transcript_style(t).alias("spoken"))


@query(r"""SELECT source, count(*) AS rows, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS missing, count(*) FILTER (WHERE label IS NULL) AS unlabelled,
count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS email,
count(*) FILTER (WHERE regexp_matches(text, '(https?://|www\.)[^\s]+', 'i')) AS url, count(*) FILTER (WHERE regexp_matches(text, '[0-9]{9,}')) AS long_number,
count(*) FILTER (WHERE regexp_matches(text, '(^|[^0-9])(\+?84|0)[0-9]{9}($|[^0-9])')) AS phone, sum(CASE WHEN key = '' THEN 0 ELSE len(string_split(key, ' ')) END)::BIGINT AS words FROM corpus GROUP BY source""")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing texts and labels, personal data and words by source, in one pass."""
    t = F.col("text")
    flags = dict(zip(("email", "url", "long_number", "phone"), personal_data(t)))
    return corpus(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(t.isNull() | (F.trim(t) == "")).alias("missing"), F.count_if(F.col("label").isNull()).alias("unlabelled"),
        *[F.count_if(c).alias(k) for k, c in flags.items()], F.sum(F.when(F.col("key") == "", 0).otherwise(F.size(F.split("key", " ")))).cast("long").alias("words"))


DEDUP = """, kept AS (SELECT key, min(id) AS id, max(label) AS label, count(*) AS copies, bool_or(source = 'src3') AS tuned FROM corpus WHERE key <> ''
GROUP BY key HAVING count(DISTINCT label) <= 1)
"""


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each key, the first; a key with conflicting labels goes whole; tuned if any copy is."""
    return (corpus(spark, sf_dir).where("key <> ''").groupBy("key")
            .agg(F.min("id").alias("id"), F.max("label").alias("label"), F.count(F.lit(1)).alias("copies"), F.bool_or(F.col("source") == "src3").alias("tuned"),
                 F.min("label").alias("_low"))
            .where("_low is null or _low = label").drop("_low"))


@query(DEDUP + "SELECT id, label, copies, tuned FROM kept")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates removed."""
    return deduplicated(spark, sf_dir).select("id", "label", "copies", "tuned")


NEAR = r""", k AS (SELECT id, key, string_split(key, ' ') AS w FROM corpus WHERE key <> ''),
g AS (SELECT DISTINCT id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM k)),
z AS (SELECT id, count(*) AS n FROM g GROUP BY id),
rare AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
r AS (SELECT g.id, g.s FROM g JOIN rare USING (s)),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM r a JOIN r b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
e0 AS (SELECT a, b FROM o JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
walk(id, r) AS (SELECT a, a FROM e UNION SELECT e.b, w.r FROM walk w JOIN e ON e.a = w.id WHERE w.r < e.b),
clusters AS (SELECT c.id, coalesce(least(min(w.r), c.id), c.id) AS cluster FROM corpus c LEFT JOIN walk w ON w.id = c.id GROUP BY c.id)
"""


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, key): documents with their duplicate key."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), duplicate_key(F.col("text")).alias("key"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cluster) of all documents; texts without a word stand alone."""
    rows = keys(spark, sf_dir).select("id", F.when(F.coalesce("key", F.lit("")) == "", F.concat(F.lit(" "), F.col("id").cast("string"))).otherwise(F.col("key")).alias("key"))
    return near_duplicate_clusters(rows)


@query(NEAR + "SELECT id, cluster FROM clusters")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of documents whose word 3-gram sets reach a Jaccard similarity of 0.85."""
    return clusters(spark, sf_dir)


@query(r"""SELECT id, least(len(w), 64) AS first_words, greatest(0, CAST(ceil((len(w) - 64) / 48.0) AS INTEGER)) + 1 AS windows,
len(w) - 48 * greatest(0, CAST(ceil((len(w) - 64) / 48.0) AS INTEGER)) AS last_words FROM (SELECT id, CASE WHEN key = '' THEN [] ELSE string_split(key, ' ') END AS w FROM corpus)""")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token windows of the texts: 64 words every 48."""
    w = F.when(F.col("key") == "", F.array().cast("array<string>")).otherwise(F.split("key", " "))
    cut = corpus(spark, sf_dir).select("id", token_windows(w, 64, 48).alias("x"))
    return cut.select("id", F.size(F.get("x", 0)).alias("first_words"), F.size("x").alias("windows"), F.size(F.element_at("x", -1)).alias("last_words"))


SCORED = """, scored AS (SELECT l_orderkey AS call_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supplier_id, round(l_discount * 10, 4) AS p, CAST(l_quantity AS INTEGER) * 2 AS words,
  list_filter([CASE WHEN l_returnflag = 'R' THEN 'OTP_REQUEST' END, CASE WHEN l_returnflag = 'A' THEN 'URGENCY' END, CASE WHEN l_linestatus = 'F' THEN 'BANK_IMPERSONATION' END], lambda x: x IS NOT NULL) AS codes,
  list_filter([CASE WHEN l_returnflag = 'R' THEN 'HIGH' END, CASE WHEN l_returnflag = 'A' THEN 'LOW' END, CASE WHEN l_linestatus = 'F' THEN 'MEDIUM' END], lambda x: x IS NOT NULL) AS severities FROM lineitem),
points AS (SELECT *, least(35, (CASE WHEN list_contains(severities, 'LOW') THEN 3 ELSE 0 END) + (CASE WHEN list_contains(severities, 'MEDIUM') THEN 8 ELSE 0 END) + (CASE WHEN list_contains(severities, 'HIGH') THEN 15 ELSE 0 END)
  + CASE WHEN list_contains(codes, 'BANK_IMPERSONATION') AND list_contains(codes, 'OTP_REQUEST') THEN 25 ELSE 0 END) +
  CASE WHEN list_contains(severities, 'HIGH') THEN 20 WHEN list_contains(severities, 'MEDIUM') THEN 8 WHEN list_contains(severities, 'LOW') THEN 3 ELSE 0 END AS evidence FROM scored),
risk AS (SELECT *, CAST(round_even(least(100.0, 70.0 * p + evidence), 0) AS INTEGER) AS full_score FROM points),
capped AS (SELECT *, words < 45 AND full_score >= 60 AND evidence < 17 AS capped FROM risk),
result AS (SELECT *, CASE WHEN capped THEN 59 ELSE full_score END AS score FROM capped)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, line, part_id, supplier_id, p, words, codes, severities): model outputs and indicators derived from line items."""
    li = read_table(spark, sf_dir, "lineitem")
    some = lambda *c: F.array_compact(F.array(*c))
    r, a, f = F.col("l_returnflag") == "R", F.col("l_returnflag") == "A", F.col("l_linestatus") == "F"
    return li.select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id"),
                     F.round(F.col("l_discount") * 10, 4).alias("p"), (F.col("l_quantity").cast("int") * 2).alias("words"),
                     some(F.when(r, "OTP_REQUEST"), F.when(a, "URGENCY"), F.when(f, "BANK_IMPERSONATION")).alias("codes"),
                     some(F.when(r, "HIGH"), F.when(a, "LOW"), F.when(f, "MEDIUM")).alias("severities"))


@query(SCORED + """SELECT call_id, line, part_id, supplier_id, score, CASE WHEN score >= 60 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS level, capped,
list_contains(severities, 'HIGH') OR (len(severities) >= 2 AND len(list_filter(severities, lambda s: s <> 'LOW')) > 0) AS flagged FROM result""")
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk score, level, short-text cap and the rules' own flag of every scored row."""
    s = scored(spark, sf_dir).withColumn("r", risk(F.col("codes"), F.col("severities"), F.col("p"), F.col("words")))
    return s.select("call_id", "line", "part_id", "supplier_id", "r.score", "r.level", "r.capped", suspicious(F.col("severities")).alias("flagged"))


@query(SCORED + """SELECT call_id, round(CASE WHEN len(t) = 1 THEN t[1] ELSE (t[1] + t[2]) / 2 END, 6) AS top2, t[1] AS most, round(list_avg(t), 6) AS mean
FROM (SELECT call_id, list_reverse_sort(list(p)) AS t FROM scored GROUP BY call_id)""")
def chunk_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call's probability from those of its chunks, three ways."""
    c = scored(spark, sf_dir).groupBy("call_id").agg(F.collect_list("p").alias("t"))
    return c.select("call_id", F.round(call_probability(F.col("t")), 6).alias("top2"), call_probability(F.col("t"), "max").alias("most"), F.round(call_probability(F.col("t"), "mean"), 6).alias("mean"))


@query("""SELECT lang, source, tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy,
CASE WHEN tp + fn > 0 THEN round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) END AS precision_1, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS recall_1,
round(f1, 4) AS f1_1, round(f0, 4) AS f1_0, round((f1 + f0) / 2, 4) AS macro_f1 FROM (
SELECT *, CASE WHEN tp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1, CASE WHEN tn + fp > 0 THEN 2 * tn / (2 * tn + fp + fn) END AS f0 FROM (
SELECT lang, source, count(*) FILTER (WHERE label = 0 AND predicted = 0) AS tn, count(*) FILTER (WHERE label = 0 AND predicted = 1) AS fp,
count(*) FILTER (WHERE label = 1 AND predicted = 0) AS fn, count(*) FILTER (WHERE label = 1 AND predicted = 1) AS tp
FROM (SELECT *, CASE WHEN regexp_matches(text, '(?i)idiot|stupid|trash|scum') THEN 1 ELSE 0 END AS predicted FROM corpus WHERE label IS NOT NULL) GROUP BY GROUPING SETS ((), (lang), (source))))""")
def metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and rates of a word-list classifier, overall, by language and by source."""
    rows = corpus(spark, sf_dir).where("label is not null").withColumn("predicted", F.when(F.col("text").rlike("(?i)idiot|stupid|trash|scum"), 1).otherwise(0))
    return confusion(rows, ["lang", "source"])


@query(r""", n AS (SELECT lang, CASE WHEN key = '' THEN 0 ELSE len(string_split(key, ' ')) END AS words FROM corpus WHERE key IS NOT NULL),
o AS (SELECT lang, words, row_number() OVER (PARTITION BY lang ORDER BY words) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM n)
SELECT lang, count(*) AS n, min(words) AS min, max(words) FILTER (WHERE i = least(n - 1, CAST(floor(0.05 * n) AS BIGINT))) AS p5, max(words) FILTER (WHERE i = least(n - 1, CAST(floor(0.5 * n) AS BIGINT))) AS p50,
max(words) FILTER (WHERE i = least(n - 1, CAST(floor(0.95 * n) AS BIGINT))) AS p95, max(words) AS max, round(avg(words), 1) AS mean FROM o GROUP BY lang""")
def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by language: least, nearest-rank percentiles, most and mean."""
    rows = corpus(spark, sf_dir).select("lang", F.when(F.col("key") == "", 0).otherwise(F.size(F.split("key", " "))).alias("words")).where(F.col("key").isNotNull())
    return length_summary(rows, ["lang"], "words")


@query("""SELECT lang, source, count(*) FILTER (WHERE label = 0) AS normal, count(*) FILTER (WHERE label = 1) AS phishing, count(*) AS total FROM corpus WHERE label IS NOT NULL GROUP BY GROUPING SETS ((), (lang), (source))""")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels overall, by language and by source."""
    return (corpus(spark, sf_dir).where("label is not null").groupingSets([[], [F.col("lang")], [F.col("source")]], "lang", "source")
            .agg(F.count_if(F.col("label") == 0).alias("normal"), F.count_if(F.col("label") == 1).alias("phishing"), F.count(F.lit(1)).alias("total")))


SPLIT = NEAR + """, sized AS (SELECT cluster, sum(n) AS n, max(lang) FILTER (WHERE k = 1) AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first) AS k
  FROM (SELECT cluster, lang, count(*) AS n, min(id) AS first FROM clusters JOIN corpus USING (id) GROUP BY cluster, lang)) GROUP BY cluster),
ran AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY stratum ORDER BY md5(CAST(cluster AS VARCHAR)), cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(n) OVER (PARTITION BY stratum) AS total FROM sized),
split AS (SELECT *, CASE WHEN before < 0.15 * total THEN 'test' WHEN before < 0.3 * total THEN 'validation' ELSE 'train' END AS split FROM ran)
"""


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cluster, split): clusters are dealt whole, by strata of their most frequent language, until a share is reached.

    The order is that of a hash; sums run inside slices of it and are offset by the
    sums of the slices before.
    """
    stage = Staging(spark)
    lang = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    k = stage.save(clusters(spark, sf_dir).join(lang, "id"), "clusters")
    by_lang = k.groupBy("cluster", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    most = F.coalesce(F.max_by("lang", F.struct("n", -F.col("first"))), F.lit(""))
    place = F.md5(F.col("cluster").cast("string"))
    sized = stage.save(by_lang.groupBy("cluster").agg(F.sum("n").alias("n"), most.alias("stratum")).withColumns({"place": place, "slice": F.substring(place, 1, 3)}), "sized")
    sums = sized.groupBy("stratum", "slice").agg(F.sum("n").alias("s"))
    ahead = Window.partitionBy("stratum").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("stratum", "slice", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("skip"), F.sum("s").over(Window.partitionBy("stratum")).alias("total"))
    inside = Window.partitionBy("stratum", "slice").orderBy("place", "cluster").rowsBetween(Window.unboundedPreceding, -1)
    ran = sized.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["stratum", "slice"]).withColumn("before", F.col("inside") + F.col("skip"))
    dealt = ran.withColumn("split", F.when(F.col("before") < 0.15 * F.col("total"), "test").when(F.col("before") < 0.3 * F.col("total"), "validation").otherwise("train"))
    return k.select("id", "cluster").join(dealt.select("cluster", "split"), "cluster")


@query(SPLIT + "SELECT k.id, k.cluster, s.split FROM clusters k JOIN split s USING (cluster)")
def leak_free_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, validation and test splits that no near-duplicate cluster crosses."""
    return splits(spark, sf_dir).select("id", "cluster", "split")


@query(SPLIT + """SELECT count(*) FILTER (WHERE n > 1) AS crossing_clusters, (SELECT count(*) FROM (SELECT key FROM clusters k JOIN split s USING (cluster) JOIN corpus c USING (id) WHERE key <> '' GROUP BY key HAVING count(DISTINCT s.split) > 1)) AS crossing_texts
FROM (SELECT k.cluster, count(DISTINCT s.split) AS n FROM clusters k JOIN split s USING (cluster) GROUP BY k.cluster)""")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters and texts in more than one split; both must be 0."""
    s = splits(spark, sf_dir).join(keys(spark, sf_dir).where("key <> ''").select("id", F.md5("key").alias("text_hash")), "id", "left")
    a = s.groupBy("cluster").agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("crossing_clusters"), F.lit(1).alias("k"))
    b = s.where("text_hash is not null").groupBy("text_hash").agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("crossing_texts"), F.lit(1).alias("k"))
    return a.join(b, "k").drop("k")


@query(r""", p AS (SELECT id, unnest(string_split(key, ' ')) AS w, unnest(range(1, len(string_split(key, ' ')) + 1)) AS i FROM corpus WHERE key <> ''),
b AS (SELECT *, i - row_number() OVER (PARTITION BY id, w ORDER BY i) AS island FROM p),
r AS (SELECT id, i, row_number() OVER (PARTITION BY id, w, island ORDER BY i) AS nth FROM b)
SELECT id, count(*) FILTER (WHERE nth <= 3) AS kept, count(*) FILTER (WHERE nth > 3) AS dropped FROM r GROUP BY id""")
def capped_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left when runs of one word are cut to three, per document."""
    w = F.split("key", " ")
    state = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("kept"))

    def step(s, x):
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), (s["kept"] + F.when(run <= 3, 1).otherwise(0)).cast("long").alias("kept"))

    out = corpus(spark, sf_dir).where("key <> ''").select("id", F.size(w).alias("n"), F.aggregate(w, state, step)["kept"].alias("kept"))
    return out.select("id", "kept", (F.col("n") - F.col("kept")).cast("long").alias("dropped"))


@query("""SELECT conv_id, turn, role, level, coalesce(level > max(level) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), level > 0) AS alert
FROM (SELECT conv_id, turn, role, CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'and the') THEN 1 ELSE 0 END AS level FROM conversations)""")
def rising_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns at which a conversation's level rises above all levels before."""
    t = F.lower("text")
    level = F.when(t.contains("the"), 1).otherwise(0) + F.when(t.contains("and the"), 1).otherwise(0)
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", level.alias("level"))
    return rows.withColumn("alert", F.coalesce(F.col("level") > F.max("level").over(before), F.col("level") > 0))


@query("""SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS speakers, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, sum(len(string_split(trim(text), ' ')))::BIGINT AS pieces FROM conversations GROUP BY 1""")
def speaker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and speakers of each conversation."""
    return read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.countDistinct("role").alias("speakers"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"),
        F.sum(F.size(F.split(F.trim("text"), " "))).cast("long").alias("pieces"))


WORD_ERRORS = r""", t AS (SELECT conv_id, turn, role, text, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS w FROM conversations),
p AS (SELECT row_number() OVER () AS pair, h.conv_id, h.turn, h.role, r.text IS NOT NULL AS given, coalesce(r.w, []) AS r, coalesce(h.w, []) AS h FROM t h LEFT JOIN t r ON r.conv_id = h.conv_id AND r.turn = h.turn + 1),
dp(pair, i, j, v) AS (SELECT pair, 0, unnest(range(len(h) + 1)), unnest(range(len(h) + 1)) FROM p WHERE len(r) > 0
  UNION ALL SELECT pair, i + 1, j, j + min(best - j) OVER (PARTITION BY pair ORDER BY j) FROM (
    SELECT d.pair, d.i, d.j, least(d.v + 1, CASE WHEN d.j > 0 THEN lag(d.v) OVER (PARTITION BY d.pair ORDER BY d.j) + (p.h[d.j] <> p.r[d.i + 1])::INT END) AS best FROM dp d JOIN p USING (pair) WHERE d.i < len(p.r))),
rates AS (SELECT p.conv_id, p.turn, p.role, d.v / len(p.r) AS wer FROM p LEFT JOIN dp d ON d.pair = p.pair AND d.i = len(p.r) AND d.j = len(p.h) AND len(p.r) > 0)
"""


def turn_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, wer): every turn against the next as its reference; the last turn has none."""
    t = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return t.join(nxt, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", word_error_rate(F.col("reference"), F.col("text")).alias("wer"))


@query(WORD_ERRORS + "SELECT conv_id, turn, round(wer, 6) AS wer FROM rates")
def word_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate of every turn against the next."""
    return turn_errors(spark, sf_dir).select("conv_id", "turn", F.round("wer", 6).alias("wer"))


@query(WORD_ERRORS + "SELECT role, count(*) AS files, count(wer) AS with_reference, round(avg(wer), 4) AS mean_wer FROM rates GROUP BY role")
def mean_word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean word error rate by role, with the turns that have a reference and all turns."""
    return mean_word_error(turn_errors(spark, sf_dir), ["role"])


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_full_match(t, '[.\s]*') THEN '' ELSE t END AS tidy FROM (SELECT conv_id, turn, trim(regexp_replace(replace(text, ',', ' ...'), '(\s*\.){3,}', '.', 'g')) AS t FROM conversations)""")
def tidied_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with runs of dots collapsed."""
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", tidy_dots(F.replace("text", F.lit(","), F.lit(" ..."))).alias("tidy"))
