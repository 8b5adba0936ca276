"""Evaluation, splits and samples of labelled corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringwarden.functions.risk import risk, suspicious
from ringwarden.operators.audit import audit_report, audited
from ringwarden.operators.metrics import risk_summary
from ringwarden.operators.ranking import rank_by_range
from ringwarden.plans import corpus as texts
from ringwarden.session import read_table
from ringwarden.sources import domain
from ringwarden.sources.files import read_json_lines, row_digest
from ringwarden.staging import Staging

QUERIES, ORACLES = {}, {}
#: Words by which the stand-in classifier scores a text.
MARKERS = ["idiot", "stupid", "trash", "scum"]
#: Where groups of 3, 4, ... 12 rows end within 75 rows.
GROUP_ENDS = [3, 7, 12, 18, 25, 33, 42, 52, 63]
#: Letters with Vietnamese marks.
MARKED = "[À-ÃÈ-ÊÌÍÒ-ÕÙÚÝà-ãè-êìíò-õùúýĂăĐđĨĩŨũƠơƯưẠ-ỹ]"


def query(sql: str, prelude: str = ""):
    """Register a query under its function's name, with the SQL of the same rows."""
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = prelude + sql
        return f

    return add


LEVELLED = texts.PRELUDE + f""", levelled AS (SELECT *, CASE WHEN hits >= 2 THEN 'HIGH' WHEN hits = 1 THEN 'MEDIUM' ELSE 'LOW' END AS level
  FROM (SELECT *, {" + ".join(f"contains(lower(text), '{m}')::INTEGER" for m in MARKERS)} AS hits FROM corpus WHERE label IS NOT NULL))
"""


def levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, label, hits, level) of labelled texts by the stand-in classifier."""
    t = F.lower("text")
    hits = sum((t.contains(m).cast("int") for m in MARKERS[1:]), t.contains(MARKERS[0]).cast("int"))
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", hits.alias("hits"), "doc_id")
    label = read_table(spark, sf_dir, "labels").where("toxic is not null").select("doc_id", F.col("toxic").alias("label"))
    level = F.when(F.col("hits") >= 2, "HIGH").when(F.col("hits") == 1, "MEDIUM").otherwise("LOW")
    return d.join(label, "doc_id").select("id", "source", "label", "hits", level.alias("level"))


@query("SELECT label, level, count(*) AS n, level <> 'LOW' AS detected FROM levelled GROUP BY label, level", LEVELLED)
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by label and level; a level above LOW is a detection."""
    return levelled(spark, sf_dir).groupBy("label", "level").agg(F.count(F.lit(1)).alias("n")).withColumn("detected", F.col("level") != "LOW")


@query("""SELECT source, count(*) AS rows, count(*) FILTER (WHERE label = 1 AND level <> 'LOW') AS caught, count(*) FILTER (WHERE label = 0 AND level <> 'LOW') AS false_alarms,
count(*) FILTER (WHERE label = 1 AND level = 'LOW') AS missed FROM levelled GROUP BY ROLLUP (source)""", LEVELLED)
def risk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caught, missed and false alarms by source and in all."""
    risky, bad = F.col("level") != "LOW", F.col("label") == 1
    return levelled(spark, sf_dir).rollup("source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(bad & risky).alias("caught"), F.count_if((F.col("label") == 0) & risky).alias("false_alarms"), F.count_if(bad & ~risky).alias("missed"))


@query(""", tried AS (SELECT t.threshold, l.id % 2 AS half, l.label, coalesce(l.hits >= t.threshold, false) AS said FROM levelled l, (SELECT unnest([1, 2, 3]) AS threshold) t),
f AS (SELECT threshold, half, coalesce(2.0 * count(*) FILTER (WHERE said AND label = 1) / nullif(2 * count(*) FILTER (WHERE said AND label = 1) + count(*) FILTER (WHERE said AND label = 0)
  + count(*) FILTER (WHERE NOT said AND label = 1), 0), 0) AS f1 FROM tried GROUP BY threshold, half)
SELECT threshold, round(a, 4) AS f1_selection, round(b, 4) AS f1_validation FROM (SELECT threshold, max(f1) FILTER (WHERE half = 0) AS a, max(f1) FILTER (WHERE half = 1) AS b FROM f GROUP BY threshold)
ORDER BY a DESC, b DESC, threshold LIMIT 1""", LEVELLED)
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold with the best F1 on one half, then on the other, the first on ties; rows are counted once for all candidates."""
    n = levelled(spark, sf_dir).groupBy((F.col("id") % 2).alias("half"), "label", "hits").agg(F.count(F.lit(1)).alias("n"))
    tried = n.withColumn("threshold", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)]))).withColumn("said", F.coalesce(F.col("hits") >= F.col("threshold"), F.lit(False)))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    said, bad = F.col("said"), F.col("label") == 1
    tp, fp, fn = total(said & bad), total(said & (F.col("label") == 0)), total(~said & bad)
    f = tried.groupBy("threshold", "half").agg(F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))
    each = f.groupBy("threshold").agg(F.max(F.when(F.col("half") == 0, F.col("f1"))).alias("a"), F.max(F.when(F.col("half") == 1, F.col("f1"))).alias("b"))
    best = each.agg(F.max(F.struct("a", "b", (-F.col("threshold")).alias("first"))).alias("m")).where("m is not null")
    return best.select((-F.col("m.first")).alias("threshold"), F.round("m.a", 4).alias("f1_selection"), F.round("m.b", 4).alias("f1_validation"))


@query("""SELECT lang, count(*) FILTER (WHERE source = 'src3') AS synthetic, count(*) AS rows, round(100.0 * count(*) FILTER (WHERE source = 'src3') / count(*), 1)::DOUBLE AS share
FROM documents GROUP BY lang""")
def source_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one source by language, and their percentage."""
    n, all_ = F.count_if(F.col("source") == "src3"), F.count(F.lit(1))
    return read_table(spark, sf_dir, "documents").groupBy("lang").agg(n.alias("synthetic"), all_.alias("rows"), F.round(100.0 * n / all_, 1).alias("share"))


@query("""SELECT conv_id % 2 AS label, speakers, count(*) AS calls, count(*) FILTER (WHERE hit) AS any_hit, count(*) FILTER (WHERE strong) AS any_strong FROM (
SELECT conv_id, count(DISTINCT role) AS speakers, bool_or(contains(lower(text), 'the')) AS hit, bool_or(contains(lower(text), 'and the')) AS strong FROM conversations GROUP BY conv_id) GROUP BY 1, 2""")
def party_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with any and with a strong hit, by label and number of speakers."""
    t = F.lower("text")
    calls = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.countDistinct("role").alias("speakers"), F.bool_or(t.contains("the")).alias("hit"), F.bool_or(t.contains("and the")).alias("strong"))
    return calls.groupBy((F.col("conv_id") % 2).alias("label"), "speakers").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("hit").alias("any_hit"), F.count_if("strong").alias("any_strong"))


@query("""SELECT md5(key) AS text_hash, lang, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, first) AS k
FROM (SELECT key, lang, count(*) AS n, min(id) AS first FROM corpus WHERE key <> '' GROUP BY key, lang)) WHERE k = 1""", texts.PRELUDE)
def mode_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent language of the copies of each text; of equal ones that of the least id."""
    rows = texts.corpus(spark, sf_dir).where("key <> ''").groupBy(F.md5("key").alias("text_hash"), "lang").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    most = rows.groupBy("text_hash").agg(F.max_by(F.struct("lang", "n"), F.struct("n", -F.col("first"))).alias("m"))
    return most.select("text_hash", "m.lang", "m.n")


def by_id(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number the rows of each key from 0 in order of ``id``, in ranges of about equal numbers of rows."""
    return rank_by_range(rows, keys, "id")


@query(texts.DEDUP + "SELECT id, row_number() OVER (ORDER BY id) % 5 = 0 AS holdout FROM kept", texts.PRELUDE)
def every_fifth(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    """Every ``n``-th text, in order of ids and without exact copies, is held out."""
    kept = texts.deduplicated(spark, sf_dir).select("id", F.lit(0).alias("all"))
    return by_id(kept, ["all"]).select("id", ((F.col("rank") + 1) % n == 0).alias("holdout"))


@query(f"""SELECT id, source, CASE WHEN r < 30 THEN r ELSE 30 + 10 * ((r - 30) // 75) + len(list_filter({GROUP_ENDS}, lambda c: c <= (r - 30) % 75)) END AS page_group
FROM (SELECT doc_id AS id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents WHERE source IS NOT NULL)""")
def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 rows of a source stand alone, the others in groups of 3 to 12."""
    d = read_table(spark, sf_dir, "documents").where("source is not null").select(F.col("doc_id").alias("id"), "source")
    over = F.col("rank") - 30
    inside = F.size(F.filter(F.array(*[F.lit(c) for c in GROUP_ENDS]), lambda c: c <= over % 75))
    return by_id(d, ["source"]).select("id", "source", F.when(F.col("rank") < 30, F.col("rank")).otherwise(30 + 10 * F.floor(over / 75) + inside).alias("page_group"))


@query("""SELECT label, id FROM (SELECT toxic AS label, doc_id AS id, row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id) AS k
FROM labels WHERE toxic IS NOT NULL) WHERE k <= 500""")
def seeded_take(spark: SparkSession, sf_dir: str, n: int = 500, seed: int = 7) -> DataFrame:
    """``n`` rows of each label in an order that a seed gives, or all of them."""
    rows = read_table(spark, sf_dir, "labels").where("toxic is not null").select(F.col("toxic").alias("label"), F.col("doc_id").alias("id"))
    w = Window.partitionBy("label").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), "id")
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")


@query(r"""SELECT id, array_to_string(list_sort(list_transform(list_sort(list_transform(range(n), lambda i: md5(id || ':1:' || i) || ':' || i))[1:6], lambda s: CAST(string_split(s, ':')[2] AS INTEGER))), ',') AS picked
FROM (SELECT id, greatest(0, CAST(ceil((len(string_split(key, ' ')) - 64) / 48.0) AS INTEGER)) + 1 AS n FROM corpus WHERE key IS NOT NULL)""", texts.PRELUDE)
def sampled_windows(spark: SparkSession, sf_dir: str, most: int = 6, epoch: int = 1) -> DataFrame:
    """At most ``most`` windows of a text for one epoch, others in the next."""
    n = F.greatest(F.lit(0), F.ceil((F.size(F.split("key", " ")) - 64) / 48)).cast("int")
    rows = texts.corpus(spark, sf_dir).where("key is not null").select("id", n.alias("last"))
    mark = lambda i: F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{epoch}:"), i.cast("string")))
    mixed = F.array_sort(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.struct(mark(i).alias("h"), i.alias("i"))))
    picked = F.array_sort(F.transform(F.slice(mixed, 1, most), lambda x: x["i"]))
    return rows.select("id", F.array_join(picked.cast("array<string>"), ",").alias("picked"))


FIXED = "CASE source WHEN 'src0' THEN 'test' WHEN 'src1' THEN 'validation' ELSE 'train' END"


def fixed_split(source: Column) -> Column:
    """The split that a source belongs to, never random."""
    return F.when(source == "src0", "test").when(source == "src1", "validation").otherwise("train")


@query(f"""WITH s AS (SELECT doc_id AS id, source, n_chars, {FIXED} AS split FROM documents)
SELECT id, 'validation' AS reason FROM s WHERE split = 'validation' UNION ALL SELECT id, 'tuned' FROM s WHERE split = 'train' AND source = 'src3'
UNION ALL SELECT id, 'short' FROM s WHERE split = 'train' AND n_chars < 200""")
def selection_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that choose a model: a split, and rows of another by source and by length; who is in for two reasons is there twice."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), fixed_split(F.col("source")).alias("split"), "source", "n_chars")
    train = F.col("split") == "train"
    reasons = F.array(F.when(F.col("split") == "validation", "validation"), F.when(train & (F.col("source") == "src3"), "tuned"), F.when(train & (F.col("n_chars") < 200), "short"))
    return d.select("id", F.explode_outer(F.array_compact(reasons)).alias("reason")).where("reason is not null")


FAMILY = texts.PRELUDE + f", f AS (SELECT array_to_string(string_split(key, ' ')[1:3], ' ') AS family, {FIXED} AS split FROM corpus WHERE key <> '')\n"


@query("SELECT family FROM f WHERE split = 'train' INTERSECT SELECT family FROM f WHERE split = 'validation'", FAMILY)
def family_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families (texts with the same first words) in both train and validation, with one grouping."""
    family = F.array_join(F.slice(F.split("key", " "), 1, 3), " ")
    rows = texts.corpus(spark, sf_dir).where("key <> ''").select(family.alias("family"), fixed_split(F.col("source")).alias("split"))
    both = rows.groupBy("family").agg(F.bool_or(F.col("split") == "train").alias("a"), F.bool_or(F.col("split") == "validation").alias("b"))
    return both.where("a and b").select("family")


@query("""SELECT call_id, line, part_id, supplier_id, array_to_string(list_sort(list_filter(coalesce(codes, []), lambda c: NOT list_contains(coalesce(before, []), c))), ',') AS new_codes
FROM (SELECT *, lag(codes) OVER (PARTITION BY call_id ORDER BY created_at, line, part_id, supplier_id, quantity, price) AS before FROM analyses)""", domain.PRELUDE)
def new_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of an analysis that the one before it did not have."""
    a = domain.analyses(spark, sf_dir)
    none = F.array().cast("array<string>")
    before = F.lag("codes").over(Window.partitionBy("call_id").orderBy(*domain.ANALYSIS_ORDER))
    fresh = F.array_sort(F.array_except(F.coalesce("codes", none), F.coalesce("before", none)))
    return a.withColumn("before", before).select("call_id", "line", "part_id", "supplier_id", F.array_join(fresh, ",").alias("new_codes"))


@query("""SELECT user_id, event_id, sha256(CAST(event_id AS VARCHAR)) AS token FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k
FROM events WHERE event_id % 3 <> 0) WHERE k = 1""")
def latest_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest unused token of each user, as its digest."""
    free = read_table(spark, sf_dir, "events").where("event_id % 3 <> 0")
    last = free.groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
    return last.select("user_id", "event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("token"))


@query("""SELECT * FROM (SELECT call_id, line, part_id, supplier_id, CASE WHEN score NOT BETWEEN 0 AND 100 THEN 'SCORE' WHEN p NOT BETWEEN 0 AND 1 THEN 'CONFIDENCE' END AS problem
FROM (SELECT l_orderkey AS call_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supplier_id, CAST(l_quantity AS INTEGER) * 2 + 4 AS score, round(l_discount * 10, 4) + 0.05 AS p FROM lineitem))
WHERE problem IS NOT NULL""")
def quarantined_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses that must not be trusted, with the first thing wrong."""
    s = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id"),
        (F.col("l_quantity").cast("int") * 2 + 4).alias("score"), (F.round(F.col("l_discount") * 10, 4) + 0.05).alias("p"))
    problem = F.when(~F.col("score").between(0, 100), "SCORE").when(~F.col("p").between(0, 1), "CONFIDENCE")
    return s.select("call_id", "line", "part_id", "supplier_id", problem.alias("problem")).where("problem is not null")


@query(f"SELECT doc_id AS id, NOT regexp_matches(text, '{MARKED}') AS no_marks, left(text, 80) AS head, sha256(text) AS digest FROM documents")
def text_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text has no Vietnamese mark, its first 80 characters and its digest."""
    t = F.col("text")
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (~t.rlike(MARKED)).alias("no_marks"), F.substring(t, 1, 80).alias("head"), F.sha2(t, 256).alias("digest"))


@query("""SELECT source, count(*) AS rows, sum(('0x' || md5(concat_ws('|', doc_id, lang, source, md5(text)))[1:8])::BIGINT)::BIGINT AS digest FROM documents GROUP BY source""")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and digest by source of JSON lines that were written and read again."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.md5("text").alias("text_hash"))
    path = f"{Staging(spark).base}/lines.json"
    d.write.json(path)
    return read_json_lines(spark, path, d.schema).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), row_digest(*d.columns).alias("digest"))


@query(texts.SCORED + """, rated AS (SELECT *, call_id % 2 AS label, CASE WHEN score >= 60 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS level,
  list_contains(severities, 'HIGH') OR (len(severities) >= 2 AND len(list_filter(severities, lambda s: s <> 'LOW')) > 0) AS flagged, 'set' || (supplier_id % 5) AS of FROM result),
grouped AS (SELECT *, of AS part FROM rated UNION ALL SELECT *, 'TOTAL tuning' FROM rated WHERE of IN ('set0', 'set1') UNION ALL SELECT *, 'TOTAL final' FROM rated WHERE of NOT IN ('set0', 'set1') UNION ALL SELECT *, 'TOTAL' FROM rated),
n AS (SELECT part, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS scam, count(*) FILTER (WHERE label = 0) AS normal, count(*) FILTER (WHERE capped) AS capped,
  count(*) FILTER (WHERE label = 1 AND level = 'HIGH') AS scam_high, count(*) FILTER (WHERE label = 1 AND level = 'MEDIUM') AS scam_medium, count(*) FILTER (WHERE label = 1 AND level = 'LOW') AS scam_low,
  count(*) FILTER (WHERE label = 0 AND level = 'HIGH') AS normal_high, count(*) FILTER (WHERE label = 0 AND level = 'MEDIUM') AS normal_medium, count(*) FILTER (WHERE label = 0 AND level = 'LOW') AS normal_low,
  count(*) FILTER (WHERE label = 1 AND p < 0.5) AS model_missed, count(*) FILTER (WHERE label = 0 AND p >= 0.5) AS model_flagged,
  count(*) FILTER (WHERE label = 1 AND NOT flagged) AS rules_missed, count(*) FILTER (WHERE label = 0 AND flagged) AS rules_flagged FROM grouped GROUP BY part),
r AS (SELECT *, round((scam - scam_low) / nullif(scam - scam_low + normal - normal_low, 0), 4) AS precision, round((scam - scam_low) / nullif(scam, 0), 4) AS recall,
  round((scam - scam_low + normal_low) / rows, 4) AS accuracy, round((rows - model_missed - model_flagged) / rows, 4) AS model_accuracy FROM n)
SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) END AS f1 FROM r""", texts.PRELUDE)
def risk_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates of scored rows for each set and for the totals that sets belong to; a row is counted once in each."""
    of = F.concat(F.lit("set"), (F.col("supplier_id") % 5).cast("string"))
    s = texts.scored(spark, sf_dir).withColumns({"r": risk(F.col("codes"), F.col("severities"), F.col("p"), F.col("words")), "of": of})
    tuning = F.col("of").isin("set0", "set1")
    rated = s.select((F.col("call_id") % 2).alias("label"), F.col("p").alias("probability"), suspicious(F.col("severities")).alias("flagged"), "r.level", "r.capped",
                     F.explode(F.array("of", F.when(tuning, "TOTAL tuning").otherwise("TOTAL final"), F.lit("TOTAL"))).alias("part"))
    return risk_summary(rated, ["part"])


CHECKED = texts.PRELUDE + r""", cleaned AS (SELECT id, source, text, label, key, trim(regexp_replace(regexp_replace(text, chr(65279), '', 'g'), '\s+', ' ', 'g')) AS clean FROM corpus),
early AS (SELECT *, CASE WHEN text IS NULL THEN 'missing_text' WHEN clean = '' THEN 'empty_text' WHEN label IS NULL OR label NOT IN (0, 1) THEN 'invalid_label' END AS early FROM cleaned),
copies AS (SELECT *, min(id) OVER w AS first, min(label) OVER w <> max(label) OVER w AS differ FROM early WHERE early IS NULL WINDOW w AS (PARTITION BY source, key)),
checked AS (SELECT id, source, text, clean, early AS reason FROM early WHERE early IS NOT NULL UNION ALL
  SELECT id, source, text, clean, CASE WHEN differ THEN 'conflicting_label' WHEN id <> first THEN 'exact_duplicate' END FROM copies)
"""


@query("SELECT id, source, reason FROM checked WHERE reason IS NOT NULL", CHECKED)
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a clean corpus leaves out, each with its reason."""
    return audited(texts.corpus(spark, sf_dir).drop("key")).where("reason is not null").select("id", "source", "reason")


@query(f"""SELECT source, count(*) AS rows, count(*) FILTER (WHERE reason = 'missing_text') AS missing_text, count(*) FILTER (WHERE reason = 'empty_text') AS empty_text,
count(*) FILTER (WHERE reason = 'invalid_label') AS invalid_label, count(*) FILTER (WHERE reason = 'conflicting_label') AS conflicting_label, count(*) FILTER (WHERE reason = 'exact_duplicate') AS exact_duplicate,
count(*) FILTER (WHERE reason IS NULL) AS kept, count(*) FILTER (WHERE reason IS NULL AND len(string_split(clean, ' ')) < 3) AS short, count(*) FILTER (WHERE reason IS NULL AND len(string_split(clean, ' ')) > 1500) AS long,
count(*) FILTER (WHERE reason IS NULL AND NOT regexp_matches(text, '{MARKED}')) AS without_marks FROM checked GROUP BY source""", CHECKED)
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit of each source counts."""
    return audit_report(audited(texts.corpus(spark, sf_dir).drop("key")), MARKED)
