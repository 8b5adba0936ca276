"""Queries that prepare corpora and keep results: cuts by time, corrections, overlap of sets, tables written together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwarden.functions.corrections import corrected
from ringwarden.operators.baseline import choose_strength, fit_baseline, predictions
from ringwarden.operators.intervals import in_ranges
from ringwarden.operators.metrics import confusion
from ringwarden.operators.overlap import similar_to_any
from ringwarden.plans import corpus as texts
from ringwarden.session import read_table
from ringwarden.sources import domain
from ringwarden.sources.committed import read_committed, write_together
from ringwarden.staging import Staging

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Register a query under its function's name, with the SQL of the same rows."""
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH s AS (SELECT user_id, event_id, epoch(ts) AS begin, epoch(ts) + value * 100 AS stop FROM events),
c AS (SELECT user_id, event_id AS cut_id, epoch(ts) - 3600 * (event_id % 50) AS cut_start, epoch(ts) + 600 * (event_id % 7) - 300 AS cut_end FROM events WHERE event_type = 'error')
SELECT c.user_id, cut_id, count(*) AS segments, min(event_id) AS first, max(event_id) AS last, round(sum(stop - begin), 3) AS seconds
FROM c JOIN s ON s.user_id = c.user_id AND (begin + stop) / 2 BETWEEN cut_start AND cut_end GROUP BY ALL""")
def cut_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of a user's time line (an error and the time before it) with the segments whose middle lies in them."""
    e, t = read_table(spark, sf_dir, "events"), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    segments = e.select("user_id", "event_id", t.alias("begin"), (t + F.col("value") * 100).alias("stop")).withColumn("middle", (F.col("begin") + F.col("stop")) / 2)
    cuts = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("cut_id"), (t - 3600 * (F.col("event_id") % 50)).alias("cut_start"), (t + 600 * (F.col("event_id") % 7) - 300).alias("cut_end"))
    return in_ranges(segments, cuts, "user_id", "middle", "cut_start", "cut_end").groupBy("user_id", "cut_id").agg(
        F.count(F.lit(1)).alias("segments"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.round(F.sum(F.col("stop") - F.col("begin")), 3).alias("seconds"))


@query(texts.PRELUDE + """, g AS (SELECT DISTINCT id, gram FROM (SELECT id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [array_to_string(w, ' ')] END) AS gram
  FROM (SELECT id, string_split(key, ' ') AS w FROM corpus WHERE key <> ''))),
s AS (SELECT id, count(*) AS n, substr(md5(CAST(id AS VARCHAR)), 1, 1) IN ('0', '1') AS held FROM g GROUP BY id),
m AS (SELECT a.id, b.id AS other, count(*) AS common FROM g a JOIN s x ON x.id = a.id AND x.held JOIN g b USING (gram) JOIN s y ON y.id = b.id AND NOT y.held GROUP BY ALL),
f AS (SELECT DISTINCT m.id FROM m JOIN s x ON x.id = m.id JOIN s y ON y.id = m.other WHERE common * 100 >= 85 * (x.n + y.n - common))
SELECT lang, count(*) AS held, count(f.id) AS leaked FROM corpus LEFT JOIN f USING (id) WHERE substr(md5(CAST(id AS VARCHAR)), 1, 1) IN ('0', '1') GROUP BY lang""")
def cross_set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a held-out set, by language, and how many of them are near duplicates of a text outside it."""
    held_out = F.substring(F.md5(F.col("id").cast("string")), 1, 1).isin("0", "1")
    held, keys = texts.corpus(spark, sf_dir).select("id", "lang").where(held_out), texts.keys(spark, sf_dir)
    leaked = similar_to_any(keys.where(held_out), keys.where(~held_out)).select("id").distinct().withColumn("leak", F.lit(1))
    return held.join(leaked, "id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("held"), F.count("leak").alias("leaked"))


#: Edits that sources take in turn: where to begin, where to end, what to remove; and what is replaced everywhere.
EDITS = [("the ", None, ["and ", "er ", ""]), ("e", "ing", ["th"]), (None, "the", None)]
EVERYWHERE = [("the the", "the"), ("er", "er er er er"), ("ion", "ION")]


def _edit_sql() -> str:
    out = "CASE WHEN contains(b, end_after) THEN left(b, position(end_after IN b) + length(end_after) - 1) ELSE b END"
    replaced = "c"
    for wrong, right in EVERYWHERE:
        replaced = f"replace({replaced}, '{wrong}', '{right}')"
    return f"""WITH d AS (SELECT doc_id, text, dense_rank() OVER (ORDER BY source NULLS LAST) % 3 AS r, source FROM documents WHERE text IS NOT NULL),
e AS (SELECT * FROM (VALUES (1, 'the ', NULL, ['and ', 'er ']), (2, 'e', 'ing', ['th']), (0, NULL, 'the', NULL)) v(r, start_at, end_after, gone)),
j AS (SELECT doc_id, end_after, coalesce(gone, []) AS gone, CASE WHEN contains(text, start_at) THEN text[position(start_at IN text):] ELSE text END AS b FROM d LEFT JOIN e ON e.r = d.r AND source IS NOT NULL),
k AS (SELECT doc_id, gone, {out} AS c FROM j),
l AS (SELECT doc_id, CASE WHEN len(gone) = 2 THEN replace(replace(c, gone[1], ' '), gone[2], ' ') WHEN len(gone) = 1 THEN replace(c, gone[1], ' ') ELSE c END AS c FROM k),
w AS (SELECT doc_id, regexp_extract_all({replaced}, '\\S+') AS w FROM l)
SELECT doc_id, array_to_string(list_filter(w, lambda x, i: NOT coalesce(i > 3 AND w[i - 1] = x AND w[i - 2] = x AND w[i - 3] = x, false)), ' ') AS text FROM w"""


@query(_edit_sql())
def corrected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents corrected by edits of their source."""
    d = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", "source")
    names = [r[0] for r in d.select("source").where("source is not null").distinct().orderBy("source").collect()]  # the sources of a corpus
    edits = [(s, *EDITS[i % 3]) for i, s in enumerate(names)]
    rules = spark.createDataFrame(edits, "source string, start_at string, end_after string, remove array<string>")
    return d.join(F.broadcast(rules), "source", "left").select("doc_id", corrected(F.col("text"), F.col("start_at"), F.col("end_after"), F.col("remove"), EVERYWHERE).alias("text"))


@query(domain.PRELUDE + """SELECT call_id, line, part_id, supplier_id, risk_score, risk_level, len(codes)::BIGINT AS indicators FROM analyses WHERE status = 'COMPLETED'""")
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and their indicators, stored together in two batches, one of them twice, and read back."""
    stage = Staging(spark)
    folder = f"{stage.base}/results"
    done = domain.analyses(spark, sf_dir).where("status = 'COMPLETED'").select("call_id", "line", "part_id", "supplier_id", "risk_score", "risk_level", "codes")
    for batch in (0, 1, 0):
        mine = done.where(F.pmod(F.xxhash64("call_id"), F.lit(2)) == batch)
        key = ["call_id", "line", "part_id", "supplier_id"]
        write_together({"results": mine.drop("codes"), "indicators": mine.select(*key, F.explode("codes").alias("code"))}, folder, batch)
    keys = "call_id long, line int, part_id long, supplier_id long"
    results = read_committed(spark, folder, "results", f"{keys}, risk_score int, risk_level string")
    found = read_committed(spark, folder, "indicators", f"{keys}, code string").groupBy("call_id", "line", "part_id", "supplier_id").agg(F.count(F.lit(1)).alias("indicators"))
    return results.join(found, ["call_id", "line", "part_id", "supplier_id"], "left").select(
        "call_id", "line", "part_id", "supplier_id", "risk_score", "risk_level", F.coalesce("indicators", F.lit(0)).cast("long").alias("indicators"))


def labelled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, label, part): texts labelled by their quality; a fifth each to choose and to test by, the rest to learn from."""
    part = F.crc32(F.col("id").cast("string").cast("binary")) % 5
    return texts.corpus(spark, sf_dir).where("quality is not null").select("id", "text", F.col("quality").alias("label"), F.when(part == 0, "choose").when(part == 1, "test").otherwise("learn").alias("part"))


def baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates of the baseline on the rows to choose by and to test by, for every strength; the chosen one is marked."""
    rows = Staging(spark).save(labelled_parts(spark, sf_dir), "labelled")
    model = fit_baseline(rows.where("part = 'learn'"))
    best, _ = choose_strength(model, rows.where("part = 'choose'"))
    scored = Staging(spark).save(predictions(model, rows.where("part <> 'learn'")).select("i", "label", "predicted", F.concat_ws(":", "part", "i").alias("case")), "predictions")
    strengths = F.array(*[F.lit(c) for c in model.weights])
    part = F.split("case", ":")
    return (confusion(scored, ["case"]).where("case is not null").withColumns({"part": F.get(part, 0), "strength": F.get(strengths, F.get(part, 1).cast("int"))})
            .withColumn("chosen", F.col("strength") == F.lit(best)).drop("case"))


def baseline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen baseline's probability for every document."""
    rows = Staging(spark).save(labelled_parts(spark, sf_dir), "labelled")
    model = fit_baseline(rows.where("part = 'learn'"))
    best, _ = choose_strength(model, rows.where("part = 'choose'"))
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.round(model.probability(F.col("text"), best), 6).alias("probability"))


QUERIES |= {"baseline_metrics": baseline_metrics, "baseline_scores": baseline_scores}
