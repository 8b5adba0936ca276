"""Queries that add changed copies of texts to a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwarden.functions import augmentation as aug
from ringwarden.operators.ranking import rank_by_range
from ringwarden.session import read_table
from ringwarden.staging import Staging

QUERIES, ORACLES = {}, {}
#: Sources of ordinary speech and of real calls among the given ones.
CHATTER, REAL = "src3", "src1"
#: Share of rows with a copy, copies of a real call, share of copies with two changes, words of small talk, rows of long speech.
SHARE, REAL_COPIES, TWO, TALK_WORDS, LONG_ROWS = 0.45, 4, 0.35, 45, 500
CHANGES = ["interjections", "dropped_words", "repeated_words", "small_talk_before", "small_talk_after"]


def query(sql: str):
    """Register a query under its function's name, with the SQL of the same rows."""
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def chatter(texts: DataFrame) -> tuple[DataFrame, int]:
    """(place, talk) of ordinary speech of six words or more, by id from 0, and their number."""
    spoken = texts.where(F.col("source") == CHATTER).select("id", aug.split_words(F.col("text")).alias("talk")).where(F.size("talk") >= 6)
    ranked = Staging(texts.sparkSession).save(rank_by_range(spoken.withColumn("all", F.lit(0)), ["all"], "id", "place").select("place", "talk"), "chatter")
    return ranked, ranked.count()


def drawn(rows: DataFrame, ranked: DataFrame, n: int, purpose: str, least: int, most: int, words: int | None = None) -> DataFrame:
    """(key, words) for ``rows`` (key): the words of ``least`` to ``most`` different texts of ordinary speech, one after the other.

    A draw that meets a text again counts once, and with ``words`` a text is cut before
    it travels and the whole after it.  Draws and texts meet by an ordinary join.
    """
    times = F.lit(least) + F.floor(aug.chance(F.col("key"), F.lit(purpose)) * (most - least + 1)).cast("int")
    spots = F.array_distinct(F.transform(F.sequence(F.lit(1), times), lambda j: F.floor(aug.chance(F.col("key"), F.lit(purpose), j) * n).cast("long")))
    cut = (lambda c: F.slice(c, 1, words)) if words else (lambda c: c)
    met = rows.select("key", F.posexplode(spots).alias("j", "place")).join(ranked.select("place", cut(F.col("talk")).alias("talk")), "place")
    joined = met.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("j", "talk"))), lambda x: x["talk"])).alias("words"))
    return joined.select("key", cut(F.col("words")).alias("words"))


def changed(name: Column, words: Column, key: Column, talk: Column) -> Column:
    """The words after one named change."""
    return (F.when(name == CHANGES[0], aug.interjected(words, key)).when(name == CHANGES[1], aug.dropped(words, key)).when(name == CHANGES[2], aug.repeated(words, key))
            .when(name == CHANGES[3], F.concat(talk, words)).otherwise(F.concat(words, talk)))


def augmented(texts: DataFrame) -> DataFrame:
    """(key, id, label, changes, augmented) copies of ``texts`` (id, text, source, label, and optionally ``copied``).

    Rows of ordinary speech get none, real calls four, 45 % of the others one; a copy takes one change of five or, 35 %
    of them, two different ones in turn.  Rows that are marked as copies are left out, so a second run adds the same
    rows.  Null texts have no words; ids should be unique, as the key that decides chance is made of them.
    """
    own = texts.where(~F.coalesce("copied", F.lit(False))) if "copied" in texts.columns else texts
    ranked, n = chatter(own)
    copies = F.when(F.col("source") == REAL, REAL_COPIES).otherwise((aug.chance(F.col("id"), F.lit("copy")) < SHARE).cast("int"))
    rows = own.where(F.coalesce(F.col("source") != CHATTER, F.lit(True))).withColumn("n", copies).where("n > 0")
    rows = rows.select("id", "label", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("c")).withColumn("key", F.concat_ws("-", F.col("id").cast("string"), F.col("c").cast("string")))
    order = F.array_sort(F.array(*[F.struct(aug.chance(F.col("key"), F.lit(x)).alias("r"), F.lit(x).alias("name")) for x in CHANGES]))
    some = F.slice(F.transform(order, lambda x: x["name"]), F.lit(1), F.when(aug.chance(F.col("key"), F.lit("two")) < TWO, 2).otherwise(1))
    rows = rows.withColumn("changes", some)
    wants = rows.where(F.arrays_overlap("changes", F.array(F.lit(CHANGES[3]), F.lit(CHANGES[4])))).select("key")
    talk = drawn(wants, ranked, n, "talk", 1, 3, TALK_WORDS).withColumnRenamed("words", "talk")
    none = F.array().cast("array<string>")
    full = rows.join(talk, "key", "left").withColumns({"talk": F.coalesce("talk", none), "w0": aug.split_words(F.col("text"))})
    one = full.withColumn("w1", changed(F.get("changes", F.lit(0)), F.col("w0"), F.col("key"), F.col("talk")))
    two = one.withColumn("w2", F.when(F.size("changes") > 1, changed(F.get("changes", F.lit(1)), F.col("w1"), F.col("key"), F.col("talk"))).otherwise(F.col("w1")))
    return two.select("key", "id", "label", F.array_join("changes", "+").alias("changes"), F.array_join("w2", " ").alias("augmented"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, source, label)."""
    label = read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return read_table(spark, sf_dir, "documents").join(label, "doc_id", "left").select(F.col("doc_id").alias("id"), "text", "source", "label")


def _chance(*parts: str) -> str:
    return f"(('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 7))::BIGINT / 268435456.0)"


def _pick(options: list[str], *parts: str) -> str:
    return f"({options})[CAST(floor({_chance(*parts)} * {len(options)}) AS INTEGER) + 1]"


def _changed(name: str, w: str) -> str:
    """One named change in SQL; places count from 1 there, so chance takes one less."""
    i = "(i - 1)"
    rate = {k: f"({low} + {more} * {_chance('key', repr(k))})" for k, (low, more) in aug.RATES.items()}
    kept = f"list_filter({w}, lambda x, i: {_chance('key', repr('drop'), i)} >= {rate['drop']})"
    return f"""CASE {name} WHEN 'interjections' THEN flatten(list_transform({w}, lambda x, i: CASE WHEN {_chance('key', "'interject'", i)} < {rate['interject']} THEN [{_pick(aug.INTERJECTIONS, 'key', "'which'", i)}, x] ELSE [x] END))
WHEN 'dropped_words' THEN CASE WHEN len({kept}) >= 3 THEN {kept} ELSE {w} END
WHEN 'repeated_words' THEN flatten(list_transform({w}, lambda x, i: CASE WHEN {_chance('key', "'repeat'", i)} < {rate['repeat']} THEN [x, x] ELSE [x] END))
WHEN 'small_talk_before' THEN list_concat(coalesce(talk, []), {w}) ELSE list_concat({w}, coalesce(talk, [])) END"""


def _drawn(rows: str, purpose: str, least: int, most: int, words: int) -> str:
    times = f"{least} + CAST(floor({_chance('key', repr(purpose))} * {most - least + 1}) AS INTEGER)"
    return f"""draws AS (SELECT key, j, CAST(floor({_chance('key', repr(purpose), 'j')} * (SELECT count(*) FROM chatter)) AS BIGINT) AS place FROM (SELECT key, unnest(range(1, {times} + 1)) AS j FROM {rows})),
talks AS (SELECT key, flatten(list(talk[:{words}] ORDER BY j))[:{words}] AS talk FROM (SELECT key, place, min(j) AS j FROM draws GROUP BY ALL) JOIN chatter USING (place) GROUP BY key)"""


BASE = rf"""WITH corpus AS (SELECT doc_id AS id, text, source, toxic AS label FROM documents LEFT JOIN labels USING (doc_id)),
chatter AS (SELECT row_number() OVER (ORDER BY id) - 1 AS place, talk FROM (SELECT id, regexp_extract_all(text, '\S+') AS talk FROM corpus WHERE source = '{CHATTER}') WHERE len(talk) >= 6)
"""
COPIES = BASE + rf""", n AS (SELECT *, CASE WHEN source = '{REAL}' THEN {REAL_COPIES} WHEN {_chance('id', "'copy'")} < {SHARE} THEN 1 ELSE 0 END AS n FROM corpus WHERE source IS DISTINCT FROM '{CHATTER}'),
keyed AS (SELECT *, id || '-' || c AS key FROM (SELECT id, label, coalesce(regexp_extract_all(text, '\S+'), []) AS w0, unnest(range(n)) AS c FROM n)),
chosen AS (SELECT *, list_transform(list_sort([{", ".join(f"{{'r': {_chance('key', repr(x))}, 'name': '{x}'}}" for x in CHANGES)}]), lambda x: x.name)[:CASE WHEN {_chance('key', "'two'")} < {TWO} THEN 2 ELSE 1 END] AS changes FROM keyed),
wants AS (SELECT key FROM chosen WHERE list_has_any(changes, ['small_talk_before', 'small_talk_after'])),
{_drawn('wants', 'talk', 1, 3, TALK_WORDS)},
one AS (SELECT *, {_changed('changes[1]', 'w0')} AS w1 FROM chosen LEFT JOIN talks USING (key)),
two AS (SELECT *, CASE WHEN len(changes) > 1 THEN {_changed('changes[2]', 'w1')} ELSE w1 END AS w2 FROM one)
SELECT key, id, label, array_to_string(changes, '+') AS changes, array_to_string(w2, ' ') AS augmented FROM two"""


@query(COPIES)
def augmented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed copies of the documents; labels stay."""
    return augmented(corpus(spark, sf_dir))


@query(BASE + f""", wants AS (SELECT 'long-speech-' || range AS key FROM range({LONG_ROWS})), {_drawn('wants', 'long', 5, 30, 1 << 30)}
SELECT key, 0 AS label, array_to_string(talk, ' ') AS text FROM talks""")
def long_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmless rows made of 5 to 30 texts of ordinary speech each."""
    ranked, n = chatter(corpus(spark, sf_dir))
    wants = spark.range(LONG_ROWS).select(F.concat(F.lit("long-speech-"), F.col("id").cast("string")).alias("key"))
    return drawn(wants, ranked, n, "long", 5, 30).select("key", F.lit(0).alias("label"), F.array_join("words", " ").alias("text"))


def _mark(i: str) -> str:
    return f"coalesce({i} >= 0 AND {i} < len(w) - 1 AND {_chance('id', repr('swap'), i)} < {aug.SWAPPED}, false)"


def _starts(i: str) -> str:
    return f"({_mark(i)} AND NOT {_mark(f'({i} - 1)')})"


@query(rf"""WITH d AS (SELECT doc_id AS id, coalesce(regexp_extract_all(text, '\S+'), []) AS w, string_split(regexp_replace(regexp_replace(text, '^ +| +$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
e AS (SELECT *, CASE WHEN coalesce(len(s), 0) < 2 THEN list_transform(range(greatest((len(w) - 1) // 10, 0) + 1), lambda k: array_to_string(w[10 * k + 1:10 * k + 10], ' ')) ELSE s END AS parts FROM d)
SELECT id, array_to_string(list_transform(w, lambda x, i: CASE WHEN {_starts('(i - 1)')} THEN w[i + 1] WHEN {_starts('(i - 2)')} THEN w[i - 1] ELSE x END), ' ') AS swapped,
CASE WHEN len(w) = 0 THEN '' ELSE array_to_string(list_transform(parts, lambda x, i: CASE WHEN {_chance('id', "'filler'", '(i - 1)')} < {aug.FILLED} THEN {_pick(aug.FILLERS, 'id', "'phrase'", '(i - 1)')} || ' ' || x ELSE x END), ' ') END AS filled,
array_to_string(list_transform(w, lambda x, i: CASE WHEN {_chance('id', "'tone'", '(i - 1)')} < {aug.BARE} THEN strip_accents(replace(replace(x, 'đ', 'd'), 'Đ', 'D')) ELSE x END), ' ') AS toneless FROM e""")
def perturbed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with neighbours swapped, with fillers before sentences, and with tones that were not heard."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", aug.split_words(F.col("text")).alias("w"))
    w, key = F.col("w"), F.col("id")  # split once: a lambda would split again at every place
    return d.select("id", F.array_join(aug.swapped(w, key), " ").alias("swapped"), aug.with_fillers(F.col("text"), w, key).alias("filled"), F.array_join(aug.toneless(w, key), " ").alias("toneless"))
