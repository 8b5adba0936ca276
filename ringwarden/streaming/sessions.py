"""Live calls scored turn by turn, with Structured Streaming.

Two stateful steps.  The first keeps a call's turns in the order they were spoken,
whatever order they arrive in, scores what has not been scored before, and closes the call
at its end, after too long, or by a timer when nothing comes any more.  Rules and risk
are ordinary DataFrame work on the rows of a batch.  The second step numbers
what is sent out and warns once for each rise of the level.  Both clear their state
when a call is over.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ringwarden.functions.risk import risk
from ringwarden.functions.rules import CODES, conversation
from ringwarden.session import read_table
from ringwarden.staging import Staging

#: Seconds without a frame that end a call, and of sound that do.
IDLE, LONGEST = 30, 1800
LEVELS = ["LOW", "MEDIUM", "HIGH"]
#: Buckets that keys are dealt into; a batch writes the buckets it meets anew, so there are many.
BUCKETS = 4096
FRAMES = "call_id long, seq long, at timestamp, kind string, speaker string, start double, end double, text string"
TURNS = "array<struct<speaker:string,start:double,end:double,text:string>>"
SNAPSHOTS = f"call_id long, since long, n long, kind string, speaker string, start double, end double, text string, turns {TURNS}, probability double, scored long, ended_by string, heard double"
EVENTS = ("call_id long, since long, seq long, type string, speaker string, at_seconds double, text string, score int, level string, confidence double, "
          "probability double, codes array<string>, new_codes array<string>, ended_by string, duration double")


def character_windows(size: int = 40) -> Callable[[str], list[str]]:
    """A text in pieces of ``size`` characters; one for an empty text."""
    return lambda text: [text[i:i + size] for i in range(0, max(1, len(text)), size)]


def top_two(chunks: list[float]) -> float:
    """The mean of the two largest."""
    best = sorted(chunks)[-2:]
    return sum(best) / len(best)


@contextmanager
def keyed_state(spark: SparkSession):
    """Sessions whose streams may keep lists, maps and timers."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Bucketed(StatefulProcessor):
    """Keys are dealt into buckets, the keys of a stream; what is held for the keys of a bucket is one value with one timer.

    So a batch costs a bucket a few calls of the state store and a frame, however many keys it has.  What is
    held for a key is plain values; ``take`` adds a key's rows, in order, ``expire`` is
    asked when time has passed ``due`` (milliseconds, -1: never).  Both return rows and what is held from now on, None for nothing.
    """

    name = "held"
    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    schema = ""
    times: tuple[str, ...] = ()  # columns of ``schema`` given in microseconds

    def take(self, key: tuple, rows: list, held: tuple | None) -> tuple[list[tuple], tuple | None]:
        raise NotImplementedError

    def expire(self, key: tuple, held: tuple) -> tuple[list[tuple], tuple | None]:
        raise NotImplementedError

    def due(self, held: tuple) -> int:
        return -1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState(self.name, "held binary, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._load()
        frame = pd.concat(list(rows)).sort_values([*self.keys, *self.order])
        if "at" in frame:
            frame["at"] = pd.to_datetime(frame["at"], utc=True).dt.tz_localize(None).to_numpy("datetime64[us]").astype("int64")
        out = []
        for k, some in groupby(frame.itertuples(index=False), key=lambda r: tuple(getattr(r, c) for c in self.keys)):
            new, state = self.take(k, list(some), held.pop(k, None))
            out += new
            if state is not None:
                held[k] = state
        self._save(held, timer, timer)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, timer = self._load()
        now, out = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1), []
        for k in [k for k, s in held.items() if 0 <= self.due(s) <= now]:
            new, state = self.expire(k, held.pop(k))
            out += new
            if state is not None:
                held[k] = state
        self._save(held, timer, -1)
        yield self._frame(out)

    def _load(self) -> tuple[dict, int]:
        packed, timer = self.bucket.get() if self.bucket.exists() else (None, -1)
        return (pickle.loads(packed) if packed else {}), timer

    def _save(self, held: dict, before: int, timer: int) -> None:
        """Hold ``held`` and wait for what is due first; a timer that has gone off needs no deletion (``timer`` is -1)."""
        first = min((d for s in held.values() if (d := self.due(s)) >= 0), default=-1)
        if first != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if first >= 0:
                self.handle.registerTimer(first)
        if held:
            self.bucket.update((pickle.dumps(held), first))
        else:
            self.bucket.clear()

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=re.findall(r"(\w+) (?:array<.*?>+|\w+)(?:, |$)", self.schema))
        return frame.assign(**{c: pd.to_datetime(frame[c].astype("int64"), unit="us", utc=True) for c in self.times})

    def close(self) -> None:
        pass


def in_buckets(rows: DataFrame, step: Bucketed, time: str) -> DataFrame:
    """The rows that ``step`` makes of a stream."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*step.keys), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").transformWithStateInPandas(step, step.schema, "append", time)


@dataclass
class Open:
    """A call that goes on, or (closed) one whose late frames are ignored: first and last frame, rows sent, seconds heard, turns, probabilities of windows."""

    since: int
    last: int
    n: int = 0
    heard: float = 0.0
    closed: bool = False
    turns: list = field(default_factory=list)
    chunks: dict = field(default_factory=dict)

    def plain(self) -> tuple:
        return tuple(vars(self).values())


class LiveCall(Bucketed):
    """Snapshots of a call: one row for each turn with all turns so far in spoken order, and a final row.

    ``scorer`` gives the probabilities of windows; each different window of a call is
    given to it once.  A frame after a gap of ``idle`` seconds begins another call of
    the same id; frames after a call's end are ignored until then.
    """

    name, keys, order, schema = "call", ("call_id",), ("at", "seq"), SNAPSHOTS

    def __init__(self, scorer: Callable[[list[str]], list[float]], cut: Callable[[str], list[str]], idle: float = IDLE, longest: float = LONGEST):
        self.scorer, self.cut, self.idle, self.longest = scorer, cut, int(idle * 1000), longest

    def _probability(self, call: Open, text: str) -> tuple[float, int]:
        keys = [(hashlib.md5(w.encode()).digest(), w) for w in self.cut(text)]
        windows = dict(keys)
        new = [k for k in windows if k not in call.chunks]
        call.chunks.update(zip(new, map(float, self.scorer([windows[k] for k in new]) if new else [])))
        return top_two([call.chunks[k] for k, _ in keys]), len(new)

    def _row(self, key, call: Open, kind: str, turn=(None,) * 4, scored=(None, 0), ended=None) -> tuple:
        start, speaker, end, text = turn
        return (key[0], call.since, call.n, kind, speaker, start, end, text, [dict(zip(("start", "speaker", "end", "text"), t)) for t in call.turns], *scored, ended, call.heard)

    def _add(self, key, call: Open, turn: tuple) -> tuple:
        late = call.turns and turn[:2] < call.turns[-1][:2]  # spoken before one that came earlier
        call.turns.append(turn)
        if late:
            call.turns.sort(key=lambda t: t[:2])
        call.n += 1
        return self._row(key, call, "turn", turn, self._probability(call, " ".join(t[3] for t in call.turns)))

    def _close(self, key, call: Open, ended: str) -> tuple:
        call.n, call.closed = call.n + 1, True
        row = self._row(key, call, "final", ended=ended)
        call.turns, call.chunks = [], {}
        return row

    def take(self, key, rows, held):
        call = Open(*held) if held else None
        out = []
        for r in rows:
            at = r.at // 1000
            if call and at - call.last >= self.idle:
                out += [] if call.closed else [self._close(key, call, "IDLE_TIMEOUT")]
                call = Open(at, at)
            call = call or Open(at, at)
            if call.closed:
                continue
            call.last = max(call.last, at)
            if r.kind == "end":
                out.append(self._close(key, call, "CLIENT"))
                continue
            call.heard = max(call.heard, r.end)
            if isinstance(r.text, str) and r.text.strip():
                out.append(self._add(key, call, (r.start, r.speaker, r.end, r.text.strip())))
            if call.heard >= self.longest:
                out.append(self._close(key, call, "MAX_DURATION"))
        return out, call.plain()

    def due(self, held):
        return held[1] + self.idle

    def expire(self, key, held):
        call = Open(*held)
        return [] if call.closed else [self._close(key, call, "IDLE_TIMEOUT")], None


class LiveEvents(Bucketed):
    """What is sent out for a call's scored snapshots: transcript, risk, alert and final rows under one running number."""

    keys, order, schema = ("call_id", "since"), ("n",), EVENTS

    def take(self, key, rows, held):
        seq, alerted, *told = held or (0, 0, None, None, None, None, [])
        out, over = [], False

        def send(kind, speaker=None, at=None, text=None, fields=(None, None, None, None, []), new=(), ended=None, heard=None):
            nonlocal seq
            seq += 1
            out.append((*key, seq, kind, speaker, at, text, *fields, list(new), ended, heard))

        for r in rows:
            if r.kind == "final":
                send("final", text=" ".join(t["text"] for t in r.turns), fields=told, ended=r.ended_by, heard=r.heard)
                over = True
                continue
            send("transcript", r.speaker, r.end, r.text)
            codes = list(r.codes)
            new = [c for c in codes if c not in list(told[4])]
            told = [int(r.score), r.level, float(r.confidence), float(r.probability), codes]
            send("risk", fields=told, new=new)
            if LEVELS.index(r.level) > alerted:
                alerted, last = LEVELS.index(r.level), r.turns[-1]
                send("alert", last["speaker"], last["end"], last["text"], told)
        return out, None if over else (seq, alerted, *told)

    def _frame(self, rows):
        return super()._frame(rows).astype({"score": "Int32"})


def by_rules(snapshots: DataFrame) -> DataFrame:
    """(id, codes, severities) of snapshots (id, turns) by the rule engine, each speaker judged by their own words."""
    turns = snapshots.select("id", F.posexplode("turns").alias("turn", "t")).select("id", "turn", "t.speaker", "t.text")
    order = F.array_position(F.array(*[F.lit(c) for c in CODES]), F.col("code"))
    found = conversation(turns)[0].groupBy("id").agg(F.array_sort(F.collect_list(F.struct(order.alias("n"), "code", "severity"))).alias("x"))
    cells = lambda field: F.coalesce(F.transform("x", lambda x: x[field]), F.array().cast("array<string>"))
    return snapshots.select("id").join(found, "id", "left").select("id", cells("code").alias("codes"), cells("severity").alias("severities"))


def by_list(listed: list[tuple[str, str, str]]) -> Callable[[DataFrame], DataFrame]:
    """Indicators of a list (code, severity, piece of text): those whose piece stands in what was said, small letters alike."""
    def found(snapshots: DataFrame) -> DataFrame:
        said = F.lower(F.array_join(F.transform("turns", lambda t: t["text"]), " "))
        hit = F.array_compact(F.array(*[F.when(said.contains(piece), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, piece in listed]))
        return snapshots.select("id", F.transform(hit, lambda h: h["code"]).alias("codes"), F.transform(hit, lambda h: h["severity"]).alias("severities"))

    return found


def scored_snapshots(snapshots: DataFrame, indicators: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Snapshots with codes, score, level and confidence; final rows pass."""
    named = snapshots.withColumn("id", F.concat_ws("/", "call_id", "since", "n"))
    turns = named.where("kind = 'turn'")
    words = F.size(F.regexp_extract_all(F.array_join(F.transform("turns", lambda t: t["text"]), " "), F.lit(r"\S+"), F.lit(0)))
    rated = turns.join(indicators(turns.select("id", "turns")), "id").withColumn("r", risk(F.col("codes"), F.col("severities"), F.col("probability"), words))
    return named.join(rated.select("id", "codes", "r.score", "r.level", "r.confidence"), "id", "left").drop("id").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


SCORED = SNAPSHOTS + ", codes array<string>, score int, level string, confidence double"


def write_batches(stream: DataFrame, stage: Staging, name: str, outputs: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]], once: bool = True):
    """Run a stream whose batches go to several tables; a batch that is run again replaces its own parts.

    ``outputs`` names tables, each with its schema and what makes it of a batch.  The
    stateful work of a batch is done once: its rows are written before they are divided.
    Returns the tables' folders and the query.
    """
    base = f"{stage.base}/{name}"
    folder = {out: f"{base}/{out}" for out in outputs}
    for out, (schema, _) in outputs.items():
        stage.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder[out]}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        rows = spark.read.schema(batch.schema).parquet(f"{base}/rows/batch={number}")
        for out, (_, make) in outputs.items():
            make(rows).write.mode("overwrite").parquet(f"{folder[out]}/batch={number}")

    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/marks").foreachBatch(write).trigger(availableNow=True).start()
    if once:
        query.awaitTermination()
    return folder, query


def table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All batches of a table."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def score_calls(frames: DataFrame, stage: Staging, scorer: Callable[[list[str]], list[float]], indicators: Callable[[DataFrame], DataFrame] = by_rules,
                cut: Callable[[str], list[str]] | None = None, idle: float = IDLE, longest: float = LONGEST, late: str = "10 seconds") -> tuple[DataFrame, DataFrame]:
    """The tables of events and of scored snapshots of a stream of frames (FRAMES), run over all that is there.

    A frame is a recognised turn (kind ``turn``), or the end of a call (kind ``end``); a frame
    without a call (call_id null) only moves the time on.  Frames that come more than ``late``
    behind the newest are left out.
    """
    spark = stage.spark
    with keyed_state(spark):
        # Written with the time, the condition stays above the watermark, which frames without a call move on.
        keyed = frames.withWatermark("at", late).where(F.when(F.col("at").isNull(), False).otherwise(F.col("call_id").isNotNull()))
        shots = in_buckets(keyed, LiveCall(scorer, cut or character_windows(), idle, longest), "eventTime")
        rated, _ = write_batches(shots, stage, "calls", {"scored": (SCORED, lambda rows: scored_snapshots(rows, indicators).select(*_names(spark, SCORED)))})
        again = spark.readStream.schema(SCORED).option("recursiveFileLookup", "true").parquet(rated["scored"])
        sent = in_buckets(again, LiveEvents(), "none")
        events, _ = write_batches(sent, stage, "events", {"events": (EVENTS, lambda rows: rows)})
    return table(spark, events["events"], EVENTS), table(spark, rated["scored"], SCORED)


def _names(spark: SparkSession, schema: str) -> list[str]:
    return spark.createDataFrame([], schema).columns


#: What the registered query looks for in the turns.
LISTED = [("OTP_REQUEST", "HIGH", "then the"), ("BANK_IMPERSONATION", "LOW", "the "), ("URGENCY", "MEDIUM", "in "), ("MONEY_TRANSFER", "MEDIUM", "que la")]
#: A call of the registered query goes on for so many seconds at most.
SHORT = 14.0


def stand_in(windows: list[str]) -> list[float]:
    """A stand-in for a model: sure of windows that hold one piece of text."""
    return [0.99 if "ent" in w.lower() else 0.01 for w in windows]


def call_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as frames: every two turns come in the other order, some calls pause, some say that they end.

    One frame without a call comes a day later, so that every timer runs out.
    """
    t, c = F.col("turn"), F.col("conv_id")
    seq = t.bitwiseXOR(F.lit(1).cast("long"))
    pause = F.when((c % 7 == 0) & (seq >= 2), 600).otherwise(0)
    at = F.timestamp_seconds(F.lit(1_704_067_200) + c * 20 + seq * 5 + pause)
    turns = read_table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").select(
        c.alias("call_id"), seq.alias("seq"), at.alias("at"), F.lit("turn").alias("kind"), F.col("role").alias("speaker"), (t * 3.0).alias("start"), (t * 3.0 + 2.5).alias("end"), "text")
    last = turns.where("call_id % 3 = 0").groupBy("call_id").agg((F.max("seq") + 1).alias("seq"), (F.max("at") + F.expr("interval 5 seconds")).alias("at"))
    none = [F.lit(None).cast(k).alias(n) for n, k in (("speaker", "string"), ("start", "double"), ("end", "double"), ("text", "string"))]
    ends = last.select("call_id", "seq", "at", F.lit("end").alias("kind"), *none)
    tick = turns.agg(F.max("at").alias("at")).select(F.lit(None).cast("long").alias("call_id"), F.lit(0).cast("long").alias("seq"),
                                                     (F.col("at") + F.expr("interval 1 day")).alias("at"), F.lit("tick").alias("kind"), *none).where("at is not null")
    return turns.unionByName(ends).unionByName(tick)


def as_stream(frames: DataFrame, stage: Staging, name: str) -> DataFrame:
    """A stored table read as a stream."""
    stored = stage.save(frames, name)
    return stage.spark.readStream.schema(stored.schema).parquet(stored._staged_path)


def live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is sent out while the conversations go on as live calls."""
    stage = Staging(spark)
    events, _ = score_calls(as_stream(call_frames(spark, sf_dir), stage, "frames"), stage, stand_in, by_list(LISTED), longest=SHORT)
    return events.select("call_id", "since", "seq", "type", "speaker", "at_seconds", "text", "score", "level", F.round("confidence", 6).alias("confidence"),
                         F.round("probability", 6).alias("probability"), F.array_join("codes", ",").alias("codes"), F.array_join("new_codes", ",").alias("new_codes"), "ended_by", "duration")


def window_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many turns a call had, and how many windows were given to the scorer for them."""
    stage = Staging(spark)
    _, shots = score_calls(as_stream(call_frames(spark, sf_dir), stage, "frames"), stage, stand_in, by_list(LISTED), longest=SHORT)
    return shots.where("kind = 'turn'").groupBy("call_id", "since").agg(F.count(F.lit(1)).alias("turns"), F.sum("scored").alias("scored"))


QUERIES = {"live_events": live_events, "window_calls": window_calls}

FRAMES_SQL = """
WITH f AS (SELECT conv_id AS call_id, xor(turn, 1) AS a, conv_id % 7 = 0 AND xor(turn, 1) >= 2 AS paused, role AS speaker, turn * 3.0::DOUBLE AS start, turn * 3.0::DOUBLE + 2.5 AS stop,
    regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
h AS (SELECT *, 1000 * (1704067200 + call_id * 20 + min(a) OVER p * 5 + CASE WHEN paused AND min(a) OVER p >= 2 THEN 600 ELSE 0 END) AS since,
    coalesce(max(stop) OVER (PARTITION BY call_id, paused ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heard FROM f WINDOW p AS (PARTITION BY call_id, paused)),
k AS (SELECT *, row_number() OVER (PARTITION BY call_id, paused ORDER BY a) AS n FROM h WHERE heard < 14 AND text <> ''),
s AS (SELECT k.call_id, k.since, k.n, string_agg(j.text, ' ' ORDER BY j.start, j.speaker) AS said, max_by(j.speaker, (j.start, j.speaker)) AS last_speaker,
    max_by(j.stop, (j.start, j.speaker)) AS last_stop, max_by(j.text, (j.start, j.speaker)) AS last_text FROM k JOIN k j ON j.call_id = k.call_id AND j.since = k.since AND j.n <= k.n GROUP BY ALL),
w AS (SELECT call_id, since, n, said[i + 1:i + 40] AS piece FROM (SELECT *, unnest(range(0, greatest(1, length(said)), 40)) AS i FROM s)),
"""
ORACLES = {
    "window_calls": FRAMES_SQL + "x AS (SELECT call_id, since, count(DISTINCT piece) AS scored FROM w GROUP BY ALL) SELECT call_id, since, max(n) AS turns, any_value(scored) AS scored FROM s JOIN x USING (call_id, since) GROUP BY ALL",
    "live_events": FRAMES_SQL + """p AS (SELECT call_id, since, n, list_avg(list_reverse_sort(list(CASE WHEN contains(lower(piece), 'ent') THEN 0.99 ELSE 0.01 END::DOUBLE))[1:2]) AS p FROM w GROUP BY ALL),
i AS (SELECT s.*, p, list_filter([CASE WHEN contains(lower(said), 'then the') THEN 'OTP_REQUEST' END, CASE WHEN contains(lower(said), 'the ') THEN 'BANK_IMPERSONATION' END,
    CASE WHEN contains(lower(said), 'in ') THEN 'URGENCY' END, CASE WHEN contains(lower(said), 'que la') THEN 'MONEY_TRANSFER' END], lambda x: x IS NOT NULL) AS codes,
    len(regexp_extract_all(said, '\\S+')) AS words FROM s JOIN p USING (call_id, since, n)),
e AS (SELECT *, least(35, 15 * list_contains(codes, 'OTP_REQUEST')::INT + 3 * list_contains(codes, 'BANK_IMPERSONATION')::INT + 8 * list_contains(codes, 'URGENCY')::INT + 8 * list_contains(codes, 'MONEY_TRANSFER')::INT
    + CASE WHEN list_contains(codes, 'BANK_IMPERSONATION') AND list_has_any(codes, ['OTP_REQUEST', 'MONEY_TRANSFER']) THEN 25 ELSE 0 END)
    + CASE WHEN list_contains(codes, 'OTP_REQUEST') THEN 20 WHEN list_has_any(codes, ['URGENCY', 'MONEY_TRANSFER']) THEN 8 WHEN len(codes) > 0 THEN 3 ELSE 0 END AS evidence FROM i),
g AS (SELECT *, round_even(least(100.0, p * 70 + evidence), 0)::INT AS whole FROM e),
c AS (SELECT *, words < 45 AND whole >= 60 AND evidence < 17 AS capped, 0.5 * abs(2 * p - 1) + 0.5 * CASE WHEN evidence >= 30 THEN (p >= 0.5)::INT::DOUBLE WHEN evidence = 0 THEN CASE WHEN p >= 0.5 THEN 0.5 ELSE 1 END ELSE 0.75 END AS sure FROM g),
r AS (SELECT *, CASE WHEN score >= 60 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN score >= 60 THEN 2 WHEN score >= 30 THEN 1 ELSE 0 END AS rank,
    CASE WHEN capped THEN least(sure, 0.5) ELSE sure END AS confidence FROM (SELECT *, CASE WHEN capped THEN 59 ELSE whole END AS score FROM c)),
a AS (SELECT *, coalesce(max(rank) OVER b, 0) AS before, coalesce(lag(codes) OVER (PARTITION BY call_id, since ORDER BY n), []) AS old FROM r
    WINDOW b AS (PARTITION BY call_id, since ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT call_id, since, max(stop) AS duration, max(a) AS a FROM k GROUP BY ALL),
o AS (
  SELECT call_id, since, n, 1 AS o, 'transcript' AS type, speaker, stop AS at_seconds, text, NULL::INT AS score, NULL AS level, NULL::DOUBLE AS confidence, NULL::DOUBLE AS probability, '' AS codes, '' AS new_codes, NULL AS ended_by, NULL::DOUBLE AS duration FROM k
  UNION ALL SELECT call_id, since, n, 2, 'risk', NULL, NULL, NULL, score, level, round(confidence, 6), round(p, 6), array_to_string(codes, ','), array_to_string(list_filter(codes, lambda x: NOT list_contains(old, x)), ','), NULL, NULL FROM a
  UNION ALL SELECT call_id, since, n, 3, 'alert', last_speaker, last_stop, last_text, score, level, round(confidence, 6), round(p, 6), array_to_string(codes, ','), '', NULL, NULL FROM a WHERE rank > before
  UNION ALL SELECT call_id, since, n, 4, 'final', NULL, NULL, said, score, level, round(confidence, 6), round(p, 6), array_to_string(codes, ','), '',
    CASE WHEN z.duration >= 14 THEN 'MAX_DURATION' WHEN call_id % 3 = 0 AND since = max(since) OVER (PARTITION BY call_id) THEN 'CLIENT' ELSE 'IDLE_TIMEOUT' END, z.duration
    FROM (SELECT * FROM a QUALIFY n = max(n) OVER (PARTITION BY call_id, since)) JOIN z USING (call_id, since))
SELECT call_id, since, row_number() OVER (PARTITION BY call_id, since ORDER BY n, o) AS seq, type, speaker, at_seconds, text, score, level, confidence, probability, codes, new_codes, ended_by, duration FROM o""",
}
