"""Streams around a call: frames that break the protocol, tickets that are used once or expire, and what users are told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwarden.session import read_table
from ringwarden.sources import domain
from ringwarden.staging import Staging
from ringwarden.streaming.sessions import Bucketed, as_stream, in_buckets, keyed_state, table, write_batches

#: Fixed values of the protocol: bytes of a binary frame, patterns of a start message, seconds that a ticket holds.
MOST_BYTES = 1 << 20
MOST_PATTERNS = 500
TICKET_SECONDS = 60
MESSAGE = "type string, customPatterns array<string>"


def frame_fault(data: Column, message: Column) -> Column:
    """What is wrong with a frame by itself, null if nothing is: a binary frame (speaker 0 or 1, then 16-bit samples) or a text message."""
    n, first = F.octet_length(data), F.hex(F.substring(data, 1, 1))
    said = F.from_json(message, MESSAGE)
    listed = F.get_json_object(message, "$.customPatterns")
    binary = (F.when(n > MOST_BYTES, "AUDIO_FRAME_TOO_LARGE").when((n == 0) | ~first.isin("00", "01"), "INVALID_AUDIO_FRAME")
              .when((n - 1) % 2 != 0, "INVALID_AUDIO_FRAME"))
    patterns = listed.isNotNull() & (~listed.startswith("[") | F.exists(F.coalesce(said["customPatterns"], F.array().cast("array<string>")), lambda p: p.isNull() | (F.trim(p) == ""))
                                     | (F.size(said["customPatterns"]) > MOST_PATTERNS))
    kind = said["type"]
    text = F.when(kind == "end", None).when((kind == "start") & patterns, "INVALID_CUSTOM_PATTERNS").when(kind == "start", None).otherwise("INVALID_MESSAGE")
    return F.when(data.isNotNull(), binary).otherwise(text)


GUARDED = "call_id long, seq long, at timestamp, binary boolean, bytes long, message string, fault string"


class ProtocolGuard(Bucketed):
    """Adds what only the frames before tell: a start after sound is a fault, and after a fault or the end no frame is taken."""

    keys, order, schema, times = ("call_id",), ("at", "seq"), GUARDED, ("at",)

    def __init__(self, idle: float):
        self.idle = int(idle * 1000)

    def take(self, key, rows, held):
        sound, over, due = held or (False, False, -1)
        out = []
        for r in rows:
            fault = r.fault if isinstance(r.fault, str) else None
            if over:
                fault = "SESSION_OVER"
            elif fault is None and not r.binary and r.start and sound:
                fault = "INVALID_MESSAGE"
            over = over or fault is not None or bool(r.end)
            sound = sound or bool(r.binary and fault is None and r.bytes > 1)
            out.append((*key, r.seq, r.at, r.binary, r.bytes, r.message, fault))
        return out, (sound, over, max(due, rows[-1].at // 1000 + self.idle))

    def due(self, held):
        return held[2]

    def expire(self, key, held):
        return [], None


def guard_frames(frames: DataFrame, stage: Staging, idle: float = 30, late: str = "10 seconds") -> tuple[DataFrame, DataFrame]:
    """(frames that were taken, frames that were not, each with its fault) of a stream (call_id, seq, at, data, message).

    Every frame with a call and a time is in one of the tables, once, also after a
    restart: a batch that is run again replaces its own parts.
    """
    spark = stage.spark
    kind = F.from_json("message", MESSAGE)["type"]
    with keyed_state(spark):
        told = frames.withWatermark("at", late).where(F.when(F.col("at").isNull(), False).otherwise(F.col("call_id").isNotNull())).select(
            "call_id", "seq", "at", F.col("data").isNotNull().alias("binary"), F.octet_length("data").cast("long").alias("bytes"), "message",
            F.coalesce(kind == "start", F.lit(False)).alias("start"), F.coalesce(kind == "end", F.lit(False)).alias("end"), frame_fault(F.col("data"), F.col("message")).alias("fault"))
        rows = in_buckets(told, ProtocolGuard(idle), "eventTime")
        folder, _ = write_batches(rows, stage, "guard", {"good": (GUARDED, lambda r: r.where("fault is null")), "errors": (GUARDED, lambda r: r.where("fault is not null"))})
    return table(spark, folder["good"], GUARDED), table(spark, folder["errors"], GUARDED)


def protocol_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as frames: a message for some turns, else a speaker's byte and the text's bytes; some of them are wrong."""
    c, t = F.col("conv_id"), F.col("turn")
    message = (F.when((t == 0) & (c % 5 == 0), '{"type": "start", "customPatterns": ["a"]}').when((t == 0) & (c % 5 == 1), '{"type": "start", "customPatterns": "a"}')
               .when((t == 2) & (c % 5 == 2), '{"type": "start"}').when((t == 3) & (c % 5 == 3), '{"type": "end"}').when((t == 4) & (c % 5 == 4), "no message"))
    mark = F.when(F.col("role") == "system", F.unhex(F.lit("02"))).when(F.col("role") == "user", F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01")))
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    even = F.substring(body, F.lit(1), F.when(c % 4 == 0, F.octet_length(body)).otherwise((F.octet_length(body) / 2).cast("int") * 2))
    rows = read_table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").select(
        c.alias("call_id"), t.alias("seq"), F.timestamp_seconds(F.lit(1_704_067_200) + c * 3 + t).alias("at"), F.when(message.isNull(), F.concat(mark, even)).alias("data"), message.alias("message"))
    return rows


def guarded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of the conversations with its fault, null if it was taken."""
    stage = Staging(spark)
    good, errors = guard_frames(as_stream(protocol_frames(spark, sf_dir), stage, "frames"), stage)
    return good.unionByName(errors).select("call_id", "seq", "binary", "bytes", "fault")


TICKETS = "ticket long, kind string, at timestamp, outcome string"


class Tickets(Bucketed):
    """A ticket is issued, used once before it expires, or expires unused by a timer."""

    keys, order, schema, times = ("ticket",), ("at", "seq"), TICKETS, ("at",)

    def __init__(self, seconds: float):
        self.life = int(seconds * 1000)

    def take(self, key, rows, held):
        expires = held[0] if held else None
        out = []
        for r in rows:
            at = r.at // 1000
            if expires is not None and at >= expires:
                out += self.expire(key, (expires,))[0]
                expires = None
            if r.kind == "issue":
                expires = at + self.life
                out.append((*key, "issue", r.at, "ISSUED"))
            else:
                out.append((*key, "use", r.at, "REJECTED" if expires is None else "ACCEPTED"))
                expires = None
        return out, None if expires is None else (expires,)

    def due(self, held):
        return held[0]

    def expire(self, key, held):
        return [(*key, "expired", held[0] * 1000, "ANALYSIS_FAILED")], None


def use_tickets(requests: DataFrame, stage: Staging, seconds: float = TICKET_SECONDS, late: str = "10 seconds") -> DataFrame:
    """(ticket, kind, at, outcome) of a stream (ticket, seq, at, kind: issue or use).

    A use is ACCEPTED if it is the first one and comes less than ``seconds`` after the issue, else
    REJECTED; a ticket that no use came for in time gives a row ``expired`` at
    that time, and the analysis of its call has failed.  Rows without a ticket only move the time on.
    """
    with keyed_state(stage.spark):
        keyed = requests.withWatermark("at", late).where(F.when(F.col("at").isNull(), False).otherwise(F.col("ticket").isNotNull()))
        rows = in_buckets(keyed, Tickets(seconds), "eventTime")
        folder, _ = write_batches(rows, stage, "tickets", {"outcomes": (TICKETS, lambda r: r)})
    return table(stage.spark, folder["outcomes"], TICKETS)


def ticket_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets of live calls: a call's line items are attempts, as many seconds after it as pieces were ordered, doubled."""
    calls = domain.call_records(spark, sf_dir).where("source = 'LIVE'").select(F.col("id").alias("ticket"), F.lit(0).cast("long").alias("seq"), F.col("created_at").cast("timestamp").alias("at"), F.lit("issue").alias("kind"))
    tries = read_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("ticket"), F.col("l_linenumber").cast("long").alias("seq"), (F.col("l_quantity") * 2).cast("int").alias("after"))
    uses = tries.join(calls.select("ticket", "at"), "ticket").select("ticket", "seq", F.timestamp_seconds(F.unix_timestamp("at") + F.col("after")).alias("at"), F.lit("use").alias("kind"))
    tick = calls.agg(F.max("at").alias("at")).where("at is not null").select(F.lit(None).cast("long").alias("ticket"), F.lit(0).cast("long").alias("seq"), (F.col("at") + F.expr("interval 1 day")).alias("at"), F.lit("tick").alias("kind"))
    stage = Staging(spark)
    out = use_tickets(as_stream(calls.unionByName(uses).unionByName(tick), stage, "requests"), stage)
    return out.select("ticket", "kind", F.col("at").cast("timestamp_ntz").alias("at"), "outcome")


NOTES = "call_id long, user_id long, kind string, at timestamp, score int"


def fan_out(calls: DataFrame, completed: DataFrame, blacklist: DataFrame, alerted: DataFrame, stage: Staging, within: str = "30 days", late: str = "10 seconds") -> tuple[DataFrame, DataFrame]:
    """(notifications, completed analyses without a call) of two streams.

    ``calls`` is (id, user_id, caller_number, at), ``completed`` (call_id, at, level, score).
    A call from a number of ``blacklist`` (phone_number) tells its user if they are one of
    ``alerted`` (user_id): BLACKLISTED_CALLER.  An analysis above LOW that is
    completed no more than ``within`` after its call tells the call's user: HIGH_RISK_CALL or
    SUSPICIOUS_CALL; without such a call it is a row of the second table.  Rows without
    an id only move the time on; ids are not negative.
    """
    spark = stage.spark
    made = calls.withWatermark("at", late).select(F.col("id").alias("call_id"), "user_id", "caller_number", "at")
    known = made.where("caller_number is not null").join(blacklist.distinct(), F.col("caller_number") == F.col("phone_number")).join(alerted.distinct(), "user_id", "left_semi")
    warned = known.select("call_id", "user_id", F.lit("BLACKLISTED_CALLER").alias("kind"), "at", F.lit(None).cast("int").alias("score"))
    folder, _ = write_batches(warned, stage, "blacklisted", {"notes": (NOTES, lambda r: r)})
    # Rows without an id must pass the join's filters to move the watermark on; the two stand-ins never meet.
    made = made.withColumn("call_id", F.coalesce("call_id", F.lit(-1)))
    done = completed.withColumn("call_id", F.coalesce("call_id", F.lit(-2))).withWatermark("at", late).where(F.when(F.col("at").isNull(), False).otherwise(F.col("level").isNull() | (F.col("level") != "LOW")))
    pair = done.alias("d").join(made.alias("c"), F.expr(f"d.call_id = c.call_id and d.at >= c.at and d.at <= c.at + interval {within}"), "left_outer")
    kind = F.when(F.col("c.call_id").isNull(), "NO_CALL").when(F.col("d.level") == "HIGH", "HIGH_RISK_CALL").otherwise("SUSPICIOUS_CALL")
    told = pair.select("d.call_id", "c.user_id", kind.alias("kind"), F.col("d.at").alias("at"), "d.score")
    real = F.col("call_id") != -2
    more, _ = write_batches(told, stage, "completed", {"notes": (NOTES, lambda r: r.where("kind <> 'NO_CALL'")), "unmatched": (NOTES, lambda r: r.where((F.col("kind") == "NO_CALL") & real))})
    return table(spark, folder["notes"], NOTES).unionByName(table(spark, more["notes"], NOTES)), table(spark, more["unmatched"], NOTES)


def notifications_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users are told of all calls and analyses, and analyses that no call was found for in time."""
    at = F.col("created_at").cast("timestamp").alias("at")
    calls = domain.call_records(spark, sf_dir).select("id", "user_id", "caller_number", at)
    done = domain.analyses(spark, sf_dir).where("status = 'COMPLETED'").select("call_id", at, F.col("risk_level").alias("level"), F.col("risk_score").alias("score"))
    tick = calls.select("at").unionByName(done.select("at")).agg((F.max("at") + F.expr("interval 200 days")).alias("at")).where("at is not null")
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    calls = calls.unionByName(tick.select(no("long", "id"), no("long", "user_id"), no("string", "caller_number"), "at"))
    done = done.unionByName(tick.select(no("long", "call_id"), "at", no("string", "level"), no("int", "score")))
    stage = Staging(spark)
    listed = domain.blacklist_numbers(spark, sf_dir).where("active").select("phone_number")
    alerted = domain.users(spark, sf_dir).where("status = 'ACTIVE'").select(F.col("id").alias("user_id"))
    notes, unmatched = fan_out(as_stream(calls, stage, "calls"), as_stream(done, stage, "done"), listed, alerted, stage)
    return notes.unionByName(unmatched).select("call_id", "user_id", "kind", F.col("at").cast("timestamp_ntz").alias("at"), "score")


QUERIES = {"guarded_frames": guarded_frames, "ticket_outcomes": ticket_outcomes, "notifications_sent": notifications_sent}
ORACLES = {
    "guarded_frames": """WITH m AS (SELECT conv_id, turn, role, octet_length(encode(coalesce(text, ''))) AS size, CASE WHEN turn = 0 AND conv_id % 5 = 0 THEN 'start' WHEN turn = 0 AND conv_id % 5 = 1 THEN 'patterns'
  WHEN turn = 2 AND conv_id % 5 = 2 THEN 'start' WHEN turn = 3 AND conv_id % 5 = 3 THEN 'end' WHEN turn = 4 AND conv_id % 5 = 4 THEN 'wrong' END AS message FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
b AS (SELECT *, message IS NULL AS "binary", CASE WHEN message IS NULL THEN 1 + CASE WHEN conv_id % 4 = 0 THEN size ELSE size // 2 * 2 END END AS bytes FROM m),
a AS (SELECT *, CASE WHEN "binary" THEN CASE WHEN bytes > 1048576 THEN 'AUDIO_FRAME_TOO_LARGE' WHEN role = 'system' OR bytes % 2 = 0 THEN 'INVALID_AUDIO_FRAME' END
  WHEN message = 'patterns' THEN 'INVALID_CUSTOM_PATTERNS' WHEN message = 'wrong' THEN 'INVALID_MESSAGE' END AS own FROM b),
s AS (SELECT *, CASE WHEN own IS NULL AND message = 'start' AND coalesce(bool_or("binary" AND own IS NULL AND bytes > 1) OVER w, false) THEN 'INVALID_MESSAGE' ELSE own END AS fault FROM a
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id AS call_id, turn AS seq, "binary", bytes, CASE WHEN coalesce(bool_or(fault IS NOT NULL OR message = 'end') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
  THEN 'SESSION_OVER' ELSE fault END AS fault FROM s""",
    "ticket_outcomes": """WITH c AS (SELECT o_orderkey AS ticket, o_orderdate AS "at" FROM orders WHERE o_orderkey % 3 = 2),
u AS (SELECT ticket, c."at" + to_seconds(CAST(l_quantity * 2 AS INTEGER)) AS used, row_number() OVER (PARTITION BY ticket ORDER BY l_quantity, l_linenumber) AS n, CAST(l_quantity * 2 AS INTEGER) < 60 AS early
  FROM c JOIN lineitem ON l_orderkey = ticket WHERE l_returnflag = 'R')
SELECT ticket, 'issue' AS kind, "at", 'ISSUED' AS outcome FROM c
UNION ALL SELECT ticket, 'use', used, CASE WHEN n = 1 AND early THEN 'ACCEPTED' ELSE 'REJECTED' END FROM u
UNION ALL SELECT ticket, 'expired', "at" + INTERVAL 60 SECONDS, 'ANALYSIS_FAILED' FROM c WHERE ticket NOT IN (SELECT ticket FROM u WHERE early)""",
    "notifications_sent": domain.PRELUDE + """SELECT c.id AS call_id, user_id, 'BLACKLISTED_CALLER' AS kind, c.created_at AS "at", NULL::INT AS score FROM call_records c JOIN blacklist_numbers b ON b.phone_number = caller_number AND b.active JOIN users u ON u.id = user_id AND u.status = 'ACTIVE'
UNION ALL SELECT a.call_id, c.user_id, CASE WHEN c.id IS NULL THEN 'NO_CALL' WHEN risk_level = 'HIGH' THEN 'HIGH_RISK_CALL' ELSE 'SUSPICIOUS_CALL' END, a.created_at, risk_score
FROM analyses a LEFT JOIN call_records c ON c.id = a.call_id AND a.created_at BETWEEN c.created_at AND c.created_at + INTERVAL 30 DAYS WHERE status = 'COMPLETED' AND risk_level <> 'LOW'""",
}
