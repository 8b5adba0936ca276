"""Live calls with Structured Streaming: utterances, alerts, windows.

State is small by design: of the audio a segmenter keeps only counters and the
bytes of a started frame, never the samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ringwarden.staging import Staging

#: 16 kHz mono, frames of 20 ms; speech from RMS 300; an utterance ends after 700 ms of silence or 15 s.
FRAME = 320
FRAME_SECONDS = 0.02
THRESHOLD = 300.0
END_SILENCE, MOST, LEAST_SPEECH, PRE_ROLL, TAIL = 35, 750, 10, 10, 10


@dataclass
class Segment:
    """Where a speaker's stream stands: frames seen, the open utterance (begin < 0: none), bytes of a started frame."""

    seen: int = 0
    quiet: int = 0
    begin: int = -1
    speech: int = 0
    last: int = -1
    rest: bytes = b""

    def take(self, pcm: bytes) -> list[tuple[float, float]]:
        """The utterances (start, end in seconds) that a packet completes."""
        data = self.rest + pcm
        whole = len(data) // (2 * FRAME)
        self.rest = data[whole * 2 * FRAME:]
        frames = np.frombuffer(data[: whole * 2 * FRAME], "<i2").reshape(whole, FRAME).astype(np.float32)
        loud = np.sqrt((frames ** 2).mean(axis=1)) >= THRESHOLD if whole else []
        return [u for x in loud if (u := self._frame(bool(x)))]

    def _frame(self, loud: bool) -> tuple[float, float] | None:
        at = self.seen
        self.seen += 1
        if self.begin < 0:
            if loud:
                self.begin, self.speech, self.last = at - self.quiet, 1, at
            self.quiet = 0 if loud else min(PRE_ROLL, self.quiet + 1)
            return None
        if loud:
            self.speech, self.last = self.speech + 1, at
        if at - self.last >= END_SILENCE:
            return self._end(min(at + 1, self.last + 1 + TAIL))
        return self._end(at + 1) if at + 1 - self.begin >= MOST else None

    def _end(self, stop: int) -> tuple[float, float] | None:
        begin, enough, self.begin, self.quiet = self.begin, self.speech >= LEAST_SPEECH, -1, 0
        return (round(begin * FRAME_SECONDS, 2), round(stop * FRAME_SECONDS, 2)) if enough else None

    def finish(self) -> list[tuple[float, float]]:
        """The open utterance at the end of the stream, if it is long enough."""
        if self.begin < 0:
            return []
        found = self._end(min(self.seen, self.last + 1 + TAIL))
        return [found] if found else []


def utterances(packets: DataFrame) -> DataFrame:
    """(call_id, speaker, start, end) from a stream of packets (call_id, speaker, seq, pcm, last).

    Within a batch the packets of a speaker are taken in order of ``seq``; a
    packet with ``last`` closes the open utterance.  How audio is cut into packets
    does not matter.
    """
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        segment = Segment(*state.get) if state.exists else Segment()
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for pcm, last in zip(rows["pcm"], rows["last"]):
            out += segment.take(bytes(pcm) if pcm is not None else b"")
            out += segment.finish() if last else []
        state.update(astuple(segment))
        yield pd.DataFrame({"call_id": key[0], "speaker": key[1], "start": [a for a, _ in out], "end": [b for _, b in out]})

    return packets.groupBy("call_id", "speaker").applyInPandasWithState(
        step, "call_id string, speaker string, start double, end double", "seen long, quiet long, begin long, speech long, last long, rest binary",
        "append", GroupStateTimeout.NoTimeout)


def alerts_once(levels: DataFrame) -> DataFrame:
    """(call_id, at, level) where the level of a stream (call_id, at, seq, level) rises above all levels before it."""
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        most = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        before = np.maximum.accumulate(np.concatenate([[most], rows["level"].to_numpy()]))
        state.update((int(before[-1]),))
        yield rows[rows["level"].to_numpy() > before[:-1]][["call_id", "at", "level"]]

    return levels.groupBy("call_id").applyInPandasWithState(step, "call_id long, at timestamp, level int", "most int", "append", GroupStateTimeout.NoTimeout)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with event time ``at``."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path + "*")
    return raw.withColumn("at", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str, stage: Staging, name: str) -> DataFrame:
    """Run a stream over all that is there and return what it wrote; every batch replaces its own part if it is run again."""
    out, marks = f"{stage.base}/{name}", f"{stage.base}/{name}-checkpoint"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return stage.spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def value_level(value: Column) -> Column:
    """0, 1 or 2 for event values below 5, below 20 and from 20."""
    return F.when(value >= 20, 2).when(value >= 5, 1).otherwise(0)


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of all event streams, one for each rise of a user's level."""
    levels = event_stream(spark, sf_dir).select(F.col("user_id").alias("call_id"), "at", F.col("event_id").alias("seq"), value_level(F.col("value")).alias("level"))
    return drain(alerts_once(levels), "append", Staging(spark), "alerts").withColumn("at", F.col("at").cast("timestamp_ntz"))


def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type; events more than ten minutes late are left out."""
    hours = (event_stream(spark, sf_dir).withWatermark("at", "10 minutes").groupBy(F.window("at", "1 hour").alias("w"), "event_type")
             .agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value")))
    out = drain(hours.select(F.col("w.start").alias("hour"), "event_type", "events", "value"), "complete", Staging(spark), "hours")
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


QUERIES = {"stream_alerts": stream_alerts, "stream_hours": stream_hours}
ORACLES = {
    "stream_alerts": """SELECT call_id, "at", level FROM (SELECT user_id AS call_id, ts AS "at", level,
coalesce(max(level) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM (SELECT *, CASE WHEN value >= 20 THEN 2 WHEN value >= 5 THEN 1 ELSE 0 END AS level FROM events)) WHERE level > before""",
    "stream_hours": """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""",
}
