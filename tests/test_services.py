"""Protocol guard, tickets and notifications in several batches, and after a restart."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ringwarden.staging import Staging
from ringwarden.streaming import services, sessions

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def batches(spark, stage, name, schema, parts):
    folder = f"{stage.base}/{name}"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={i}")
        local = f"{folder}/part={i}".removeprefix("file://")
        for file in os.listdir(local):
            os.utime(f"{local}/{file}", (1_700_000_000 + 10 * i,) * 2)
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


FRAME = "call_id long, seq long, at timestamp, data binary, message string"


def test_frame_faults(spark):
    cases = [(b"\x00\x01\x02", None, None), (b"\x01", None, None), (b"", None, "INVALID_AUDIO_FRAME"), (b"\x02\x01\x02", None, "INVALID_AUDIO_FRAME"), (b"\x00\x01", None, "INVALID_AUDIO_FRAME"),
             (b"\x00" * (2**20 + 1), None, "AUDIO_FRAME_TOO_LARGE"), (b"\x00" * (2**20 - 1), None, None), (None, '{"type": "end"}', None), (None, '{"type": "start"}', None),
             (None, '{"type": "start", "customPatterns": ["a b"]}', None), (None, '{"type": "start", "customPatterns": "a"}', "INVALID_CUSTOM_PATTERNS"),
             (None, '{"type": "start", "customPatterns": [" "]}', "INVALID_CUSTOM_PATTERNS"), (None, '{"type": "start", "customPatterns": [%s]}' % ",".join(['"a"'] * 501), "INVALID_CUSTOM_PATTERNS"),
             (None, "{", "INVALID_MESSAGE"), (None, "[]", "INVALID_MESSAGE"), (None, '{"type": "stop"}', "INVALID_MESSAGE"), (None, None, "INVALID_MESSAGE"), (None, "", "INVALID_MESSAGE")]
    df = spark.createDataFrame([(i, d, m) for i, (d, m, _) in enumerate(cases)], "i int, data binary, message string")
    got = {r.i: r.f for r in df.select("i", services.frame_fault(F.col("data"), F.col("message")).alias("f")).collect()}
    assert [got[i] for i in range(len(cases))] == [f for _, _, f in cases]


def test_guard_and_restart(spark):
    sound, start, end = b"\x00\x01\x02", '{"type": "start"}', '{"type": "end"}'
    first = [(1, 0, at(0), None, start), (1, 1, at(1), sound, None), (2, 0, at(0), sound, None), (3, 0, at(0), b"\x07", None), (4, 0, at(0), None, end)]
    second = [(1, 2, at(2), None, start), (1, 3, at(3), sound, None), (2, 1, at(2), sound, None), (3, 1, at(2), sound, None), (4, 1, at(3), sound, None), (None, 0, at(900), None, None)]
    stage = Staging(spark)
    services.guard_frames(batches(spark, stage, "in", FRAME, [first]), stage)
    again = batches(spark, stage, "in2", FRAME, [second])  # the same marks, so the state goes on
    spark.createDataFrame(second, FRAME).coalesce(1).write.parquet(f"{stage.base}/in/part=9")
    del again
    stream = spark.readStream.schema(FRAME).option("recursiveFileLookup", "true").parquet(f"{stage.base}/in")
    for _ in range(2):  # nothing is new the second time
        good, errors = services.guard_frames(stream, stage)
    assert sorted((r.call_id, r.seq) for r in good.collect()) == [(1, 0), (1, 1), (2, 0), (2, 1), (4, 0)]
    assert sorted((r.call_id, r.seq, r.fault) for r in errors.collect()) == [(1, 2, "INVALID_MESSAGE"), (1, 3, "SESSION_OVER"), (3, 0, "INVALID_AUDIO_FRAME"), (3, 1, "SESSION_OVER"), (4, 1, "SESSION_OVER")]


def test_tickets(spark):
    rows = "ticket long, seq long, at timestamp, kind string"
    parts = [[(1, 0, at(0), "issue"), (2, 0, at(0), "issue"), (3, 0, at(0), "issue"), (4, 0, at(5), "issue")], [(1, 1, at(59), "use"), (1, 2, at(59), "use"), (2, 1, at(60), "use"), (9, 1, at(50), "use")],
             [(4, 1, at(30), "use"), (None, 0, at(500), "tick")]]
    stage = Staging(spark)
    out = services.use_tickets(batches(spark, stage, "in", rows, parts), stage, late="60 seconds")
    got = sorted((r.ticket, r.kind, int(r.at.timestamp() - T0.timestamp()), r.outcome) for r in out.select("ticket", "kind", "at", "outcome").collect() if r.kind != "issue")
    assert got == [(1, "use", 59, "ACCEPTED"), (1, "use", 59, "REJECTED"), (2, "expired", 60, "ANALYSIS_FAILED"), (2, "use", 60, "REJECTED"), (3, "expired", 60, "ANALYSIS_FAILED"),
                   (4, "use", 30, "ACCEPTED"), (9, "use", 50, "REJECTED")]


def test_fan_out(spark):
    call, done = "id long, user_id long, caller_number string, at timestamp", "call_id long, at timestamp, level string, score int"
    day = 86_400
    stage = Staging(spark)
    calls = batches(spark, stage, "calls", call, [[(1, 10, "+1", at(0)), (2, 11, "+1", at(0)), (3, 10, None, at(0)), (4, 10, "+2", at(0))], [(5, 10, "+3", at(day)), (None, None, None, at(90 * day))]])
    finished = batches(spark, stage, "done", done, [[(1, at(5), "HIGH", 90), (2, at(5), "LOW", 3), (3, at(31 * day), "HIGH", 80), (8, at(9), "MEDIUM", 40)], [(5, at(day), "MEDIUM", 50), (4, at(-5), "HIGH", 70), (None, at(90 * day), None, None)]])
    listed = spark.createDataFrame([("+1",), ("+1",)], "phone_number string")
    notes, missing = services.fan_out(calls, finished, listed, spark.createDataFrame([(10,)], "user_id long"), stage, late="40 days")
    assert sorted((r.call_id, r.user_id, r.kind) for r in notes.collect()) == [(1, 10, "BLACKLISTED_CALLER"), (1, 10, "HIGH_RISK_CALL"), (5, 10, "SUSPICIOUS_CALL")]
    assert sorted((r.call_id, r.user_id, r.score) for r in missing.collect()) == [(3, None, 80), (4, None, 70), (8, None, 40)]


def test_tickets_share_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(sessions, "BUCKETS", 1)
    stage, n = Staging(spark), 50
    rows = [(i, 0, at(i % 3), "issue") for i in range(n)] + [(i, 1, at(10), "use") for i in range(0, n, 2)]
    out = services.use_tickets(batches(spark, stage, "in", "ticket long, seq long, at timestamp, kind string", [rows]), stage)
    assert {(r.ticket, r.outcome) for r in out.where("kind = 'use'").collect()} == {(i, "ACCEPTED") for i in range(0, n, 2)}
    with sessions.keyed_state(spark):
        assert spark.read.format("statestore").option("stateVarName", "held").load(f"{stage.base}/tickets/marks").count() == 1
