"""Live calls in several batches: order of speech, alerts, the end of a call, what the state keeps."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ringwarden.staging import Staging
from ringwarden.streaming import sessions

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def turn(call, seq, at, speaker, start, text, length=1.0):
    return (call, seq, T0 + dt.timedelta(seconds=at), "turn", speaker, float(start), float(start + length), text)


def end(call, seq, at):
    return (call, seq, T0 + dt.timedelta(seconds=at), "end", None, None, None, None)


def tick(at):
    return (None, 0, T0 + dt.timedelta(seconds=at), "tick", None, None, None, None)


def batches(spark, stage, parts):
    """A stream that gives the parts one after another."""
    folder = f"{stage.base}/in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, sessions.FRAMES).coalesce(1).write.parquet(f"{folder}/part={i}")
        local = f"{folder}/part={i}".removeprefix("file://")
        for name in os.listdir(local):
            os.utime(f"{local}/{name}", (1_700_000_000 + 10 * i,) * 2)
    return spark.readStream.schema(sessions.FRAMES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run(spark, parts, **how):
    stage, asked = Staging(spark), spark.sparkContext.accumulator(0)

    def scorer(windows):
        asked.add(len(windows))
        return [0.99 if "otp" in w.lower() else 0.01 for w in windows]

    events, shots = sessions.score_calls(batches(spark, stage, parts), stage, scorer, **how)
    with sessions.keyed_state(spark):
        kept = spark.read.format("statestore").option("stateVarName", "call").load(f"{stage.base}/calls/marks").count()
    return sorted(events.collect(), key=lambda e: (e.call_id, e.since, e.seq)), shots, asked.value, kept


SCRIPT = ["Chào anh, em gọi để hỏi thăm sức khỏe.", "Tôi gọi từ ngân hàng, tài khoản của anh đang có vấn đề, anh đọc mã OTP tôi vừa gửi.",
          "Anh đọc mã OTP ngay đi, nếu không tài khoản sẽ bị khóa."]


LISTED = sessions.by_list([("OTP_REQUEST", "HIGH", "mã otp"), ("BANK_IMPERSONATION", "LOW", "từ ngân hàng"), ("URGENCY", "LOW", "ngay")])


def test_rules_score_the_whole_call(spark):
    events, shots, _, kept = run(spark, [[turn(1, i, 2 * i, "CALLER", 2 * i, t) for i, t in enumerate(SCRIPT)] + [end(1, 9, 8)]])
    assert [e.type for e in events] == ["transcript", "risk", "transcript", "risk", "alert", "transcript", "risk", "final"]
    assert events[1].codes == [] and "OTP_REQUEST" in events[4].codes and events[4].level == "HIGH" and events[4].text == SCRIPT[1]
    assert "OTP_REQUEST" not in events[6].new_codes and events[7].level == "HIGH"


def test_calls(spark):
    lines = [f"Câu nói số {i} trong một cuộc trò chuyện bình thường hằng ngày." for i in range(4)]
    parts = [
        [turn(1, 0, 0, "CALLER", 0, SCRIPT[0]), turn(2, 0, 0, "CALLEE", 5, "Dạ vâng, tôi nghe."), turn(3, 0, 0, "CALLER", 0, lines[0]), turn(4, 0, 0, "CALLER", 0, "  "), turn(5, 0, 0, "CALLER", 0, "một", 2)],
        [turn(1, 1, 2, "CALLER", 2, SCRIPT[1]), turn(2, 1, 2, "CALLER", 1, "Tôi gọi từ ngân hàng."), turn(3, 1, 2, "CALLER", 2, lines[1]), turn(4, 1, 2, "CALLER", 3, None),
         turn(5, 1, 2, "CALLER", 58, "hai", 2), turn(5, 2, 3, "CALLER", 61, "ba")],
        [turn(1, 2, 4, "CALLER", 4, SCRIPT[2]), end(2, 2, 5), turn(2, 3, 6, "CALLER", 9, "quá muộn"), turn(3, 2, 4, "CALLER", 4, lines[2]), turn(3, 3, 4, "CALLER", 6, lines[3]), end(4, 2, 6), tick(31)],
        [turn(6, 0, 33, "CALLER", 0, "một"), tick(60)], [turn(6, 1, 2, "CALLER", 3, "đến quá trễ"), turn(6, 2, 100, "CALLER", 0, "hai"), tick(1000)]]
    events, shots, asked, kept = run(spark, parts, longest=60, indicators=LISTED)
    of = lambda c: [e for e in events if e.call_id == c]
    assert all([e.seq for e in of(c) if e.since == s] == list(range(1, 1 + sum(e.since == s for e in of(c)))) for c in range(1, 7) for s in {e.since for e in of(c)})

    one = of(1)  # an alert for the rise only
    assert [e.type for e in one] == ["transcript", "risk", "transcript", "risk", "alert", "transcript", "risk", "final"]
    assert one[1].level == "LOW" and one[1].codes == [] and one[4].level == "HIGH" and one[4].score >= 60
    assert (one[4].speaker, one[4].at_seconds, one[4].text) == ("CALLER", 3.0, SCRIPT[1])
    assert "OTP_REQUEST" in one[3].new_codes and "OTP_REQUEST" not in one[6].new_codes and one[6].level == "HIGH"
    assert (one[7].ended_by, one[7].duration, one[7].level, one[7].text) == ("IDLE_TIMEOUT", 5.0, "HIGH", " ".join(SCRIPT))

    two = of(2)  # spoken order, not the order of arrival; nothing after the end
    assert two[-1].text == "Tôi gọi từ ngân hàng. Dạ vâng, tôi nghe." and two[-1].ended_by == "CLIENT" and len(two) == 5 + sum(e.type == "alert" for e in two)
    assert [[t.speaker for t in r.turns] for r in shots.where("call_id = 2 and kind = 'turn'").orderBy("n").collect()] == [["CALLEE"], ["CALLER", "CALLEE"]]

    assert [(e.type, e.level, e.score, e.probability, e.ended_by, e.text, e.duration) for e in of(4)] == [("final", None, None, None, "CLIENT", "", 4.0)]
    assert [(e.type, e.ended_by, e.duration) for e in of(5)][-1] == ("final", "MAX_DURATION", 60.0) and "ba" not in of(5)[-1].text
    assert [(e.type, e.text) for e in of(6) if e.type in ("transcript", "final")] == [("transcript", "một"), ("final", "một"), ("transcript", "hai"), ("final", "hai")]
    assert kept == 0

    cut = sessions.character_windows()
    wanted = 0
    for c in range(1, 7):
        per_since = {}
        for r in shots.where((F.col("call_id") == c) & (F.col("kind") == "turn")).collect():
            per_since.setdefault(r.since, set()).update(cut(" ".join(t.text for t in r.turns)))
        wanted += sum(map(len, per_since.values()))
    assert asked == wanted == shots.agg(F.sum("scored")).first()[0]  # a different window of a call is scored once


def test_batches_do_not_matter(spark):
    rows = [turn(1, i, 2 * i, "AB"[i % 2], (i * 7) % 5, SCRIPT[i % 3] + f" {i}") for i in range(5)] + [end(1, 9, 12)]
    told = [run(spark, parts, indicators=LISTED)[0] for parts in ([rows, [tick(900)]], [rows[:2], rows[2:4], rows[4:], [tick(900)]])]
    assert told[0] == told[1] and told[0][-1].type == "final"
