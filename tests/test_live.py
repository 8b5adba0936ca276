"""Utterance segmentation, turns and phrases on fixed cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwarden.functions.transcripts import normalised, phrase_hits, speaker_turns
from ringwarden.streaming.live import Segment


def tone(ms):
    return (8000 * np.sin(np.arange(16 * ms) * 2 * np.pi * 300 / 16000)).astype("<i2").tobytes()


def quiet(ms):
    return np.zeros(16 * ms, "<i2").tobytes()


def run(audio, size):
    s, out = Segment(), []
    for lo in range(0, len(audio), size):
        out += s.take(audio[lo:lo + size])
    return out + s.finish()


AUDIO = quiet(500) + tone(1000) + quiet(1000) + tone(100) + quiet(1000) + tone(600) + quiet(300) + tone(500)


@pytest.mark.parametrize("size", [640, 333, 5000, 10**7])
def test_packets_do_not_matter(size):
    assert run(AUDIO, size) == run(AUDIO, 640)


def test_utterances():
    assert run(AUDIO, 640) == [(0.3, 1.7), (3.4, 5.0)]  # pre-roll and tail of 200 ms, the short noise is dropped
    assert [round(b - a, 2) for a, b in run(tone(40_000), 1000)] == [15.0, 15.0, 10.0]
    assert run(quiet(3000), 640) == []


def test_turns(spark):
    texts = ["A: xin chào. B: chào anh. A: tôi gọi từ ngân hàng. B: vâng.", "Lưu ý: không chuyển tiền.", None, "", "Khách: a\nShop: b: c\nkhách: d\nSHOP: e",
             "A: lúc 9:30 nhé. B: ừ. A: \nB: vâng.", "A: một. A: hai. A: ba."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", speaker_turns(F.col("text")).alias("t")).orderBy("id")
    got = [r.t and [(x.speaker, x.text) for x in r.t] for r in df.collect()]
    assert got[0] == [("A", "xin chào."), ("B", "chào anh."), ("A", "tôi gọi từ ngân hàng."), ("B", "vâng.")]
    assert got[1] is None and got[2] is None and got[3] is None and got[6] is None
    assert got[4] == [("Khách", "a"), ("Shop", "b: c"), ("khách", "d"), ("SHOP", "e")]
    assert got[5] == [("A", "lúc 9:30 nhé."), ("B", "ừ."), ("B", "vâng.")]


def test_normal_form(spark):
    texts = ["Khoá TÀI khoản! Sao? đường linh", None, "Kho\u0061\u0301 ti\u0065\u0302\u0300n tie\u0300\u0302n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", normalised(F.col("text")).alias("n")).orderBy("id")
    assert [r.n for r in df.collect()] == ["khóa tài khoản | sao || đường link", "", "khóa tiền ti\u00e8\u0302n"]


def test_phrases(spark):
    texts = [(1, "hãy chuyển tiền ngay"), (2, "không bao giờ chuyển tiền"), (3, "không | chuyển tiền"), (4, "tiền chuyển"), (5, "")]
    phrases = [(1, "chuyển tiền"), (2, "tiền"), (3, "x" * 201)]
    out = phrase_hits(spark.createDataFrame(texts, "id int, norm string"), spark.createDataFrame(phrases, "phrase_id int, phrase string"))
    assert {(r.id, r.phrase_id) for r in out.collect()} == {(1, 1), (3, 1)}
