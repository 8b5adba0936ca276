"""Changed copies of texts: rates and floors, the same rows again, plain loops."""

import unicodedata

from pyspark.sql import functions as F

from ringwarden.functions import augmentation as aug
from ringwarden.plans import augmentation as plan

ROWS = "id long, text string, source string, label int, extra string"


def test_words_change_within_their_rates(spark):
    n = 400
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(n))) for i in range(40)], "k long, t string")
    w = aug.split_words(F.col("t"))
    for row in df.select(aug.interjected(w, F.col("k")).alias("i"), aug.dropped(w, F.col("k")).alias("d"), aug.repeated(w, F.col("k")).alias("r"), aug.swapped(w, F.col("k")).alias("s"),
                         aug.toneless(w, F.col("k")).alias("t")).collect():
        own = [f"w{j}" for j in range(n)]
        assert [x for x in row.i if x not in aug.INTERJECTIONS] == own and 0.02 * n < len(row.i) - n < 0.24 * n
        assert set(row.d) < set(own) and 0.01 * n < n - len(row.d) < 0.16 * n and row.d == sorted(row.d, key=own.index)
        assert list(dict.fromkeys(row.r)) == own and 0 < len(row.r) - n < 0.14 * n
        moved = [j for j in range(n) if row.s[j] != own[j]]
        assert sorted(row.s) == sorted(own) and all(abs(own.index(row.s[j]) - j) == 1 for j in moved) and 0 < len(moved) < 0.2 * n
        assert row.t == own


def test_short_and_empty_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "  ", "a", "a b", "a b c"] * 40)], "k long, t string")
    w = aug.split_words(F.col("t"))
    for row in df.select("t", aug.dropped(w, F.col("k")).alias("d"), aug.swapped(w, F.col("k")).alias("s"), aug.with_fillers(F.col("t"), w, F.col("k")).alias("f")).collect():
        own = (row.t or "").split()
        assert row.d == own and sorted(row.s) == own and (row.f.split()[-len(own):] == own if own else row.f == "")


def test_bare_letters_equal_the_standard(spark):
    texts = ["Đường đi Hà Nội", "ÉÀÇñ", "éặ", "ǖ Ự ẫ", "abc", "".join(map(chr, range(0xC0, 0x250))), "".join(map(chr, range(0x1E00, 0x1F00)))]
    def plain(t):
        return "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").replace("đ", "d").replace("Đ", "D")
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", aug.bare(F.col("t")).alias("b")).collect()
    assert {r.i: r.b for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_labels_of_speakers_go(spark):
    cases = {"A: chào B: vâng": "chào vâng", "Người gọi 2:  alo\nngười nghe : dạ": "alo dạ", "sofa: x": "sofa: x", "a:b": "b"}
    labels = ["A", "B", "Người gọi", "Người gọi 2", "Người nghe"]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", aug.without_labels(F.col("t"), labels).alias("x")).collect()
    assert {r.t: r.x for r in got} == cases


def test_copies_are_chosen_by_source_and_come_again(spark):
    rows = [(i, f"one two three four five six seven {i}", "src3" if i % 5 == 0 else "src1" if i % 5 == 1 else None if i % 5 == 2 else "src7", i % 2, "e") for i in range(600)] + [(601, None, "src1", 1, "e"), (602, "", "src1", 0, "e")]
    df = spark.createDataFrame(rows, ROWS)
    out = plan.augmented(df).collect()
    by = {}
    for r in out:
        by.setdefault(r.id, []).append(r)
    assert not any(i % 5 == 0 for i in by if i < 600)
    assert all(len(v) == 4 for i, v in by.items() if i % 5 == 1) and sum(i % 5 == 1 for i in by if i < 600) == 120 and len(by[601]) == 4
    others = [i for i in by if i < 600 and i % 5 in (2, 3, 4)]
    assert 0.35 < len(others) / 360 < 0.55 and all(len(by[i]) == 1 for i in others)
    assert all(r.label == r.id % 2 for r in out if r.id < 600)
    assert 0.25 < sum("+" in r.changes for r in out) / len(out) < 0.45
    talk = [r for r in out if r.changes == "small_talk_before" and r.id < 600]
    assert talk and all(r.augmented.endswith(f"seven {r.id}") and 8 < len(r.augmented.split()) <= 8 + 45 for r in talk)
    again = df.withColumn("copied", F.lit(False)).unionByName(spark.createDataFrame([(9, "x", "src1", 1, "e", True)], ROWS + ", copied boolean"))
    assert sorted(map(tuple, plan.augmented(again).collect())) == sorted(map(tuple, out))
    assert plan.augmented(df.limit(0)).count() == 0
