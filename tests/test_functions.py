"""Scalar functions, scores and metrics on fixed cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwarden.functions import scalar
from ringwarden.functions.risk import call_probability, risk, token_windows
from ringwarden.operators.components import connected_components
from ringwarden.operators.metrics import nearest_rank, word_error_rate, word_errors
from ringwarden.operators import near_duplicates as nd
from ringwarden.operators.near_duplicates import near_duplicate_clusters
from ringwarden.operators.ranking import rank_by_range
from ringwarden.operators.ranking import rank_within
from ringwarden.staging import Staging


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("0912345678", "+84912345678"), ("84912345678", "+84912345678"), ("+84 912-345.678", "+84912345678"),
                                      ("(09) 1234 5678", "+84912345678"), ("113456", "113456"), ("", None), ("  ", None), ("call me", None), ("12345", None), (None, None)])
def test_phone(spark, raw, want):
    assert one(spark, scalar.canonical_phone(F.lit(raw).cast("string"))) == want


def test_strict_phone_and_probability_raise(spark):
    with pytest.raises(Exception):
        one(spark, scalar.canonical_phone(F.lit("x"), strict=True))
    with pytest.raises(Exception):
        one(spark, risk(F.array(F.lit("A")), F.array(F.lit("LOW")), F.lit(1.5), F.lit(100)))


def test_text_forms(spark):
    assert one(spark, scalar.search_digits(F.lit("0 91-2"))) == "912"
    assert one(spark, scalar.tidy_dots(F.lit("a . . . . b"))) == "a. b"
    assert one(spark, scalar.tidy_dots(F.lit("....."))) == ""
    assert one(spark, scalar.file_name(F.lit("C:\\x\\call\t1.wav"))) == "call1.wav"
    assert one(spark, scalar.duplicate_key(F.lit("Xin  CHÀO, anh!"))) == "xin chào anh"
    assert one(spark, scalar.template("{Name} and {name}", {"name": F.lit("élan")})) == "Élan and élan"


@pytest.mark.parametrize("n,want", [(0, [[]]), (3, [[0, 1, 2]]), (4, [[0, 1, 2, 3]]), (5, [[0, 1, 2, 3], [3, 4]]), (8, [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7]])])
def test_windows(spark, n, want):
    tokens = F.array(*[F.lit(k) for k in range(n)]) if n else F.array().cast("array<int>")
    assert one(spark, token_windows(tokens, 4, 3)) == want


def test_call_probability(spark):
    p = F.array(*[F.lit(x) for x in (0.2, 0.9, 0.5)])
    assert [round(one(spark, call_probability(p, how)), 4) for how in ("mean", "max", "top2")] == [0.5333, 0.9, 0.7]


def test_risk_is_monotone_and_bounded(spark):
    grid = [(p, codes, sev) for p in (0.0, 0.3, 0.5, 0.8, 1.0) for codes, sev in
            (([], []), (["URGENCY"], ["LOW"]), (["URGENCY", "BANK_IMPERSONATION"], ["LOW", "LOW"]), (["URGENCY", "BANK_IMPERSONATION", "OTP_REQUEST"], ["LOW", "LOW", "HIGH"]))]
    df = spark.createDataFrame([(k, p, c, s) for k, (p, c, s) in enumerate(grid)], "k int, p double, c array<string>, s array<string>")
    rows = df.withColumn("r", risk(F.col("c"), F.col("s"), F.col("p"), F.lit(200))).orderBy("k").collect()
    score = np.array([r.r.score for r in rows]).reshape(5, 4)
    assert (np.diff(score, axis=0) >= 0).all() and (np.diff(score, axis=1) >= 0).all() and score.min() == 0 and score.max() == 100
    short = one(spark, risk(F.array().cast("array<string>"), F.array().cast("array<string>"), F.lit(1.0), F.lit(10)))
    assert (short.score, short.level, short.capped) == (59, "MEDIUM", True)


def test_word_errors(spark):
    def plain(r, h):
        row = list(range(len(h) + 1))
        for i, w in enumerate(r, 1):
            new = [i]
            for j, x in enumerate(h, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
            row = new
        return row[-1]

    rng = random.Random(3)
    pairs = [([rng.choice("abcdefgh") for _ in range(rng.randrange(9))], [rng.choice("abcdefgh") for _ in range(rng.randrange(9))]) for _ in range(200)]
    pairs += [(["a", "b"], []), ([f"w{i}" for i in range(400)], [f"w{i + i // 50}" for i in range(400)])]
    df = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(pairs)], "i int, r array<string>, h array<string>")
    assert {x.i: x.n for x in df.select("i", word_errors(F.col("r"), F.col("h")).alias("n")).collect()} == {i: plain(r, h) for i, (r, h) in enumerate(pairs)}
    assert one(spark, word_error_rate(F.lit("Xin chào anh"), F.lit("xin chào em"))) == pytest.approx(1 / 3)
    assert one(spark, word_error_rate(F.lit(""), F.lit("a"))) is None


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long"), Staging(spark)).collect()
    assert {r.id: r.component for r in out} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}


def test_ranks_are_gapless(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, 0).otherwise(1))
    out = rank_within(df, ["k"], [F.col("id")], F.pmod(F.xxhash64("id"), F.lit(7)), 7).toPandas()
    assert sorted(out[out.k == 0]["rank"]) == list(range(900)) and sorted(out[out.k == 1]["rank"]) == list(range(100))


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", x) for x in range(1, 11)], "k string, v int")
    assert nearest_rank(df, ["k"], "v", [0.05, 0.5, 0.95]).first()[1:] == (1, 6, 10)


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base), (2, "quite another text of its own"), (3, base + " more"), (4, base)]
    out = {r.id: r.cluster for r in near_duplicate_clusters(spark.createDataFrame(rows, "id long, key string")).collect()}
    assert out == {1: 1, 2: 2, 3: 1, 4: 1}


def test_near_copies_meet_about_once(spark, monkeypatch):
    """Clusters equal brute force, chains and template texts too; twice the copies meet in about twice the pairs."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    base, blocks = [word() for _ in range(120)], [[word() for _ in range(8)] for _ in range(8)]

    def copies(n):
        out = []
        for _ in range(n):
            w = list(base)
            w[rng.randrange(3, 117)] = word()
            out.append(w)
        return out

    chain = [[word() for _ in range(60)]]
    for k in range(6):
        chain.append(chain[-1][2:] + [word(), word()])
    templates = [sum(rng.sample(blocks, 4), []) + [word()] for _ in range(40)]
    met = []

    def counted(n, others):
        texts = copies(n) + others
        rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
        saved = nd.Staging.save

        def save(self, df, name):
            out = saved(self, df, name)
            if name == "pairs":
                met.append(out.count())
            return out

        monkeypatch.setattr(nd.Staging, "save", save)
        got = {r.id: r.cluster for r in near_duplicate_clusters(spark.createDataFrame(rows, "id long, key string")).collect()}
        monkeypatch.setattr(nd.Staging, "save", saved)
        sets = [{tuple(w[i:i + 3]) for i in range(len(w) - 2)} for w in texts]
        parent = list(range(len(texts)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(texts)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
        assert got == {i: root(i) for i in range(len(texts))}
        pairs, met[:] = sum(met), []
        return pairs

    counted(30, chain + templates)
    small, large = counted(100, []), counted(200, [])
    assert small < 100 * 99 / 4 and large < 2.5 * small


def test_ranks_by_range_of_any_values(spark):
    ids = [-(10 ** 18), 5, 3 * 10 ** 18, 2 ** 62, 17, 16, None] + list(range(100, 400)) + [10 ** 15 * k for k in range(1, 200)]
    rows = [(i, k % 2) for k, i in enumerate(ids)]
    got = {(r.id, r.k): r["rank"] for r in rank_by_range(spark.createDataFrame(rows, "id long, k int"), ["k"], "id").collect()}
    for k in (0, 1):
        order = sorted((i for i, j in rows if j == k), key=lambda i: (i is not None, i or 0))
        assert [got[i, k] for i in order] == list(range(len(order)))


def test_the_oldest_phrases_that_fit_are_in_use(spark):
    from ringwarden.functions.transcripts import usable_phrases

    rows = [(1, "a b", True, "X", 5), (2, "a b c", True, "X", 3), (3, "one", True, "X", 1), (4, "c d", False, "X", 1), (5, "c d", True, "Z", 1), (6, "e f", True, "Y", 3), (7, "g " * 101, True, "X", 0), (8, None, True, "X", 0)]
    df = spark.createDataFrame(rows, "phrase_id int, phrase string, active boolean, code string, created_at int")
    assert [r.phrase_id for r in usable_phrases(df, ["X", "Y"], 2).collect()] == [2, 6]
    assert [r.phrase_id for r in usable_phrases(df.select("phrase_id", "phrase")).collect()] == [1, 2, 4, 5, 6]


@pytest.mark.parametrize("percent", [85, 60])
def test_texts_without_partner_are_left_out(spark, percent, monkeypatch):
    """No linked text is left out, chains, copies and short texts included; of unrelated texts no n-gram is stored."""
    rng = random.Random(percent)
    texts = [[f"w{rng.randrange(10 ** 6)}" for _ in range(60)] for _ in range(60)]
    for size in (1, 2, 3, 4, 7, 12, 40, 80, 160):
        base = [f"b{size}-{i}" for i in range(size)]
        texts += [base, list(base)]
        for k in range(12):
            w = list(base) + [f"m{rng.randrange(99)}" for _ in range(rng.randrange(1 + size // 20))]
            for _ in range(k // 6):
                w[rng.randrange(len(w))] = f"c{rng.randrange(4)}"
            texts.append(w)
    sets = [{tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} for w in texts]
    linked = {i for i, a in enumerate(sets) for j, b in enumerate(sets) if texts[i] != texts[j] and len(a & b) * 100 >= percent * len(a | b)}
    df = spark.createDataFrame([(i, i, " ".join(w)) for i, w in enumerate(texts)], "row long, id long, key string").withColumn("h", F.xxhash64("key"))
    kept = {r.row for r in nd.with_partners(nd.key_grams(df, 3, "row", "h"), percent, F.min("h"), F.max("h")).collect()}
    assert linked <= kept and kept.isdisjoint(range(60)) and len(linked) > 30
    saved, stored = nd.Staging.save, []
    monkeypatch.setattr(nd.Staging, "save", lambda self, df, name: stored.append((name, saved(self, df, name))) or stored[-1][1])
    monkeypatch.setattr(nd.Staging, "drop", lambda *a: None)
    near_duplicate_clusters(df.select("id", "key"), percent).collect()
    assert all(t.where("rep < 60").isEmpty() for name, t in stored if "grams" in t.columns) and any("grams" in t.columns for _, t in stored)
