"""The ten operators against brute force, on odd rows and on empty tables."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from ringwarden.llm import additive_quantisation as aq
from ringwarden.llm import log_bilinear as lbl
from ringwarden.llm.decontaminate import contamination
from ringwarden.llm.jaccard_join import jaccard_components, representatives
from ringwarden.llm.language_id import identify
from ringwarden.llm.mixing import fit_domains, label_domains, mix, posteriors
from ringwarden.llm.text import crc_mod
from ringwarden.staging import Staging
from ringwarden.llm.quality_knn import score_quality
from ringwarden.llm.revisits import canonical_url, resolve_revisits
from ringwarden.llm.sharding import assign_shards
from ringwarden.llm.substring_dedup import remove_repeats

from pyspark.sql import functions as F


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_components(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = spaced(ascii_lower(t or ""))
        sets[d] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies(seed, n_docs, length, edits, words=400):
    rng = np.random.default_rng(seed)
    base = [f"t{i}" for i in rng.integers(0, words, length)]
    out = []
    for d in range(n_docs):
        w = list(base)
        for at in rng.integers(0, length, rng.integers(0, edits + 1)):
            w[at] = f"e{rng.integers(0, 50)}"
        out.append((d + 100, " ".join(w)))
    return out


@pytest.mark.parametrize("seed,edits", [(1, 3), (2, 6)])
def test_jaccard_components_match_brute_force(spark, seed, edits):
    rows = near_copies(seed, 60, 80, edits) + [(d + 1000, t) for d, t in near_copies(seed + 10, 30, 40, edits)]
    out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, 4, 85)


@pytest.mark.parametrize("n_docs,length,edits", [(25, 60, 5), (120, 60, 4), (240, 60, 4)])
def test_jaccard_groups_of_several_sizes(spark, n_docs, length, edits):
    rows = near_copies(5, n_docs, length, edits, words=90)
    out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == {d: c for d, (_, c) in brute_components(rows, 4, 85).items()}


def test_jaccard_pairs_grow_with_the_group(spark, monkeypatch):
    from ringwarden.llm import jaccard_join

    counts = []
    whole = jaccard_join.overlaps

    def counting(pairs, cut):
        counts[-1] += pairs.count()
        return whole(pairs, cut)

    monkeypatch.setattr(jaccard_join, "overlaps", counting)
    for n_docs in (200, 400):
        counts.append(0)
        rows = near_copies(9, n_docs, 80, 3)
        assert jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).count() == n_docs
    assert counts[1] <= 3 * counts[0] and counts[1] <= 4 * 400


def test_jaccard_null_and_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30 ", "x ")
    rows = [(3, base), (3, base), (None, base), (None, near), (5, near), (5, "another text of its own"), (None, None), (None, "only of null ids here"), (None, "only of null ids here")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, row long")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect())
    assert got == {(3, 57, 3): 2, (None, 57, 3): 2, (5, 57, 3): 1, (5, 2, 5): 1, (None, 0, None): 1, (None, 2, None): 2}
    left = representatives(docs, n=4, percent=85)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == {(3, base): 1, (5, "another text of its own"): 1, (None, None): 1, (None, "only of null ids here"): 1}


def test_jaccard_odd_and_empty(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    out = jaccard_components(odd_documents).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, 4, 85)
    assert jaccard_components(odd_documents.limit(0)).count() == 0


def brute_contamination(docs, items, n=10):
    rx = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = lambda t: re.findall(rx, ascii_lower(t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - n + 1)) if w else []:
            windows[tuple(w[k:k + n])].add(i)
    out = {}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_contamination_matches_brute_force(spark, odd_documents):
    items = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa LAMBDA mu"), (2, "one two"), (3, None), (4, ""), (5, "same same"),
             (6, "absent words only"), (7, "one two"), (8, " ".join(f"w{i}" for i in range(500, 512)))]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in contamination(odd_documents, bench).collect()}
    assert got == brute_contamination(docs, items)
    assert contamination(odd_documents.limit(0), bench).count() == 0
    assert all(not r.contaminated for r in contamination(odd_documents, bench.limit(0)).collect())


def test_contamination_of_repeated_and_null_ids(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "so " + item), (1, "so " + item), (2, item), (2, "a clean text"), (None, item + " so"), (None, item + " so"), (None, "ten one two"), (3, item)]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    out = contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.contaminated, len(r.spans)) for r in out)
    assert got == {(1, 13, 12, True, 3): 2, (2, 12, 12, True, 3): 1, (2, 3, 0, False, 0): 1, (None, 13, 12, True, 3): 2, (None, 3, 0, False, 0): 1, (3, 12, 12, True, 3): 1}


def brute_near(docs, items, slack, n=10):
    rx = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = lambda t: re.findall(rx, ascii_lower(t or ""))
    out = {}
    for d, t in docs:
        w, out[d] = split(t), set()
        for i, item in items:
            v = split(item)
            for k in range(max(1, len(v) - n + 1)) if v else []:
                want = Counter(v[k:k + n])
                span = sum(want.values()) + slack
                if any(not want - Counter(w[s:s + span]) for s in range(len(w))):
                    out[d].add(i)
    return out


def test_proximity_matches_brute_force(spark):
    docs = [(1, "red x green y blue"), (2, "red a b c d e f g h green blue"), (3, "blue green red"), (4, None), (5, "tick tock tick"), (6, "tock tick other"),
            (7, "red red red " + "z " * 40 + "blue green x red"), (8, "one")]
    items = [(1, "red green blue"), (2, "tick tick tock"), (3, "one"), (4, None)]
    for slack in (0, 2, 5):
        got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), slack=slack).collect()
        assert {r.doc_id: set(r.near_ids) for r in got} == brute_near(docs, items, slack)
    rng = np.random.default_rng(11)
    docs = [(d, " ".join(f"v{x}" for x in rng.integers(0, 12, 60))) for d in range(40)]
    items = [(i, " ".join(f"v{x}" for x in rng.integers(0, 12, 6))) for i in range(12)]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: set(r.near_ids) for r in got} == brute_near(docs, items, 5)
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in got} == brute_contamination(docs, items)


def test_shards_are_balanced_and_keep_copies(spark, odd_documents):
    rows = [(i, f"text {i % 7 if i < 300 else i}") for i in range(1000)] + [(2000 + i, "hot") for i in range(500)]
    out = assign_shards(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    count = out.groupby("shard").size()
    assert len(out) == 1500 and count.max() - count.min() <= 1 and len(count) == 16
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    text = dict(rows)
    spread = out.assign(t=out.doc_id.map(text)).groupby("t").shard.nunique()
    assert spread.drop("hot").max() == 1 and spread["hot"] <= 7  # the hot text needs six shards at least
    odd = assign_shards(odd_documents, shards=4).toPandas()
    assert len(odd) == 13 and odd.groupby("shard").size().max() - odd.groupby("shard").size().min() <= 1
    sizes = {r.doc_id: len((r.text or "").encode()) + 1 for r in odd_documents.collect()}
    assert dict(zip(odd.doc_id, odd["size"])) == sizes
    assert assign_shards(odd_documents.limit(0)).count() == 0


def test_mixing_meets_targets(spark, odd_documents):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        kind = "ab"[int(rng.random() < 0.3)]
        rows.append((i, " ".join(f"{kind}{'xyz'[k % 3]}" * 2 for k in rng.integers(0, 9, 20))))
        labels.append((i, kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = mix(docs, spark.createDataFrame(labels, "doc_id long, domain string"), {"a": 1, "b": 1, "c": 5}).toPandas()
    mass = sum(r.rate * r.n_tokens * np.array(r.p) for r in out.itertuples())
    assert (out.rate >= 0).all() and np.allclose(mass / mass.sum(), [0.5, 0.5], atol=1e-6)
    odd = mix(odd_documents, odd_documents.select("doc_id", F.col("lang").alias("domain")), {"en": 0.5, "de": 0.5})
    assert odd.count() == 13 and odd.where("rate is null or rate < 0").count() == 0
    assert mix(odd_documents.limit(0), odd_documents.select("doc_id", F.col("lang").alias("domain")), {"en": 1}).count() == 0
    assert {r.rate for r in mix(odd_documents, odd_documents.limit(0).select("doc_id", F.col("lang").alias("domain")), {"en": 1}).collect()} == {1.0}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_domain_posteriors_are_better_than_the_majority_and_calibrated(spark, sf):
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text"), label_domains(spark, path)
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = fit_domains(docs, labels.where(~held), Staging(spark))
    out = posteriors(docs.join(labels.where(held), "doc_id"), model).select("n_tokens", "p", "domain").toPandas()
    p = np.stack(out.p)
    assert (np.array(model.names)[p.argmax(axis=1)] == out.domain).mean() >= (out.domain == "q1t0").mean() + 0.1
    want = np.array([out.n_tokens[out.domain == k].sum() for k in model.names]) / out.n_tokens.sum()
    assert np.abs((p * out.n_tokens.to_numpy()[:, None]).sum(axis=0) / out.n_tokens.sum() - want).max() < 0.05


def test_mixing_odd_labels_and_clashing_columns(spark):
    rows = [(1, "calm words here", "x", 9.0), (1, "other words here", "y", 9.0), (None, "calm", "z", 9.0), (2, None, None, 9.0), (3, "", None, 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string, rate double")
    labels = spark.createDataFrame([(1, "b"), (1, "a"), (None, "a"), (2, None), (3, "b")], "doc_id long, domain string")
    out = mix(docs, labels, {"a": 0.5, "b": 0.5})
    assert out.columns == ["doc_id", "text", "n_tokens", "p", "domain", "posterior", "rate", "miss"]
    assert out.count() == 5 and {r.domain for r in out.collect()} <= {"a", "b"}


def test_quality_votes(spark, odd_documents):
    rows = [(i, ("CALM words in a row %d" if i % 2 else "!!LOUD!! ## %d ## !!") % i, i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    out = {r.doc_id: r.score for r in score_quality(docs.where("doc_id >= 100"), docs.where("doc_id < 100")).collect()}
    assert all((s > 0.5) == bool(d % 2) for d, s in out.items())
    odd = score_quality(odd_documents.drop("score"), docs.where("doc_id < 100")).collect()
    assert len(odd) == 13 and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in score_quality(odd_documents, docs.limit(0)).collect()} == {0.5}
    assert score_quality(odd_documents.limit(0), docs).count() == 0


def brute_repeats(rows, n):
    words = {d: spaced(t) for d, t in rows}
    seen = Counter(tuple(w[i:i + n]) for w in words.values() for i in range(len(w) - n + 1))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i:i + n])] > 1:
                gone |= set(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("n", [5, 8, 35])
def test_repeats_match_brute_force(spark, odd_documents, n):
    rng = np.random.default_rng(n)
    passage = [f"p{i}" for i in range(60)]
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    for d in range(100, 130):
        w = [f"v{i}" for i in rng.integers(0, 300, 120)]
        if d % 3 == 0:
            at, lo = rng.integers(0, 100), rng.integers(0, 20)
            w[at:at] = passage[lo:lo + int(rng.integers(n - 2, 60))]
        rows.append((d, " ".join(w)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), n).collect()}
    assert got == brute_repeats(rows, n)
    assert remove_repeats(odd_documents.limit(0), n).count() == 0


def test_repeats_of_rows_with_null_and_repeated_ids(spark):
    fifty, other = " ".join(f"p{i}" for i in range(50)), " ".join(f"o{i}" for i in range(40))
    rows = [(1, fifty + " end"), (None, "start " + fifty), (None, "start " + fifty), (2, other), (2, other + " more"), (3, "x y z"), (3, None), (4, " ".join(f"u{i}" for i in range(99)))]
    want = Counter((d, *v) for (d, _), v in zip(rows, brute_repeats(list(enumerate(t for _, t in rows)), 35).values()))
    out = remove_repeats(spark.createDataFrame([(*r, 7, "r") for r in rows], "doc_id long, text string, row int, doc string"))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()) == want
    assert sorted(n for d, _, n, _ in want.elements() if d in (1, None)) == [50, 51, 51]


def test_scores_of_rows_with_null_and_repeated_ids(spark):
    rows = [(1, "a b c"), (1, "a b c d"), (None, "a b"), (None, None), (2, "a b c"), (2, "a b c"), (2**60 + 1, "c")]
    out = lbl.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.coalesce(F.col("doc_id") != 2, F.lit(True))).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((d, len(spaced(t)) + 1) for d, t in rows)
    assert all(r.train_tokens == 4 + 5 + 3 + 1 + 2 for r in out) and len({(r.base_score, r.score) for r in out if r.n_tokens == 4}) == 1


def test_language_mixtures(spark, odd_documents):
    train = spark.createDataFrame([("the cat and the dog of the house", "en")] * 5 + [("der hund und die katze im haus", "de")] * 5 + [(None, "en"), ("x", None)], "text string, lang string")
    rows = [(1, "the dog and the cat"), (2, "die katze und der hund"), (3, "the dog of the house und der hund im haus die katze the cat and"), (4, "123 !!"), (5, None)]
    out = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string"), train).collect()}
    assert out[1].lang_pred == "en" and out[2].lang_pred == "de" and out[4].lang_pred == out[5].lang_pred == "und"
    assert len(out[3].languages) == 2 and 0.3 < out[3].score < 0.7
    assert identify(odd_documents, odd_documents).count() == 13
    assert {r.lang_pred for r in identify(odd_documents, train.limit(0)).collect()} == {"und"}
    assert identify(odd_documents.limit(0), train).count() == 0


def test_nearest_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((3000, 16)).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]]) for i in range(3000)] + [(5000 + i, [float(x) for x in v[0] * 4]) for i in range(30)]
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9004, [None] * 16)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    out = aq.search(table, table.where("vec_id % 20 = 0")).toPandas()
    x, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    hit = total = 0
    for q, g in out.groupby("query_id"):
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        hit, total = hit + len(set(ids[best]) & set(g.vec_id)), total + 20
        assert list(g.sort_values("rank")["rank"]) == list(range(1, 21))
    assert hit / total >= 0.9
    tied = out[(out.query_id == 0)].sort_values("rank")
    assert list(tied.vec_id) == [5000 + i for i in range(20)]
    assert aq.search(table.limit(0), table.limit(0)).count() == 0
    few = table.where("vec_id < 5")
    assert aq.search(few, few).count() == 20


def test_nearest_neighbours_in_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1800, 16))
    x[600:] = x[0] + 0.01 * rng.normal(size=(1200, 16))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = aq.search(table, table.where("vec_id % 60 = 0")).toPandas()
    hit = {True: 0, False: 0}
    for q, g in out.groupby("query_id"):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        hit[q >= 600] += len(set(g.vec_id) & set(np.lexsort((np.arange(1800), -score))[:20]))
        assert np.allclose(g.sort_values("rank").score, -np.sort(-score[g.vec_id]), rtol=1e-12, atol=0)
    assert out.query_id.nunique() == 30 and hit[True] >= 0.95 * 400 and hit[False] >= 0.95 * 200


def test_nearest_neighbours_of_any_length_and_size(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a) for a in rng.normal(size=4 + i % 5)]) for i in range(60)] + [(None, [9.0, 9.0]), (70, [1e200] * 4), (71, [-1e-300, 1e-300]), (72, [1e200, -1e200])]
    rows += [(73, [1.0, 1.0]), (73, [2.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    out = aq.search(table, table.where("vec_id % 5 = 0"), k=70).toPandas()

    def product(a, b):
        exact = sum(Fraction(x) * Fraction(y) for x, y in zip(a, b))
        return float(exact) if abs(exact) < 2 ** 1024 else float("inf") * (1 if exact > 0 else -1)

    assert sorted(out.query_id.unique()) == [*range(0, 60, 5), 70]
    for q, g in out.groupby("query_id"):
        own = dict(rows)[q]
        want = sorted((-product(v, own), 10 ** 6 if i is None else i) for i, v in rows if i != q)
        got = [(-s, 10 ** 6 if np.isnan(i) else i) for i, s in zip(g.sort_values("rank").vec_id.astype(float), g.sort_values("rank").score)]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want], rtol=1e-12)


def test_language_model_is_a_distribution_and_beats_the_unigram(spark, odd_documents):
    rng = np.random.default_rng(1)
    pairs = [("aa", "bb"), ("cc", "dd"), ("ee", "ff")]
    rows = [(i, " ".join(" ".join(pairs[k]) for k in rng.integers(0, 3, 40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = lbl.score_texts(docs, F.col("doc_id") < 300).toPandas()
    held = out[out.doc_id >= 300]
    assert (held.score > held.base_score).all() and (out.n_known == out.n_tokens).all()
    p = lbl.Parameters.start(np.full(50, 0.02))
    a1, a2, z = lbl.log_tables(p)
    total = np.exp(a1[:, None, :] + a2[None, :, :] - z[:, :, None]).sum(axis=2)
    assert np.allclose(total, 1, atol=1e-4)
    base = odd_documents.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in lbl.score_texts(odd_documents, F.lit(True)).collect()}
    tokens = {r.doc_id: [ascii_lower(w) for w in spaced(r.text)] + ["\n"] for r in base}
    c = Counter(w for t in tokens.values() for w in t)
    n, v = sum(c.values()), len(c)
    for d, t in tokens.items():
        want = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert got[d].n_tokens == len(t) and abs(got[d].base_score - want) < 1e-6
    assert lbl.score_texts(odd_documents.limit(0), F.lit(True)).count() == 0
    assert all(r.n_known == 0 for r in lbl.score_texts(odd_documents, F.lit(False)).collect())


def test_spelling_classes_agree(spark):
    words = ["a", "ab", "abc", "abcd", "éü", "x.", "日本語"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", lbl.spelling_class(F.col("w")).alias("k"))
    assert {r.w: r.k for r in df.collect()} == {w: lbl.FREQUENT + zlib.crc32(w.encode()[-3:]) % lbl.SPELLINGS for w in words}


def test_revisits(spark):
    t = "2024-01-01 00:00:%02d"
    full = lambda i, u, s, **h: (i, u, t % s, "response", 200, h)
    back = lambda i, u, s, **h: (i, u, t % s, "revisit", 304, h)
    rows = [full(1, "http://www.a.org/x?b=2&a=1", 1, etag='"1"', date="d1", body="k"), full(2, "https://A.org/x/?a=1&b=2#f", 5, etag='"2"'),
            back(3, "a.org/x?a=1&b=2", 3, etag='W/"1"', date="d3", evil="e"), back(4, "https://a.org/x?a=1&b=2&utm_source=q", 9, etag='"1"'),
            back(5, "http://b.org/", 9, etag='"1"'), back(6, "http://a.org/x?a=1&b=2", 0, etag='"1"'), back(7, None, 9), back(8, "http://a.org/x?b=2&a=1", 9),
            (9, "http://c.org", None, "revisit", 304, None), (10, "http://a.org/x?a=1&b=2", t % 8, "response", 404, {"etag": '"9"'})]
    df = spark.createDataFrame(rows, "record_id long, url string, captured string, type string, status int, headers map<string,string>").withColumn("captured", F.col("captured").cast("timestamp"))
    for width in (2, 86_400):
        got = {r.record_id: (r.outcome, r.response_id) for r in resolve_revisits(df, width).collect()}
        assert got == {3: ("resolved", 1), 4: ("validators_differ", None), 5: ("no_response", None), 6: ("no_response", None), 7: ("no_response", None),
                       8: ("no_validator", None), 9: ("no_response", None)}
    merged = resolve_revisits(df).where("record_id = 3").first().headers
    assert merged == {"etag": 'W/"1"', "date": "d3", "body": "k"}
    assert resolve_revisits(df.limit(0)).count() == 0
    assert df.limit(1).select(canonical_url(F.lit("HTTP://WWW.Example.com:80/a//?z=1&a=2#t"))).first()[0] == "example.com/a?a=2&z=1"


def _plain_proportions(text, table, rounds=12):
    """The mixture of one text by loops: EM over words, then the nested sets by penalised likelihood."""
    import math

    mask, n_lang, like = 0xFFFFFFFF, table.shape[1], []
    for word in text.split(b" "):
        b, logs = b" " + word + b" ", [0.0] * n_lang
        for i in range(len(b) - 2):
            code = (b[i] * 0x9E3779B1 & mask) ^ (b[i + 1] * 0x85EBCA77 & mask) ^ (b[i + 2] * 0xC2B2AE3D & mask)
            cell = ((code ^ (code >> 15)) * 0x2C1B3C6D & mask) >> 17
            logs = [x + float(table[cell, k]) for k, x in enumerate(logs)]
        like.append([math.exp(max(x - max(logs), -30.0)) for x in logs])

    def em(allowed, steps):
        share = [a / sum(allowed) for a in allowed]
        for _ in range(steps):
            joint = [[w * s for w, s in zip(row, share)] for row in like]
            share = [sum(row[k] / sum(row) for row in joint) / len(like) for k in range(n_lang)]
        return share, sum(math.log(sum(w * s for w, s in zip(row, share))) for row in like)

    order = sorted(range(n_lang), key=lambda k, full=em([1.0] * n_lang, rounds)[0]: -full[k])
    best, chosen = -math.inf, None
    for k in range(1, n_lang + 1):
        share, total = em([(1.0 if j in order[:k] else 0.0) + 1e-12 for j in range(n_lang)], rounds if k > 1 else 1)
        score = total - 0.5 * (k - 1) * math.log(len(like) + 1.0)
        if score <= best:
            break
        best, chosen = score, share
    return chosen


def test_mixture_equals_plain_loops():
    import numpy as np

    from ringwarden.llm.language_id import CELLS, proportions

    table = np.log(np.random.default_rng(3).dirichlet(np.full(4, 0.5), CELLS) + 1e-3)
    texts = ["ab".encode(), "one two three four five six".encode(), "grün blau rot gelb".encode(), ("x y zz " * 40).strip().encode(),
             "नमस्ते दुनिया यह एक वाक्य है".encode()]
    found = proportions(texts, table)
    for text, row in zip(texts, found):
        assert np.allclose(row, _plain_proportions(text, table), atol=1e-9)


def test_language_marks_and_many_languages(spark):
    from ringwarden.llm.language_id import identify, letters_only

    marked = spark.createDataFrame([("हिन्दी, भाषा 12",), ("\u0301 x\u0301y \u0301z",), ("1\u0301 \u0301",), (None,)], "text string")
    assert [r[0] for r in marked.select(letters_only(marked["text"])).collect()] == ["हिन्दी भाषा", "x\u0301y z", "", ""]
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: (letters[k % 26] + letters[k // 26 % 26] + letters[(7 * k + 3) % 26]) * 3
    rows = [(k, " ".join([word(k)] * 6), f"l{k:03d}") for k in range(230)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = identify(docs.select("doc_id", "text"), docs.select("text", "lang")).collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id']:03d}" for r in got) >= 228
