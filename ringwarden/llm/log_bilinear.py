"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

Words fall in classes: each of the most frequent words and the end mark is one,
every other word belongs to the class of its spelling (a hash of its last
letters).  Given the two classes before it, a class has the log-bilinear score
``(r1 C1 + r2 C2) . q + b`` with vectors r, q, position matrices C and biases b;
inside its class a word has its share of the smoothed unigram.  So the model is a
distribution over all words, with one place a class for words never seen.

Counts of words cover every training document.  Training is rounds of parameter
mixing: each task runs mini-batch noise-contrastive estimation in numpy over all
training tokens of its partition from the common parameters, and the mean of the
tasks' parameters, weighted by tokens, starts the next round.  Because the score
of two context words is a sum of two terms, the normaliser of every context is
one entry of a product of two matrices; scoring a batch of tokens is lookups.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwarden.llm.text import ascii_lower, crc_mod, documents, unnest, words
from ringwarden.staging import Staging

END = "\n"  # not a word: words hold no white space
#: Words with a class of their own, the end mark among them.
FREQUENT = 1024
#: Words whose counts tasks hold, the ones above among them; all others meet their counts in a join.
HELD = 131_072
#: Classes of all other words.
SPELLINGS = 256
DIM = 16
NOISE = 32
BATCH = 8192
#: Share of the training documents of each round of parameter mixing; one entry a round.
ROUNDS = (0.5, 0.5)


def spelling_class(word: Column) -> Column:
    """The class of a word that has none of its own: a hash of its last three bytes."""
    return (FREQUENT + F.crc32(F.substring(word.cast("binary"), -3, 3)) % SPELLINGS).cast("int")


def tokens_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text and one end mark."""
    return [*(text or "").encode().lower().split(), END.encode()]


class Encoder:
    """Classes of words, with a bounded memory of the words met."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.met = ranks, {}

    def miss(self, word: bytes) -> tuple[int, int]:
        rank = self.ranks.get(word, -1)
        own = rank if 0 <= rank < FREQUENT else FREQUENT + zlib.crc32(word[-3:]) % SPELLINGS
        if len(self.met) > 150_000:
            self.met.clear()
        self.met[word] = found = (own, rank)
        return found

    def __call__(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(class, rank or -1) of each token."""
        found = [x or self.miss(t) for x, t in zip(map(self.met.get, tokens), tokens)]
        both = np.array(found, np.int32)
        return both[:, 0].astype(np.int16), both[:, 1]


@dataclass
class Parameters:
    """Vectors of context (r) and target (q) classes, two position matrices, biases."""

    r: np.ndarray
    q: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    b: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray) -> "Parameters":
        rng = np.random.default_rng(7)
        k = len(unigram)
        vectors = lambda: (rng.standard_normal((k, DIM)) * 0.1).astype(np.float32)
        return cls(vectors(), vectors(), np.eye(DIM, dtype=np.float32), 0.5 * np.eye(DIM, dtype=np.float32), np.log(unigram).astype(np.float32))

    def pack(self) -> bytes:
        return b"".join(x.astype(np.float32).tobytes() for x in (self.r, self.q, self.c1, self.c2, self.b))

    @classmethod
    def unpack(cls, flat: np.ndarray, k: int) -> "Parameters":
        cuts = np.cumsum([k * DIM, k * DIM, DIM * DIM, DIM * DIM])
        r, q, c1, c2, b = np.split(flat.astype(np.float32), cuts)
        return cls(r.reshape(k, DIM), q.reshape(k, DIM), c1.reshape(DIM, DIM), c2.reshape(DIM, DIM), b)


def contexts(classes: np.ndarray, begins: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before each token; before a text stand end marks."""
    one, two = np.roll(classes, 1), np.roll(classes, 2)
    second = begins + 1
    one[begins] = two[begins] = end
    two[second[second < len(classes)]] = end
    return one, two


class Trainer:
    """Mini-batch noise-contrastive estimation with a decaying AdaGrad step."""

    def __init__(self, p: Parameters, unigram: np.ndarray, seed: int):
        self.p, self.noise = p, unigram
        self.log_noise = (np.log(unigram) + np.log(NOISE)).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.sums = [np.full(x.shape, 1e-3, np.float32) for x in (p.r, p.q, p.c1, p.c2, p.b)]

    def _step(self, k: int, at, grad: np.ndarray) -> None:
        x, s = (self.p.r, self.p.q, self.p.c1, self.p.c2, self.p.b)[k], self.sums[k]
        s[at] += grad * grad
        x[at] += 0.1 * grad / np.sqrt(s[at])

    def batch(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        p, n = self.p, len(target)
        drawn = self.rng.choice(len(self.noise), NOISE, p=self.noise)
        v1, v2 = p.r[one], p.r[two]
        v = v1 @ p.c1 + v2 @ p.c2
        qt, qn = p.q[target], p.q[drawn]
        st = np.einsum("ij,ij->i", v, qt) + p.b[target] - self.log_noise[target]
        sn = v @ qn.T + p.b[drawn] - self.log_noise[drawn]
        gt = 1 / (1 + np.exp(np.clip(st, -30, 30)))
        gn = -1 / (1 + np.exp(-np.clip(sn, -30, 30)))
        gv = gt[:, None] * qt + gn @ qn
        k = len(self.noise)

        def total(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(index, kind="stable")
            at, first = np.unique(index[order], return_index=True)
            return at, np.add.reduceat(rows[order], first, axis=0)

        to = np.concatenate([target, drawn])
        at, gq = total(to, np.concatenate([gt[:, None] * v, gn.T @ v]))
        gb = np.bincount(to, np.concatenate([gt, gn.sum(axis=0)]), k).astype(np.float32)
        ar, gr = total(np.concatenate([one, two]), np.concatenate([gv @ p.c1.T, gv @ p.c2.T]))
        scale = np.float32(1 / np.sqrt(n))
        for which, where, grad in ((1, at, gq), (4, np.arange(k), gb), (0, ar, gr), (2, slice(None), v1.T @ gv), (3, slice(None), v2.T @ gv)):
            self._step(which, where, grad.astype(np.float32) * scale)


def log_tables(p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term of the class one before, of the class two before, log normaliser of each pair): natural logs."""
    a1 = (p.r @ p.c1) @ p.q.T + p.b
    a2 = (p.r @ p.c2) @ p.q.T
    m1, m2 = a1.max(axis=1, keepdims=True), a2.max(axis=1, keepdims=True)
    z = np.log(np.maximum(np.exp(a1 - m1) @ np.exp(a2 - m2).T, 1e-30)) + m1 + m2.T
    return a1.astype(np.float32), a2.astype(np.float32), z.astype(np.float32)


def most_frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """Up to ``most`` rows of ``counts(word, c)``, the largest first.

    A histogram of few classes of size tells from which size on the words are few
    enough; only those come to the driver, however many tasks there are.
    """
    size = F.floor(F.log2("c") * 16).cast("int")
    histogram = sorted(((r["size"], r["n"]) for r in counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, taken = 1 << 30, 0
    for k, n in histogram:
        if taken + n > most:
            break
        least, taken = k, taken + n
    return counts.where(size >= least).toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)


def fit(encoded: DataFrame, unigram: np.ndarray, end: int) -> Parameters:
    """Train on ``encoded(row, classes)``: each round mixes what the tasks have learned from their own documents."""
    spark, k = encoded.sparkSession, len(unigram)
    p, done = Parameters.start(unigram), 0.0
    for number, share in enumerate(ROUNDS):
        place = F.pmod(F.xxhash64("row", F.lit("round")), F.lit(1000)) / 1000
        part = encoded.where((place >= done) & (place < done + share)).select("classes")
        sent = spark.sparkContext.broadcast((p.r, p.q, p.c1, p.c2, p.b))

        def learn(frames: Iterator[pd.DataFrame], sent=sent, number=number) -> Iterator[pd.DataFrame]:
            trainer, seen = Trainer(Parameters(*[x.copy() for x in sent.value]), unigram, number), 0
            for frame in frames:
                for lo in range(0, len(frame), 2000):
                    rows = [np.frombuffer(x, np.int16) for x in frame["classes"].iloc[lo:lo + 2000]]
                    joined = np.concatenate(rows).astype(np.int64)
                    begins = np.concatenate([[0], np.cumsum([len(x) for x in rows])[:-1]])
                    one, two = contexts(joined, begins, end)
                    order = trainer.rng.permutation(len(joined))
                    for first in range(0, len(order), BATCH):
                        at = order[first:first + BATCH]
                        trainer.batch(one[at], two[at], joined[at])
                    seen += len(joined)
            if seen:
                flat = np.frombuffer(trainer.p.pack(), np.float32)
                yield pd.DataFrame({"at": np.arange(len(flat)), "x": flat.astype(float) * seen, "seen": seen})

        mixed = part.mapInPandas(learn, "at int, x double, seen long").groupBy("at").agg((F.sum("x") / F.sum("seen")).alias("x"))
        rows = mixed.toPandas()  # one number a parameter, whatever the corpus
        if len(rows):
            flat = np.zeros(len(rows))
            flat[rows["at"].to_numpy()] = rows["x"].to_numpy()
            p = Parameters.unpack(flat, k)
        done += share
    return p


def score_texts(docs: DataFrame, training: Column) -> DataFrame:
    """Score every row of ``docs`` with models learned from the rows where ``training`` holds.

    Tokens are the lower-cased (A-Z) runs without ASCII white space and one end
    mark.  Returns (doc_id, n_tokens, n_known, train_tokens, base_score, score):
    base_score is the smoothed unigram's log10 probability, score the model's.
    Null text counts as empty: its one token is the end mark.  With nothing to
    learn from, all tokens are unknown and both scores are their share of an empty
    count.  Every row is scored by itself, rows with null or repeated ids and repeated rows
    too; where ``training`` is null nothing is learned.  Texts of any length are read whole;
    extra columns are not read; an empty table gives an empty result.
    """
    stage = Staging(docs.sparkSession)
    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").cast("string").alias("doc"), "text", F.coalesce(training, F.lit(False)).alias("training"))
    split = rows.where("training").select(F.concat(words(ascii_lower(F.col("text"))), F.array(F.lit(END))).alias("w"))
    counts = stage.save(unnest(split, "w", "word").groupBy("word").agg(F.count(F.lit(1)).alias("c")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
                       F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0)).alias("ends")).first()
    n, v, end, k = int(total["n"]), int(total["v"]), FREQUENT - 1, FREQUENT + SPELLINGS
    whole = n + 0.5 * (v + 1)
    top = most_frequent(counts.where(F.col("word") != END), HELD - 1)
    names = [*(w.encode() for w in top["word"][:end]), *[None] * max(0, end - len(top)), END.encode(), *(w.encode() for w in top["word"][end:])]
    held = np.array([*top["c"][:end], *[0] * max(0, end - len(top)), int(total["ends"]), *top["c"][end:]], float)
    ranks = {w: i for i, w in enumerate(names) if w is not None}

    # Class masses over all counted words; what the frequent words hold moves to their own classes.
    mass = np.full(k, 0.5)  # a place for words never seen
    for r in counts.groupBy(spelling_class(F.col("word")).alias("class")).agg(F.sum(F.col("c") + 0.5).alias("m")).collect():  # a row a class
        mass[r["class"]] += r["m"]
    for i, w in enumerate(names[:FREQUENT]):
        if w is not None and held[i] > 0:
            mass[FREQUENT + zlib.crc32(w[-3:]) % SPELLINGS] -= held[i] + 0.5
            mass[i] += held[i] + 0.5
    unigram = mass / mass.sum()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ranks, held, np.log10((held + 0.5) / whole)))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, held, log_base = shared.value
        encoder = Encoder(ranks)
        for frame in frames:
            out = []
            for doc, training, text in zip(frame["doc"], frame["training"], frame["text"]):
                tokens = tokens_of(text)
                classes, rank = encoder(tokens)
                known = rank[rank >= 0]
                rare = Counter(tokens[i].decode() for i in np.flatnonzero(rank < 0))
                out.append((doc, training, classes.tobytes(), int((held[known] > 0).sum()), float(log_base[known].sum()),
                            list(rare), np.fromiter(rare.values(), np.int32, len(rare))))
            yield pd.DataFrame(out, columns=["doc", "training", "classes", "own_known", "own_base", "rare", "times"])

    encoded = stage.save(rows.mapInPandas(
        encode, "doc string, training boolean, classes binary, own_known long, own_base double, rare array<string>, times array<int>")
        .withColumn("row", F.monotonically_increasing_id()), "encoded")
    p = fit(encoded.where("training").select("row", "classes"), unigram, end)

    pairs = encoded.select("row", F.arrays_zip("rare", "times").alias("x"))
    rare = unnest(pairs, "x", "x", "row").select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    known = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(whole))).alias("rare_base"))
    model = spark.sparkContext.broadcast((log_tables(p), np.log10(unigram)))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (a1, a2, z), log_class = model.value
        for frame in frames:
            out = []
            for row, doc, raw, known, base in zip(frame["row"], frame["doc"], frame["classes"], frame["own_known"], frame["own_base"]):
                c = np.frombuffer(raw, np.int16).astype(np.int64)
                one, two = contexts(c, np.zeros(1, np.int64), end)
                log_p = (a1[one, c] + a2[two, c] - z[one, two]).astype(float) / np.log(10)
                out.append((row, doc, len(c), known, base, float((log_p - log_class[c]).sum())))
            yield pd.DataFrame(out, columns=["row", "doc", "n_tokens", "own_known", "own_base", "gain"])

    # The model's word probability is its class probability times the word's share of the class's unigram mass.
    scale = float(np.log10(whole / mass.sum()))
    scored = encoded.select("row", "doc", "classes", "own_known", "own_base").mapInPandas(
        score, "row long, doc string, n_tokens long, own_known long, own_base double, gain double")
    both = scored.join(known, "row", "left")
    base = F.col("own_base") + F.coalesce("rare_base", F.lit(0.0))
    return both.select(F.col("doc").cast(ids).alias("doc_id"), "n_tokens", (F.col("own_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                       base.alias("base_score"), (base + F.col("gain") + F.col("n_tokens") * scale).alias("score"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by models learned from those with crc32(doc_id) mod 5 other than 1."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 1, F.lit(False))  # rows without an id are learned from
    return score_texts(docs, ~held_out).withColumn("held_out", held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
