"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text is a bag of trigrams of character kinds (small letter, capital, digit,
space, or the sign itself) and of a few coarse measures (how many of its words and
lines are repeats, how long they are), weighted by tf-idf.  The singular vectors
of the labelled texts span the latent space.  The labelled vectors, a bounded
number, are broadcast; every document's cosines with all of them are exact matrix
products in blocks, and its nearest ones vote with weights by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwarden.llm.text import crc_mod, documents

#: Labelled rows that the classifier is fitted on, at most (by hash of the id).
LABELLED_ROWS = 6_000
CELLS = 2048
DIM = 48
NEIGHBOURS = 25
BLOCK = 1024

#: Character kinds by byte: letters and digits fall together, other signs stay apart; UTF-8 beyond ASCII counts as small letters.
_KIND = np.arange(256, dtype=np.int64)
_KIND[ord("a"):ord("z") + 1] = ord("a")
_KIND[ord("A"):ord("Z") + 1] = ord("A")
_KIND[ord("0"):ord("9") + 1] = ord("0")
_KIND[128:] = ord("a")
_MEASURES = 64


def _measures(raw: bytes) -> list[int]:
    """Cells of coarse measures of a text, eight levels each."""
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    pairs = set(zip(words, words[1:]))
    level = lambda x: int(min(7, max(0, x * 8)))
    values = [len(set(words)) / n, len(pairs) / max(1, n - 1), len(set(lines)) / max(1, len(lines)),
              min(1.0, sum(map(len, words)) / n / 16), min(1.0, np.log2(n + 1) / 15), min(1.0, np.log2(n / max(1, len(lines)) + 1) / 10),
              sum(a == b for a, b in zip(words, words[1:])) / n]
    return [8 * k + level(x) for k, x in enumerate(values)]


def features(text: str | None) -> np.ndarray:
    """Counts of cells; zeros for a text without words."""
    out = np.zeros(CELLS + _MEASURES, np.float32)
    raw = (text or "").encode()
    if not raw.split():
        return out
    kinds = _KIND[np.frombuffer(b" " + raw + b" ", np.uint8)]
    code = (kinds[:-2] * 131 + kinds[1:-1]) * 131 + kinds[2:]
    out[:CELLS] = np.log1p(np.bincount(code % CELLS, minlength=CELLS))
    out[:CELLS] /= max(1e-6, np.linalg.norm(out[:CELLS]))
    out[[CELLS + c for c in _measures(raw)]] = 0.4
    return out


def fit(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(projection, labelled vectors, labels) from at most LABELLED_ROWS rows (text, label)."""
    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"x": [features(t).tobytes() for t in frame["text"]], "label": frame["label"]})

    rows = labelled.mapInPandas(turn, "x binary, label double").toPandas()  # bounded by LABELLED_ROWS
    if not len(rows):
        return None
    x = np.stack([np.frombuffer(r, np.float32) for r in rows["x"]])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.1
    x = x * idf
    d = min(DIM, *x.shape)
    rng = np.random.default_rng(4)
    basis = rng.standard_normal((x.shape[1], d + 16)).astype(np.float32)
    for _ in range(4):  # subspace iteration on the tall matrix
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
    projection = (idf[:, None] * (basis @ vt.T[:, :d])).astype(np.float32)
    return projection, _unit(x / idf @ projection), rows["label"].to_numpy()


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def vote(vectors: np.ndarray, labelled: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The labels of the nearest labelled vectors, weighted by similarity; the mean label for a zero vector."""
    k = min(NEIGHBOURS, len(labels))
    out = np.full(len(vectors), labels.mean())
    there = np.flatnonzero(np.abs(vectors).sum(axis=1) > 0)
    for lo in range(0, len(there), BLOCK):
        at = there[lo:lo + BLOCK]
        cosine = vectors[at] @ labelled.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1).astype(float), 1e-6) ** 8
        out[at] = (weight * labels[near]).sum(axis=1) / weight.sum(axis=1)
    return np.clip(out, 0.0, 1.0)


def score_quality(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Add ``score``, the likelihood of label 1 by the vote of similar labelled texts, to the rows of ``docs``.

    ``labelled`` is (doc_id, text, label); rows with a null label or id are left
    out, a null text counts as empty.  Of more than LABELLED_ROWS rows those with
    the least hash of the id are used.  Only the text is an input of a score.
    Null texts and texts without words get the mean label; without labelled rows
    every score is 0.5.  Repeated rows and extra columns are kept as they are; an
    empty table gives an empty result.
    """
    some = labelled.select("doc_id", "text", F.col("label").cast("double").alias("label")).where("doc_id is not null and label is not null")
    model = docs.sparkSession.sparkContext.broadcast(fit(some))

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        if model.value is None:
            return pd.Series(np.full(len(column), 0.5))
        projection, vectors, labels = model.value
        parts = [np.zeros(0)]
        for lo in range(0, len(column), BLOCK):
            x = np.stack([features(t) for t in column.iloc[lo:lo + BLOCK]])
            empty = x.sum(axis=1) == 0
            v = _unit(x @ projection)
            v[empty] = 0
            parts.append(vote(v, vectors, labels))
        return pd.Series(np.concatenate(parts))

    return docs.withColumn("score", score(F.col("text")))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of at most LABELLED_ROWS rows of ``labels(doc_id, label)`` that have a document."""
    chosen = labels.dropna().dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learned from labels of rows with crc32(doc_id) mod 5 other than 0."""
    docs = documents(spark, sf_dir)
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    scored = score_quality(docs.select("doc_id", "text"), labelled_sample(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
