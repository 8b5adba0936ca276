"""Approximate nearest neighbours by additive quantisation.

A vector's direction is approximated by a sum of full-dimensional codewords, one
from each codebook, found by beam search over residuals.  Codebooks start as
k-means of residuals and are refitted together by least squares.  What the first
set of books leaves out is coded again, as a direction of its own, by a second set,
and both sums get the weights that fit the vector best.  Every book but the first
of a set has a zero word, so a large group of near copies has its middle as its
code, the second set tells its vectors apart as finely, in proportion, as vectors
that differ much, and the weights leave no error along the middle.  A query's inner
products with all codewords form a lookup table; the approximate score of a code is
the weighted sum of table entries times the vector's stored norm.

Codes and queries meet in blocks (a block of queries by a chunk of codes), and
only codes travel there.  The best codes of a query, over all chunks, are its
shortlist; the rows on it, and no others, are scored exactly on their vectors.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringwarden.staging import Staging

#: Vectors that the codebooks are fitted on, at most (by hash of the id); every vector is indexed.
TRAINING_ROWS = 16_384
#: Codebooks of each of the two sets, words in a book, partial codes kept in the search.
BOOKS = 8
WORDS = 256
BEAM = 4
#: Codes in a chunk and queries in a block, about.
CHUNK = 131_072
BLOCK = 512
#: Rows that are scored exactly for a query.
SHORTLIST = 600


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres ** 2).sum(axis=1)).argmax(axis=1)
        sums, count = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centres


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x books) by beam search over residuals, and what they leave out."""
    n, m = len(x), len(books)
    residual, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1, m), np.uint8)
    for j in range(m):
        flat = residual.reshape(-1, residual.shape[2])
        cost = ((flat ** 2).sum(axis=1)[:, None] - 2 * flat @ books[j].T + (books[j] ** 2).sum(axis=1)).reshape(n, -1)
        keep = min(BEAM, cost.shape[1])
        best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
        beam, word = best // WORDS, best % WORDS
        codes = np.take_along_axis(codes, beam[:, :, None], axis=1)
        codes[:, :, j] = word
        residual = np.take_along_axis(residual, beam[:, :, None], axis=1) - books[j][word]
    at = np.arange(n), (residual ** 2).sum(axis=2).argmin(axis=1)
    return codes[at], residual[at]


def _fit(x: np.ndarray, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """Codebooks (books x words x dim): k-means of residuals, then joint least squares with the codes of each round."""
    residual, books = x.astype(np.float32), []
    for j in range(BOOKS):
        centres = _kmeans(residual, WORDS, rng)
        if j:
            centres[0] = 0
        books.append(centres)
        residual = residual - centres[(residual @ centres.T - 0.5 * (centres ** 2).sum(axis=1)).argmax(axis=1)]
    books = np.stack(books)
    zero = np.arange(1, BOOKS) * WORDS
    for _ in range(rounds):
        flat = _coded(x, books)[0].astype(np.int64) + np.arange(BOOKS) * WORDS
        gram, right = np.zeros((BOOKS * WORDS, BOOKS * WORDS)), np.zeros((BOOKS * WORDS, x.shape[1]))
        for a in range(BOOKS):
            np.add.at(right, flat[:, a], x)
            for b in range(BOOKS):
                np.add.at(gram, (flat[:, a], flat[:, b]), 1.0)
        gram[zero], gram[:, zero], right[zero] = 0, 0, 0
        # The former words weigh as one observation each, which rare words need.
        books = np.linalg.solve(gram + np.eye(len(gram)), right + books.reshape(-1, x.shape[1])).reshape(books.shape).astype(np.float32)
    return books


def _coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [encode(part, books) for part in np.array_split(x, len(x) // 512 + 1)]
    return np.concatenate([c for c, _ in parts]), np.concatenate([r for _, r in parts])


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths of vectors of any finite size; a zero vector stays zero."""
    most = np.abs(x).max(axis=1, keepdims=True)
    scaled = x / np.where(most > 0, most, 1)
    length = np.linalg.norm(scaled, axis=1, keepdims=True)
    with np.errstate(over="ignore"):
        return scaled / np.where(length > 0, length, 1), np.minimum((most * length)[:, 0], np.finfo(np.float64).max)


def train(x: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Two sets of codebooks (2 x books x words x dim) for unit vectors: for directions, and for what is left of them."""
    rng = np.random.default_rng(8)
    coarse = _fit(x, rng, rounds)
    return np.stack([coarse, _fit(_unit(_coded(x, coarse)[1].astype(np.float64))[0], rng, rounds)])


def _sums(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The sums of codewords that ``codes`` name, in double precision."""
    total = books[0][codes[:, 0]].astype(np.float64)
    for j in range(1, len(books)):
        total += books[j][codes[:, j]]
    return total


def quantise(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights): the codes of unit vectors in both sets of books and the weights of both sums, by least squares."""
    first, left = _coded(x, books[0])
    second = _coded(_unit(left.astype(np.float64))[0], books[1])[0]
    a, b = _sums(first, books[0]), _sums(second, books[1])
    aa, bb, ab, xa, xb = (a * a).sum(axis=1), (b * b).sum(axis=1), (a * b).sum(axis=1), (x * a).sum(axis=1), (x * b).sum(axis=1)
    area = aa * bb - ab * ab
    both = area > 1e-9 * aa * bb
    area, alone = np.where(both, area, 1), np.where(aa > 0, xa / np.where(aa > 0, aa, 1), 0)
    weights = np.where(both, (xa * bb - xb * ab) / area, alone), np.where(both, (xb * aa - xa * ab) / area, 0)
    return np.concatenate([first, second], axis=1), np.stack(weights, axis=1)


def _number(vectors: DataFrame) -> Column:
    kind = vectors.schema["embedding"].dataType.simpleString()
    return F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) of vectors without null or non-finite components that are not zero."""
    return (vectors.select("vec_id", _number(vectors).alias("embedding")).where("embedding is not null and size(embedding) > 0")
            .where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
            .where(F.exists("embedding", lambda x: x != 0)))


def _matrix(embeddings: pd.Series, dim: int) -> np.ndarray:
    """The vectors in double precision, shorter ones filled up with zeros."""
    out = np.zeros((len(embeddings), dim))
    for i, e in enumerate(embeddings):
        out[i, :len(e)] = e
    return out


def _top(approx: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest values, of equal ones the first."""
    if len(approx) <= k:
        return np.arange(len(approx))
    edge = np.partition(approx, len(approx) - k)[len(approx) - k]
    over = np.flatnonzero(approx > edge)
    return np.concatenate([over, np.flatnonzero(approx == edge)[: k - len(over)]])


def _products(v: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; where a term overflows, that of scaled vectors scaled back."""
    with np.errstate(over="ignore", invalid="ignore"):
        plain = (v * query).sum(axis=1)
        if np.isfinite(plain).all():
            return plain
        a, b = np.abs(v).max(axis=1), np.abs(query).max()
        return np.where(np.isfinite(plain), plain, ((v / a[:, None]) * (query / b)).sum(axis=1) * a * b)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, shortlist: int = SHORTLIST) -> DataFrame:
    """For each row of ``queries`` its ``k`` nearest rows of ``vectors`` by inner product, but for its own id.

    Both are (vec_id, embedding).  Returns (query_id, rank from 1, vec_id, score):
    score is the inner product of the original vectors in double precision, ties
    go to the smaller vec_id (null last); all candidates are returned where there
    are fewer than ``k``.  Vectors that are null, zero or hold null or non-finite
    components take no part.  Vectors may differ in length: a shorter one counts
    as filled up with zeros.  Rows that repeat a vec_id, or have none, are
    candidates of their own, and a query without an id has all of them; other
    columns are not read; empty tables give an empty result.
    """
    spark = vectors.sparkSession
    stage = Staging(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    number = lambda df, name: stage.save(usable(df).withColumn("row", F.monotonically_increasing_id()), name)
    good, asked = number(vectors, "vectors"), number(queries, "queries").withColumnsRenamed({"vec_id": "query_id", "embedding": "query", "row": "ask"})
    dims = [df.agg(F.max(F.size(c)), F.count(F.lit(1))).first() for df, c in ((good, "embedding"), (asked, "query"))]
    if not (dims[0][1] and dims[1][1]):
        return spark.createDataFrame([], schema)
    dim = max(d[0] for d in dims)
    chunks, blocks = dims[0][1] // CHUNK + 1, dims[1][1] // BLOCK + 1
    shortlist = max(shortlist, k)
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(TRAINING_ROWS).toPandas()  # bounded
    shared = spark.sparkContext.broadcast(train(_unit(_matrix(sample["embedding"], dim))[0]))

    def index(frames):
        for frame in frames:
            for start in range(0, len(frame), 2048):
                part = frame.iloc[start:start + 2048]
                unit, norm = _unit(_matrix(part["embedding"], dim))
                codes, weights = quantise(unit, shared.value)
                yield pd.DataFrame({"row": part["row"], "vec_id": part["vec_id"], "norm": norm, "coarse": weights[:, 0], "fine": weights[:, 1], "code": [c.tobytes() for c in codes]})

    coded = stage.save(good.mapInPandas(index, "row long, vec_id long, norm double, coarse double, fine double, code binary"), "codes")
    # A random share of the shortlist comes from each chunk, for rows are dealt by hash; six deviations and sixteen more are allowed.
    share = min(shortlist, ceil(shortlist / chunks + 6 * sqrt(shortlist / chunks)) + 16)
    block_of = F.pmod(F.xxhash64("ask"), F.lit(blocks)).cast("int")
    asked = asked.withColumn("block", block_of)
    left = coded.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def meet(rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        """The best codes of a chunk for each query of a block, by lookup tables."""
        out = []
        if len(rows) and len(block):
            rows = rows.sort_values("vec_id", kind="stable", na_position="last")
            row, ids, norm, coarse, fine = (rows[c].to_numpy() for c in ("row", "vec_id", "norm", "coarse", "fine"))
            code = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
            code = [np.ascontiguousarray(code[:, j]).astype(np.intp) for j in range(2 * BOOKS)]
            books = shared.value.reshape(2 * BOOKS, WORDS, dim).astype(np.float64)
            for ask, query_id, query in zip(block["ask"], block["query_id"], _unit(_matrix(block["query"], dim))[0]):
                table = books @ query
                sums = [np.zeros(len(row)), np.zeros(len(row))]
                for j in range(2 * BOOKS):
                    sums[j // BOOKS] += table[j].take(code[j])
                approx = np.where(ids == query_id, -np.inf, (coarse * sums[0] + fine * sums[1]) * norm)
                best = _top(approx, share + 1)
                best = best[ids[best] != query_id]
                out.append(pd.DataFrame({"ask": ask, "row": row[best], "vec_id": ids[best], "approx": approx[best]}))
        return pd.concat(out).astype({"vec_id": "Int64"}) if out else pd.DataFrame({"ask": [], "row": [], "vec_id": [], "approx": []})

    met = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(meet, "ask long, row long, vec_id long, approx double")
    order = Window.partitionBy("ask").orderBy(F.desc("approx"), F.asc_nulls_last("vec_id"), "row")
    listed = stage.save(met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= shortlist).select("ask", "row"), "shortlists")
    wanted = listed.select(block_of.alias("block"), "row").distinct().join(good, "row").select("block", "row", "vec_id", "embedding")
    lists = asked.join(listed.groupBy("ask").agg(F.collect_list("row").alias("rows")), "ask")

    def rerank(rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        """Exact scores of the shortlists of a block, each of at most ``shortlist`` rows."""
        out = []
        rows = rows.sort_values("row")
        row, ids, v = rows["row"].to_numpy(), rows["vec_id"].to_numpy(), _matrix(rows["embedding"], dim)
        last = np.where(pd.isna(ids), np.inf, ids.astype(np.float64))
        for query_id, query, some in zip(block["query_id"], _matrix(block["query"], dim), block["rows"]):
            at = np.searchsorted(row, np.sort(some))
            score = _products(v[at], query)
            best = np.lexsort((at, last[at], -score))[:k]
            out.append(pd.DataFrame({"query_id": query_id, "rank": np.arange(1, len(best) + 1), "vec_id": ids[at][best], "score": score[best]}))
        return pd.concat(out).astype({"vec_id": "Int64"}) if out else pd.DataFrame({"query_id": [], "rank": [], "vec_id": [], "score": []})

    return wanted.groupBy("block").cogroup(lists.groupBy("block")).applyInPandas(rerank, schema)


def op8_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every embedding whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
