"""Language identification as inference of a mixture of languages.

A document is a mixture: each word comes from one language, whose byte trigrams
give the word's likelihood.  Expectation-maximisation estimates the proportions of
the languages in the document; of the nested sets made of its strongest 1, 2, ...
languages the one with the best penalised likelihood (half a log of the number
of words for each further language) is taken.

The trigram counts of a language are sums over all training documents.  They are
kept in a fixed number of hash cells, so the model is a small table whatever the
corpus.  Words, trigrams and the mixture are numpy work on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwarden.llm.text import crc_mod, documents

CELLS = 1 << 15
#: Bytes of text that one numpy step takes at once with up to 64 languages; with more it takes less.
STEP_BYTES = 1 << 20


def letters_only(text: Column) -> Column:
    """Lower-cased runs of letters with their combining marks, one space between them; '' for null."""
    runs = F.regexp_replace(text, r"[^\p{L}\p{M}]+", " ")
    spaced = F.concat(F.lit(" "), F.ltrim(runs))
    owned = F.regexp_replace(F.regexp_replace(spaced, r" \p{M}+(?= |$)", ""), r" \p{M}+", " ")  # marks without a letter go
    return F.coalesce(F.lower(F.trim(F.when(text.rlike(r"\p{M}"), owned).otherwise(runs))), F.lit(""))


def trigram_cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each trigram, number of its word, first word of each text and the end) of space-separated texts."""
    joined = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8).astype(np.uint32)
    code = (joined[:-2] * np.uint32(0x9E3779B1)) ^ (joined[1:-1] * np.uint32(0x85EBCA77)) ^ (joined[2:] * np.uint32(0xC2B2AE3D))
    cell = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    space = joined == 32
    word = np.cumsum(space)[:-2] - 1
    use = ~space[1:-1]  # a trigram belongs to the word of its middle byte
    starts = np.concatenate([[0], np.cumsum([t.count(b" ") + 1 for t in texts])])
    return cell[use].astype(np.int64), word[use], starts


def batches(texts: list[bytes], languages: int = 1) -> Iterator[tuple[int, int]]:
    """Slices of the list with about STEP_BYTES bytes, fewer with many languages."""
    begin, size, step = 0, 0, STEP_BYTES * 64 // max(64, languages)
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= step or i == len(texts) - 1:
            yield begin, i + 1
            begin, size = i + 1, 0


def count_trigrams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of one task: (lang, cell, n)."""
    sums: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, group in frame.groupby("lang"):
            texts = [t.encode() for t in group["t"]]
            total = sums.setdefault(lang, np.zeros(CELLS, np.int64))
            for lo, hi in batches(texts):
                total += np.bincount(trigram_cells(texts[lo:hi])[0], minlength=CELLS)
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "cell": at, "n": total[at]})


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of each cell by language) from rows (t, lang)."""
    top = [r["lang"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]  # languages, not rows
    sums = labelled.mapInPandas(count_trigrams, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counts = np.zeros((CELLS, len(top)))
    place = {lang: k for k, lang in enumerate(top)}
    for r in sums.toLocalIterator():  # CELLS x languages at most
        counts[r["cell"], place[r["lang"]]] = r["n"]
    return top, np.log(counts + 0.1) - np.log(counts.sum(axis=0) + 0.1 * CELLS)


def mixture(like: np.ndarray, begins: np.ndarray, allowed: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) by document for word likelihoods, restricted to the allowed languages.

    ``like`` has a row a word (largest entry 1), ``begins`` the first word of each document.
    """
    size = np.diff(np.append(begins, len(like)))
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        joint = like * np.repeat(share, size, axis=0)
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, begins, axis=0) / size[:, None]
    total = np.log((like * np.repeat(share, size, axis=0)).sum(axis=1))
    return share, np.add.reduceat(total, begins)


def proportions(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """The proportions of the languages in each text, zero outside the chosen set; every text has a word."""
    cell, word, starts = trigram_cells(texts)
    n_words, n_lang = int(starts[-1]), table.shape[1]
    log_like = np.stack([np.bincount(word, table[cell, k], minlength=n_words) for k in range(n_lang)], axis=1)
    log_like -= log_like.max(axis=1, keepdims=True)
    like, begins = np.exp(np.maximum(log_like, -30.0)), starts[:-1]
    size = np.diff(starts)
    full, _ = mixture(like, begins, np.ones((len(texts), n_lang)))
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n_lang)[None, :], axis=1)
    best, chosen = np.full(len(texts), -np.inf), np.zeros_like(full)
    live = np.arange(len(texts))
    for k in range(1, n_lang + 1):
        take = np.repeat(np.isin(np.arange(len(texts)), live), size)
        share, total = mixture(like[take], np.concatenate([[0], np.cumsum(size[live])[:-1]]), (rank[live] < k).astype(float) + 1e-12, 12 if k > 1 else 1)
        score = total - 0.5 * (k - 1) * np.log(size[live] + 1.0)
        better = score > best[live]
        best[live[better]], chosen[live[better]] = score[better], share[better]
        live = live[better]  # once a further language does not pay, none does
        if not len(live):
            break
    return chosen


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Add lang_pred, score and languages to the rows of ``docs``.

    ``training`` gives text and lang; rows without either are not learned from.
    lang_pred is the language with the largest proportion (the more frequent one
    in training on a tie), score that proportion, languages the chosen set with
    its proportions, largest first.  Text that is null or has no letter gets
    ``und``, score 0 and no languages, as does all text if nothing was learned.
    Every language of ``training`` is learned, however rare; the model has CELLS
    numbers a language.  Very long texts are judged whole, in one numpy step each.
    Nothing but the text is an input of a prediction; repeated rows and extra
    columns are kept as they are; an empty table gives an empty result.
    """
    learn = training.where("lang is not null and text is not null").select(letters_only(F.col("text")).alias("t"), "lang").where("t <> ''")
    names, table = train(learn)
    shared = docs.sparkSession.sparkContext.broadcast((names, table))
    kind = "struct<lang_pred:string,score:double,languages:array<struct<lang:string,share:double>>>"

    @F.pandas_udf(kind)
    def predict(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, table = shared.value
        for column in series:
            texts = [t.encode() for t in column]
            out = [("und", 0.0, [])] * len(texts)
            where = [i for i, t in enumerate(texts) if t] if names else []
            there = [texts[i] for i in where]
            for lo, hi in batches(there, len(names)):
                share = proportions(there[lo:hi], table)
                order = np.argsort(-share, axis=1, kind="stable")
                for j in range(hi - lo):
                    ranked = [(names[k], float(share[j, k])) for k in order[j] if share[j, k] > 1e-6]
                    out[where[lo + j]] = (*ranked[0], [{"lang": a, "share": b} for a, b in ranked])
            yield pd.DataFrame(out, columns=["lang_pred", "score", "languages"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "languages")]
    return docs.withColumn("_found", predict(letters_only(F.col("text")))).select(*[F.col(f"`{c}`") for c in kept], "_found.*")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those with crc32(doc_id) mod 4 other than 2."""
    docs = documents(spark, sf_dir)
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    found = identify(docs.select("doc_id", "text"), docs.where(~held_out).select("text", "lang"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
