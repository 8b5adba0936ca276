"""Removal of repeated word windows by level-wise doubling.

A window of 35 words can only be repeated if the windows of 18 words in it are,
and those only if the windows of 9 words in them are.  So the levels are 9, 18, 35
words (each twice the one before, the halves overlapping by a word where needed);
only windows repeated at one level are extended to the next, until the wanted
length is reached or no candidate survives.  The two lower levels look at
anchors alone: in each window of 35 words the 9-word window with the least hash,
which equal windows have in the same place.

Texts with the same words form a class; all windows of a class of two or more
are repeated, and only its first document goes on.  Hashes of windows are numpy
work in tasks; what is repeated is found by Spark's counts and joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwarden.llm.text import documents, unnest
from ringwarden.staging import Staging

_ODDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(x, -1, 1 << 64) for x in _ODDS)
_BYTES = np.random.default_rng(35).integers(1, 1 << 63, (2, 256)).astype(np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _ODDS]


def _power(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd multiplier and of its inverse, modulo 2**64."""
    known = _powers[which]
    if len(known[0]) < n:
        for k, base in enumerate((_ODDS[which], _INVERSES[which])):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            known[k] = np.cumprod(steps)
    return known[0][:n], known[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes, which: int = 0) -> np.ndarray:
    """A 64-bit hash, of two, of every word (run without ASCII white space) of UTF-8 bytes."""
    raw = np.frombuffer(text, np.uint8)
    solid = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    begin, end = edge[::2], edge[1::2]
    power, inverse = _power(len(raw) + 1, which)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[which][raw] * power[: len(raw)], dtype=np.uint64)])
    return _mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words from the words' hashes, by doubling."""
    length = 1
    while length < n:
        step = min(length, n - length)
        if len(h) <= step:
            return h[:0]
        h = _mix(h[:-step] * np.uint64(0xD6E8FEB86659FD93) + (h[step:] ^ np.uint64(0xA0761D6478BD642F)))
        length += step
    return h


def anchors(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """For every window of ``n`` words the start of its ``seed``-word window with the least hash."""
    small = window_hashes(h, seed)
    width = n - seed + 1
    if len(small) < width:
        return np.zeros(0, np.int64)
    return np.arange(len(small) - width + 1) + np.lib.stride_tricks.sliding_window_view(small, width).argmin(axis=1)


def _scan(n: int, seed: int):
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(3)
        for frame in frames:
            out = []
            for doc, text in zip(frame["doc"], frame["text"]):
                raw = text.encode() if text is not None else b""
                words = raw.split()
                h = word_hashes(raw) if len(words) >= n else np.zeros(0, np.uint64)
                at = np.unique(anchors(h, n, seed))
                out.append((doc, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), at.astype(np.int32),
                            window_hashes(h, seed)[at].view(np.int64), press.compress(raw)))
            yield pd.DataFrame(out, columns=["doc", "n_words", "sha", "pos", "hash", "z"])

    return scan


def _texts(frame: pd.DataFrame) -> Iterator[bytes]:
    open_ = zstandard.ZstdDecompressor()
    return (open_.decompress(z) for z in frame["z"])


def _table(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """One frame of (row, names...) from a document and its arrays in each row."""
    size = [len(r[1]) for r in rows]
    columns = {"row": np.repeat([r[0] for r in rows], size)} if rows else {"row": []}
    for k, name in enumerate(names, 1):
        columns[name] = np.concatenate([r[k] for r in rows]) if rows else []
    return pd.DataFrame(columns)


def _extend(n: int, seed: int):
    """Rows (row, pos, side, hash): surviving anchors extended to twice their length, to either side."""
    twice = 2 * seed

    def extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text, pos in zip(frame["row"], _texts(frame), frame["pos"]):
                big = window_hashes(word_hashes(text), twice).view(np.int64)
                at = np.asarray(pos, np.int64)
                right, left = at[at < len(big)], at[(at >= seed) & (at - seed < len(big))]
                rows.append((doc, np.concatenate([right, left]), np.repeat([0, 1], [len(right), len(left)]),
                             np.concatenate([big[right], big[left - seed]])))
            yield _table(rows, ["pos", "side", "hash"])

    return extend


def _windows(n: int, seed: int):
    """Rows (row, pos, hash, hash2): windows of ``n`` words all of whose extended anchors are repeated."""
    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text, sides in zip(frame["row"], _texts(frame), frame["sides"]):
                h = word_hashes(text)
                anchor = anchors(h, n, seed)
                start = np.arange(len(anchor))
                known = np.zeros((2, len(h) + 1), bool)
                for s in sides:
                    known[s % 2, s // 2] = True
                offset = anchor - start
                good = ((offset > n - 2 * seed) | known[0, anchor]) & ((offset < seed) | known[1, anchor])
                at = start[good]
                rows.append((doc, at, window_hashes(h, n)[at].view(np.int64), window_hashes(word_hashes(text, 1), n)[at].view(np.int64)))
            yield _table(rows, ["pos", "hash", "hash2"])

    return windows


def _cut(n: int):
    """Rows (row, n_removed, kept_sha256) of documents with repeated windows."""
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text, pos in zip(frame["row"], _texts(frame), frame["pos"]):
                words = text.split()
                step = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.asarray(pos, np.int64))
                step[at] += 1
                step[at + n] -= 1
                gone = np.cumsum(step)[:-1] > 0
                kept = b" ".join([w for w, g in zip(words, gone) if not g])
                out.append((doc, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pd.DataFrame(out, columns=["row", "n_removed", "kept_sha256", "kept"])

    return cut


def repeated(rows: DataFrame, keys: list[str], stage: Staging, name: str) -> DataFrame:
    """The rows whose key occurs twice or more.

    The counts are stored first, so that the join with them is an ordinary one
    that adaptive execution can split where a key is very frequent.
    """
    counts = stage.save(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys), name)
    return rows.join(counts, keys, "left_semi")


def remove_repeats(docs: DataFrame, n: int = 35) -> DataFrame:
    """Remove every word in a window of ``n`` words that also starts anywhere else, in the same document or another.

    Words are runs without ASCII white space, unchanged; windows are judged on
    the input.  Returns (doc_id, n_words, n_removed, kept, kept_sha256): kept, the
    kept words joined by single spaces, is null where nothing was removed and the
    text stands; kept_sha256 is its hash in either case.  ``n`` is 4 or more.
    Every row is a document of its own, whatever its doc_id: rows with null or repeated
    ids are judged, counted and returned like others, once each.
    Null or empty texts have no words; a text of fewer than ``n`` words has no
    window and stays, copies included; equal texts of ``n`` words or more, so also repeated
    rows, all lose every word.  Texts of any length are read whole, one at a time.  Windows
    are equal when 128 bits are; fewer bits decide only what is looked at again.  Other
    columns are not read; an empty table gives an empty result.
    """
    stage = Staging(docs.sparkSession)
    seed = -(-n // 4)
    ids = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select(F.col("doc_id").cast("string").alias("doc"), "text")
    scanned = stage.save(read.mapInPandas(_scan(n, seed), "doc string, n_words long, sha string, pos array<int>, hash array<bigint>, z binary")
                         .withColumn("row", F.monotonically_increasing_id()), "scan")
    classes = stage.save(scanned.where(f"n_words >= {n}").groupBy("sha").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies"))
                         .where("copies > 1"), "classes")
    info = stage.save(scanned.select("row", "doc", "n_words", "sha").join(classes, "sha", "left"), "info")
    later = info.where("row <> first").select("row")
    first = scanned.select("row", F.arrays_zip("pos", "hash").alias("a")).join(later, "row", "left_anti")
    seeds = stage.save(unnest(first, "a", "a", "row").select("row", "a.pos", "a.hash"), "seeds")

    def with_texts(found: DataFrame, texts: DataFrame) -> DataFrame:
        return texts.join(found, "row")

    by_row = stage.save(repeated(seeds, ["hash"], stage, "seed-counts").groupBy("row").agg(F.collect_list("pos").alias("pos")), "seeded")
    live = stage.save(with_texts(by_row, scanned.select("row", "z")), "live")
    stage.drop(scanned, seeds, by_row)
    wider = stage.save(live.mapInPandas(_extend(n, seed), "row long, pos int, side int, hash long"), "wider")
    sides = (repeated(wider, ["hash", "side"], stage, "wider-counts").groupBy("row")
             .agg(F.collect_list(F.col("pos") * 2 + F.col("side")).alias("sides")))
    texts = live.select("row", "z")
    full = stage.save(with_texts(sides, texts).mapInPandas(_windows(n, seed), "row long, pos int, hash long, hash2 long"), "windows")
    stage.drop(wider)
    spots = repeated(full, ["hash", "hash2"], stage, "window-counts").groupBy("row").agg(F.collect_list("pos").alias("pos"))
    cut = with_texts(spots, texts).mapInPandas(_cut(n), "row long, n_removed long, kept_sha256 string, kept string")
    copy = F.col("copies").isNotNull()
    return info.join(cut, "row", "left").select(
        F.col("doc").cast(ids).alias("doc_id"), "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of 35 words removed from all documents."""
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_OP5 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM s) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM t WHERE len(w) > 0),
k AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY j) AS kept FROM p ANTI JOIN c USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
