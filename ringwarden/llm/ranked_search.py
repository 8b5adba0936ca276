"""Ranked lexical search of many items at once, with shared parts evaluated once.

Terms that stand in the same items as often form one set.  Sets that several items
share are joined pair by pair, most shared first, into larger sets until no pair is
shared: a graph in which every node is the sum of two others.  For each block of
documents a node's partial scores are made once, in the graph's order, and every
item adds up the few nodes it uses.

A document is one row, so its counts, its partial scores and its place in an
item's list need no exchange of texts; only N, L, the document frequencies and each
task's best rows travel.  Items beyond ``block_terms`` terms are searched in blocks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringwarden.llm.text import ascii_lower, documents, words
from ringwarden.staging import Staging

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Letters lower-cased, other bytes of no term made blanks; beyond ASCII every byte belongs to a term.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Partial scores held at once in a task, at most (one document's, if more).
CELLS = 1 << 21


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(TABLE).split() if text else []


@dataclass
class Sharing:
    """A graph of term sets: the set of each term, pairs of nodes that make further nodes, and (nodes, times) of every item."""

    terms: dict[bytes, int]
    sets: np.ndarray
    n_sets: int
    pairs: list[tuple[int, int]]
    items: list[tuple[int, np.ndarray, np.ndarray]]


def shared_sets(rows: list[tuple[int, bytes, int]]) -> Sharing:
    """The sharing graph of (item, term, times): equal signatures first, then the pairs that most items share."""
    where = defaultdict(list)
    for item, term, times in sorted(rows):
        where[term].append((item, times))
    terms = {term: k for k, term in enumerate(where, 1)}
    number = {}
    sets = np.array([-1] + [number.setdefault(tuple(s), len(number)) for s in where.values()], np.int64)
    uses = defaultdict(set)
    for signature, node in number.items():
        for item, times in signature:
            uses[item, times].add(node)
    n_sets, pairs = len(number), []
    while True:
        seen = Counter()
        for nodes in uses.values():
            order = sorted(nodes)
            seen.update((a, b) for i, a in enumerate(order) for b in order[i + 1:])
        best, taken = [], set()
        for (a, b), n in sorted(((p, n) for p, n in seen.items() if n > 1), key=lambda x: (-x[1], x[0])):
            if a not in taken and b not in taken:
                taken |= {a, b}
                best.append((a, b))
        if not best:
            break
        for a, b in best:
            node = n_sets + len(pairs)
            pairs.append((a, b))
            for nodes in uses.values():
                if a in nodes and b in nodes:
                    nodes -= {a, b}
                    nodes.add(node)
    plan = defaultdict(list)
    for (item, times), nodes in sorted(uses.items()):
        plan[item] += [(node, times) for node in sorted(nodes)]
    return Sharing(terms, sets, n_sets, pairs, [(item, *(np.array(x, np.int64) for x in zip(*uses_))) for item, uses_ in plan.items()])


def _count(terms: dict[bytes, int]):
    """(doc_id, n, term, tf): what a document holds of ``terms``, by number."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = terms.get
        for batch in batches:
            n, size, found, times = [], [0], [], []
            for text in batch.column(1):
                held = terms_of(text.as_py())
                known, tf = np.unique(np.fromiter(filter(None, map(get, held)), np.int32), return_counts=True)
                n.append(len(held))
                size.append(size[-1] + len(known))
                found.append(known)
                times.append(tf)
            flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            lists = [pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(flat(p, kind))) for p, kind in ((found, np.int32), (times, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])

    return count


class _Best:
    """The k best (score, document) of every item, more score first, then the smaller id; rows without an id come last."""

    def __init__(self, items: int, k: int):
        self.k, self.rows = k, [(np.zeros(0, np.int64),) * 3 for _ in range(items)]

    def add(self, item: int, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        old = self.rows[item]
        least = old[0][-1] if len(old[0]) == self.k else 1
        at = np.flatnonzero(score >= least)
        if len(at):
            s, z, d = (np.concatenate([a, b[at]]) for a, b in zip(old, (score, none, ids)))
            order = np.lexsort((d, z, -s))[: self.k]
            self.rows[item] = s[order], z[order], d[order]


def _score(graph: Sharing, weights: np.ndarray, n_docs: int, length: int, k: int):
    """(item, doc_id, score): the best documents of each item in a task."""
    step = max(1, CELLS // max(1, graph.n_sets + len(graph.pairs)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(graph.items), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                n = part.column(1).to_numpy(zero_copy_only=False)
                ids = part.column(0)
                none, ids = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(n)), part.column(2).value_lengths().to_numpy(zero_copy_only=False))
                term, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
                m = 75 + (25 * n[row] * n_docs) // length
                acc = np.zeros((graph.n_sets + len(graph.pairs), len(n)), np.int64)
                np.add.at(acc, (graph.sets[term], row), weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m)))
                for node, (a, b) in enumerate(graph.pairs, graph.n_sets):
                    np.add(acc[a], acc[b], out=acc[node])
                for at, (_, nodes, times) in enumerate(graph.items):
                    best.add(at, times @ acc[nodes], none, ids)
        rows = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*best.rows)] or [np.zeros(0, np.int64)] * 3
        item = np.repeat([i for i, _, _ in graph.items], [len(r[0]) for r in best.rows]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(rows[2], mask=rows[1] > 0), pa.array(rows[0])], names=["item", "doc_id", "score"])

    return score


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = 50_000) -> DataFrame:
    """The ``k`` documents (doc_id, text) of highest score for every item (item_id, text).

    Returns (item_id, rank, doc_id, score); scores are above 0, equal ones go by
    doc_id.  A null or empty text has no terms: such a document is never returned,
    such an item gets no rows.  Every row counts as a document and as an item of its
    own, repeated rows too: repeated documents each take a rank, rows with equal
    item_ids each get a list.  A null doc_id comes after others of the same score.
    Texts of any length are read whole, one at a time.  An empty table gives an empty
    result; other columns are not read.  Items go in blocks of about ``block_terms``
    different terms, whose graph is the only thing sent to all tasks.
    """
    stage = Staging(docs.sparkSession)
    asked = stage.save(items.select("item_id", words(ascii_lower(F.col("text")), TERM).alias("terms")), "items")
    asked = stage.save(asked.where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()), "numbered")
    each = asked.select("item", F.explode("terms").alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))
    blocks = -(-(asked.agg(F.coalesce(F.sum(F.size(F.array_distinct("terms"))), F.lit(0))).first()[0]) // block_terms)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    found = None
    for b in range(blocks):
        mine = each.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        graph = shared_sets([(r.item, r.term.encode(), r.times) for r in mine.collect()])
        if not graph.items:
            continue
        counted = stage.save(texts.mapInArrow(_count(graph.terms), "doc_id long, n long, term array<int>, tf array<bigint>"), "counted")
        n_docs, length = counted.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(graph.terms) + 1, np.int64)
        for term, n in counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect():
            df[term] = n
        weights = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        top = counted.where(F.size("term") > 0).mapInArrow(_score(graph, weights, n_docs, max(1, length), k), "item long, doc_id long, score long")
        found = top if found is None else found.unionByName(top)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = stage.save(found, "found").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


ORACLE_OP12 = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, r, term, count(*) AS times FROM (SELECT item_id, row_number() OVER () AS r,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
a AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS length FROM t WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, a GROUP BY term, n_docs),
c AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // length))) AS part FROM p JOIN f USING (term), a),
s AS (SELECT q.r, item_id, c.r AS d, doc_id, sum(times * part)::BIGINT AS score FROM c JOIN q USING (term) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
