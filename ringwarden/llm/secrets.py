"""Secrets in texts: fixed patterns, and values in a credential's place that are dear to guess.

A value behind a label such as ``passphrase is`` is cut into words, dates, repeats,
keyboard walks and brute-force spans, so that the guesses the whole needs are the
fewest; dynamic programming over the value's positions finds that cut.  A value
that needs many guesses is a secret whatever signs it holds; one that is made of
frequent words is not.

A word costs as many guesses as there are more frequent words in all documents.
Only the words that stand in values are looked up, by a join; no word list is sent
to the tasks and none is cut off.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import comb, log10

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringwarden.llm.ranked_search import terms_of
from ringwarden.llm.text import documents
from ringwarden.staging import Staging

#: The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "guess"]
BASE = ["base_start", "base_kind", "base_end"]
STEMS = ("passw", "secret", "token", "api")

#: Places of a credential: a label, a sign or word of assignment, and a value, in quotes or up to a blank.
PLACE = re.compile(r"""\b(?:[A-Za-z0-9]+[_-])?(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|client)[_ -]?key)["']?"""
                   r"""[\x20\t]{0,8}(?::=|=>|->|[:=]|\bis\b)[\x20\t]{0,8}(?:"([^"\r\n]{4,})"|'([^'\r\n]{4,})'|`([^`\r\n]{4,})`|([^\s"'`<>,;]{4,}))""", re.I | re.A)
PLACE_STEMS = ("pass", "pwd", "secret", "token", "credential", "key")
#: A bare value does not take the signs that end a sentence.
SENTENCE_END = ".!?)]}:"

#: log10 of the guesses from which on a value is a secret.
DEAR = 8.0
#: A word has so many letters.
SHORTEST, LONGEST = 3, 24
#: A block of a repeat has so many signs at most; a repeat or walk so many at least.
BLOCK, STRETCH = 16, 3
#: Each span after the first may be of any of five kinds.
ANOTHER = log10(5)
YEARS, THIS_YEAR = 20, 2024
LOOKS_LIKE = str.maketrans("@4310$57!", "aaeiosstl")
DATE = re.compile(r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|(?:19|20)\d{6}|\d{4}(?:19|20)\d{2}|(?:19|20)\d{2})")
LETTERS = re.compile(r"[a-z\u0080-\U0010ffff]{%d,}" % SHORTEST)
ROWS = ["`1234567890-=", "\tqwertyuiop[]\\", "\tasdfghjkl;'", "\tzxcvbnm,./"]
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")


def _neighbours() -> dict[str, str]:
    at = {(r, c): key for r, row in enumerate(ROWS) for c, key in enumerate(row) if key != "\t"}
    near = ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, 0), (1, -1))
    return {key: "".join(at.get((r + y, c + x), "") for y, x in near) for (r, c), key in at.items()}


NEIGHBOURS = _neighbours()
DIRECTIONS = sum(map(len, NEIGHBOURS.values())) / len(NEIGHBOURS)
#: Signs of a class: small and capital letters, digits, other ASCII, all else.
CLASS_SIZE = [26, 26, 10, 33, 100]


def _class(c: str) -> int:
    return 4 if c > "\x7f" else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def forms(value: str) -> list[str]:
    """A value in small letters, and with signs read as the letters they look like, place by place."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    read = low.translate(LOOKS_LIKE)
    return [low] if read == low else [low, read]


def word_places(value: str) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, word, form) of all letter sequences that could be words."""
    read = forms(value)
    for form, text in enumerate(read):
        for run in LETTERS.finditer(text):
            for i in range(run.start(), run.end() - SHORTEST + 1):
                for j in range(i + SHORTEST, min(run.end(), i + LONGEST) + 1):
                    if not form or text[i:j] != read[0][i:j]:
                        yield i, j, text[i:j], form


def _capitals(word: str) -> float:
    """log10 of the ways in which letters could be capitals, the usual ones first."""
    upper, n = sum(c.isupper() for c in word), sum(c.isalpha() for c in word)
    if not upper:
        return 0.0
    if upper == n or (upper == 1 and word[0].isupper()):
        return log10(2)
    return log10(sum(comb(n, i) for i in range(min(upper, n - upper) + 1)))


def stretches(value: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the longest stretches that repeat a block of at most BLOCK signs."""
    for p in range(1, min(BLOCK, len(value) // 2) + 1):
        start = 0
        for i in range(p, len(value) + 1):
            if i == len(value) or value[i] != value[i - p]:
                if i - start >= max(2 * p, STRETCH):
                    yield start, i, p
                start = i - p + 1


def walks(value: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, turns) of the longest walks from key to neighbouring key; standing still ends a walk."""
    keys = value.translate(SHIFTED).lower()
    start, turns, last = 0, 0, None
    for i in range(1, len(keys) + 1):
        side = NEIGHBOURS.get(keys[i - 1], "").find(keys[i]) if i < len(keys) else -1
        if side < 0:
            if i - start >= STRETCH:
                yield start, i, turns
            start, turns, last = i, 0, None
        elif side != last:
            turns, last = turns + 1, side


def spans(value: str, ranks: dict[str, int], nested: bool = False) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, log10 guesses) of every word, date, repeat and walk in a value."""
    out = [(i, j, "word", log10(ranks[w]) + _capitals(value[i:j]) + (log10(2) if form else 0)) for i, j, w, form in word_places(value) if w in ranks]
    for at in range(len(value)):
        if m := DATE.match(value, at):
            digits = re.findall(r"(?:19|20)\d{2}", m[0])
            gap = max(YEARS, abs(int(digits[0]) - THIS_YEAR)) if digits else YEARS
            out.append((at, m.end(), "date", log10(gap * (1 if m.end() - at == 4 else 366)) + (0 if m[0].isdigit() else log10(4))))
    if not nested:
        out += [(i, j, "repeat", guesses(value[i:i + p], ranks, True)[0] + log10(-(-(j - i) // p))) for i, j, p in stretches(value)]
    out += [(i, j, "walk", log10(len(NEIGHBOURS)) + turns * log10(DIRECTIONS) + log10(j - i)) for i, j, turns in walks(value)]
    return out


def guesses(value: str, ranks: dict[str, int], nested: bool = False) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses for a value and the spans of the cut that needs the fewest.

    ``best`` holds the cost up to each place; an open brute-force span is kept for every
    set of sign classes that the value has, so its cost grows sign by sign.
    """
    known = {}
    for i, j, kind, cost in spans(value, ranks, nested):
        known.setdefault(j, []).append((i, kind, cost))
    have = sorted({_class(c) for c in value})
    sets = [[c for b, c in enumerate(have) if m >> b & 1] for m in range(1, 1 << len(have))]
    price = [(set(s), log10(sum(CLASS_SIZE[c] for c in s))) for s in sets]
    best, came = [0.0], [None]
    open_ = [(float("inf"), 0)] * len(price)  # cost and start of the span that is open
    for j, sign in enumerate(value, 1):
        fresh = best[j - 1] + (ANOTHER if j > 1 else 0)
        kind = _class(sign)
        open_ = [(min(o, (fresh, j - 1))[0] + each, min(o, (fresh, j - 1))[1]) if kind in s else (float("inf"), 0) for o, (s, each) in zip(open_, price)]
        cost, start = min(open_)
        choice = (cost, start, "brute")
        for i, name, c in known.get(j, ()):
            total = best[i] + (ANOTHER if i else 0) + c
            if total < choice[0]:
                choice = (total, i, name)
        best.append(choice[0])
        came.append((choice[1], choice[2]))
    cut, j = [], len(value)
    while j:
        i, kind = came[j]
        cut.append((i, j, kind))
        j = i
    return best[-1], cut[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    low = text.lower()
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(s in low for s in STEMS) else []
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def places(text: str) -> list[tuple[int, int]]:
    """Where the values in a credential's place stand."""
    if not any(s in text.lower() for s in PLACE_STEMS):
        return []
    out = []
    for m in PLACE.finditer(text):
        group = m.lastindex
        start, end = m.span(group)
        if group == 4:
            end = start + len(text[start:end].rstrip(SENTENCE_END))
        if end - start >= 4:
            out.append((start, end))
    return out


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for doc, text in zip(frame["doc"], frame["text"]):
            text = text if isinstance(text, str) else ""
            found = base_spans(text)
            inside = lambda a, b: any(x <= a and b <= y for x, _, y in found)
            values = [(a, b, text[a:b]) for a, b in places(text) if not inside(a, b)]
            n = Counter(k for _, k, _ in found)
            out.append((doc, n[0], n[1], n[2], hashlib.sha256(written(found).encode()).hexdigest(), *([s[i] for s in found] for i in range(3)),
                        [a for a, _, _ in values], [b for _, b, _ in values], [v for _, _, v in values]))
        yield pd.DataFrame(out, columns=["doc", "n_assign", "n_access", "n_hex", "base_sha256", *BASE, "start", "end", "value"])


def _words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, n): words of a task, handed on whenever the table of counts is large."""
    digit = re.compile(rb"[0-9]")
    seen = Counter()
    give = lambda: pd.DataFrame([(w, n) for k, n in seen.items() if not digit.search(k) and SHORTEST <= len(w := k.decode()) <= LONGEST], columns=["word", "n"])
    for frame in frames:
        for text in frame["text"]:
            seen.update(terms_of(text))
        if len(seen) > 500_000:
            yield give()
            seen.clear()
    yield give()


def _candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(key, w) for key, value in zip(frame["key"], frame["value"]) for w in {w for _, _, w, _ in word_places(value)}]
        yield pd.DataFrame(rows, columns=["key", "word"])


def _cost(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    @lru_cache(4096)
    def cost(value: str, known: tuple[tuple[str, int], ...]) -> float:
        return guesses(value, dict(known))[0]

    for frame in frames:
        yield pd.DataFrame({"key": frame["key"], "cost": [cost(v, tuple((r["word"], r["rank"]) for r in k)) for v, k in zip(frame["value"], frame["known"])]})


def word_ranks(docs: DataFrame, stage: Staging) -> DataFrame:
    """(word, rank) of all words of the texts: one more than the number of words that are more frequent."""
    counted = stage.save(docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(_words, "word string, n long")
                         .groupBy("word").agg(F.sum("n").alias("n")), "words")
    sizes = counted.groupBy("n").agg(F.count(F.lit(1)).alias("words"))  # as many rows as there are different counts
    before = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = stage.save(sizes.select("n", (F.coalesce(F.sum("words").over(before), F.lit(0)) + 1).alias("rank")), "ranks")
    return counted.join(ranks, "n").select("word", "rank")


def value_costs(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """(key, cost): log10 of the guesses for each of the different values (key, value)."""
    known = (values.mapInPandas(_candidates, "key string, word string").join(ranks, "word").groupBy("key")
             .agg(F.collect_list(F.struct("word", "rank")).alias("known")))
    none = F.array().cast("array<struct<word:string,rank:bigint>>")
    ready = values.join(known, "key", "left").select("key", "value", F.coalesce(F.array_sort("known"), none).alias("known"))
    return ready.mapInPandas(_cost, "key string, cost double")


def find_secrets(docs: DataFrame, dear: float = DEAR) -> DataFrame:
    """Spans of secrets in every text of (doc_id, text), one row a row.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the spans of the fixed
    patterns), spans (those and the added ones, ``kind:start:end`` in code points, end
    exclusive), n_guess and most_guesses (log10 of the guesses for the dearest value in
    a credential's place outside the fixed patterns' spans; null if it has none).  A value from 10 ** ``dear``
    guesses on is added as kind ``guess``; spans of equal start go by kind.  Null and
    empty texts have no spans; texts of any length are read whole; rows with null or
    repeated doc_ids and repeated rows are rows of their own.  An empty table gives an
    empty result; other columns are not read.
    """
    stage = Staging(docs.sparkSession)
    ids = docs.schema["doc_id"].dataType.simpleString()
    scanned = docs.select(F.col("doc_id").cast("string").alias("doc"), "text").mapInPandas(
        _scan, f"doc string, n_assign long, n_access long, n_hex long, base_sha256 string, {', '.join(f'{c} array<int>' for c in [*BASE, 'start', 'end'])}, value array<string>")
    rows = stage.save(scanned.withColumn("row", F.monotonically_increasing_id()), "rows")
    place = F.explode(F.arrays_zip("start", "end", "value"))
    spots = rows.where(F.size("value") > 0).select("row", place.alias("v")).select("row", "v.start", "v.end", "v.value").withColumn("key", F.sha2("value", 256))
    values = stage.save(spots.groupBy("key").agg(F.first("value").alias("value")), "values")
    costs = stage.save(value_costs(values, word_ranks(docs, stage)), "costs")
    added = (spots.drop("value").join(costs, "key").groupBy("row").agg(
        F.collect_list(F.when(F.col("cost") >= dear, F.struct("start", F.lit(3).alias("kind"), "end"))).alias("more"), F.max("cost").alias("most_guesses")))
    base = F.transform(F.arrays_zip(*BASE), lambda s: F.struct(*[s[c].alias(c[5:]) for c in BASE]))
    all_ = F.array_sort(F.concat(base, F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    kind = F.array(*[F.lit(k) for k in KINDS])
    return rows.join(added, "row", "left").select(
        F.col("doc").cast(ids).alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(F.transform(all_, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"], s["end"])), ",").alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_guess"), "most_guesses")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return find_secrets(documents(spark, sf_dir))
