"""Copies of texts with small changes, as column expressions on arrays of words.

Words are a stored column where a function reads them more than once: a lambda computes
an expression again at every place.  Chance is a hash of a row's key, a purpose and a place, so a copy is the same in every
run, on every executor and in SQL.  Texts are never changed in their first row.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What speakers put between words and before sentences.
INTERJECTIONS = ["dạ", "ạ", "ờ", "à", "ừ", "ừm", "ờm", "thì", "là", "vâng", "ấy", "kiểu"]
FILLERS = ["nói chung là", "kiểu như", "thật ra", "ấy mà", "nói thật", "đúng không", "thế này nhé"]
#: Least and added share of words that are changed.
RATES = {"interject": (0.06, 0.10), "drop": (0.04, 0.06), "repeat": (0.03, 0.05)}
#: Shares of bare words, of swapped pairs and of sentences with a filler; words a sentence is taken to have.
BARE, SWAPPED, FILLED, SENTENCE = 0.08, 0.05, 0.45, 10
_STEPS = 1 << 28


def chance(*parts: Column) -> Column:
    """A number from 0 to below 1 that the parts, joined by colons, decide."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 7), 16, 10).cast("double") / _STEPS


def split_words(text: Column) -> Column:
    """The pieces of a text between white space; [] for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), F.array().cast("array<string>"))


def pick(options: list[str], *parts: Column) -> Column:
    """One of the options, by chance."""
    return F.get(F.array(*[F.lit(x) for x in options]), F.floor(chance(*parts) * len(options)).cast("int"))


def _rate(key: Column, name: str) -> Column:
    low, more = RATES[name]
    return F.lit(low) + F.lit(more) * chance(key, F.lit(name))


def interjected(words: Column, key: Column) -> Column:
    """An interjection before 6 to 16 % of the words."""
    says = lambda i: chance(key, F.lit("interject"), i) < _rate(key, "interject")
    return F.flatten(F.transform(words, lambda w, i: F.when(says(i), F.array(pick(INTERJECTIONS, key, F.lit("which"), i), w)).otherwise(F.array(w))))


def dropped(words: Column, key: Column) -> Column:
    """Without 4 to 10 % of the words; unchanged if fewer than three would be left."""
    kept = F.filter(words, lambda w, i: chance(key, F.lit("drop"), i) >= _rate(key, "drop"))
    return F.when(F.size(kept) >= 3, kept).otherwise(words)


def repeated(words: Column, key: Column) -> Column:
    """3 to 8 % of the words twice."""
    twice = lambda i: chance(key, F.lit("repeat"), i) < _rate(key, "repeat")
    return F.flatten(F.transform(words, lambda w, i: F.when(twice(i), F.array(w, w)).otherwise(F.array(w))))


def swapped(words: Column, key: Column) -> Column:
    """About 5 % of the neighbours change places; a word moves once at most."""
    mark = lambda i: (i >= 0) & (i < F.size(words) - 1) & (chance(key, F.lit("swap"), i) < SWAPPED)
    starts = lambda i: mark(i) & ~mark(i - 1)
    return F.transform(words, lambda w, i: F.when(starts(i), F.get(words, i + 1)).when(starts(i - 1), F.get(words, i - 1)).otherwise(w))


@lru_cache(maxsize=1)
def _marked() -> tuple[str, str]:
    """Every letter that is written with marks on one letter of the basic planes, and that letter; the crossed d as well."""
    pairs = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, min(0x10000, sys.maxunicode)))
             if not "가" <= c <= "힣" and unicodedata.category(c)[0] == "L" and len(unicodedata.normalize("NFD", c)) > 1}
    pairs |= {"đ": "d", "Đ": "D"}
    return "".join(pairs), "".join(pairs.values())


def bare(text: Column) -> Column:
    """A text without the marks on its letters."""
    letters, plain = _marked()
    return F.regexp_replace(F.translate(text, letters, plain), r"\p{Mn}", "")


def toneless(words: Column, key: Column) -> Column:
    """About 8 % of the words without their marks, as if the tone was not heard."""
    return F.transform(words, lambda w, i: F.when(chance(key, F.lit("tone"), i) < BARE, bare(w)).otherwise(w))


def with_fillers(text: Column, words: Column, key: Column) -> Column:
    """A text (and its words) with a filler before about 45 % of the sentences; a text of one sentence counts every ten words as one."""
    sentences = F.split(F.trim(text), r"(?<=[.!?])\s+")
    tens = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(words) - 1) / SENTENCE), F.lit(0)).cast("int")), lambda k: F.array_join(F.slice(words, k * SENTENCE + 1, SENTENCE), " "))
    parts = F.when(F.size(sentences) < 2, tens).otherwise(sentences)
    said = F.transform(parts, lambda s, i: F.when(chance(key, F.lit("filler"), i) < FILLED, F.concat_ws(" ", pick(FILLERS, key, F.lit("phrase"), i), s)).otherwise(s))
    return F.when(F.size(words) > 0, F.array_join(said, " ")).otherwise("")


def without_labels(text: Column, labels: list[str]) -> Column:
    """A text without the speakers' labels ``name:`` at its start or after white space, any case; white space is collapsed."""
    names = "|".join(sorted((f"\\Q{x}\\E" for x in labels), key=len, reverse=True))
    return F.array_join(split_words(F.regexp_replace(text, rf"(?iu)(?:^|(?<=\s))(?:{names})\s*:", " ")), " ")
