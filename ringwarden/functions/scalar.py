"""Scalar functions as column expressions."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_phone(raw: Column, strict: bool = False) -> Column:
    """The international form of a phone number.

    White space, dots, brackets and hyphens go; what is left must be 6 to 15 digits
    with an optional plus.  0... of ten digits or more and 84... of eleven or more
    get +84.  Blank is null; anything else is null too, or an error if ``strict``.
    """
    s = F.regexp_replace(raw, r"[\s.()-]", "")
    bad = F.raise_error(F.lit("not a phone number")) if strict else F.lit(None)
    return (F.when(s.isNull() | (s == ""), F.lit(None)).when(~s.rlike(r"^\+?[0-9]{6,15}$"), bad.cast("string"))
            .when(s.startswith("0") & (F.length(s) >= 10), F.concat(F.lit("+84"), F.substring(s, 2, 20)))
            .when(s.startswith("84") & (F.length(s) >= 11), F.concat(F.lit("+"), s)).otherwise(s))


def search_digits(text: Column) -> Column:
    """The digits of a text without one leading zero."""
    return F.regexp_replace(F.regexp_replace(text, "[^0-9]", ""), "^0", "")


def email_key(email: Column) -> Column:
    """An email address trimmed, in lower case."""
    return F.lower(F.trim(email))


def file_name(path: Column, most: int = 255) -> Column:
    """The last part of a path without control characters, at most ``most`` last characters; empty is null."""
    base = F.trim(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"[\x00-\x1F\x7F]", ""))
    return F.when(base != "", F.right(base, F.lit(most)))


def clean_reason(text: Column, most: int = 1000) -> Column:
    """A free text trimmed; blank is null, longer than ``most`` an error."""
    t = F.trim(text)
    return F.when(F.length(t) > most, F.raise_error(F.lit("reason too long")).cast("string")).when(t != "", t)


def risk_level(score: Column) -> Column:
    """HIGH from 60, MEDIUM from 30, else LOW."""
    return F.when(score >= 60, "HIGH").when(score >= 30, "MEDIUM").when(score.isNotNull(), "LOW")


#: Runs of anything but letters, marks, digits and underscore, in any script.
NOT_WORD = r"[^\p{L}\p{M}\p{N}_]+"


@lru_cache(maxsize=1)
def _compositions() -> str:
    """JSON of every letter written with its marks apart, in each order of the marks, and the letter; Hangul is left out."""
    pairs: dict[str, str] = {}
    for letter in map(chr, range(0xC0, sys.maxunicode + 1)):
        if unicodedata.decomposition(letter)[:1] in ("", "<") or "\uac00" <= letter <= "\ud7a3":
            continue
        apart = unicodedata.normalize("NFD", letter)
        if unicodedata.normalize("NFC", apart) != letter or not 2 <= len(apart) <= 3:
            continue
        pairs[apart] = letter
        pairs[apart[0] + apart[:0:-1]] = unicodedata.normalize("NFC", apart[0] + apart[:0:-1])
        if len(apart) == 3:
            for k in (1, 2):  # one mark already joined
                pairs[unicodedata.normalize("NFC", apart[0] + apart[k]) + apart[3 - k]] = letter
    return json.dumps(pairs)


def composed(text: Column) -> Column:
    """The text with letters and the marks after them as one letter each (NFC, but for Hangul); texts without marks are not touched."""
    table = F.from_json(F.lit(_compositions()), "map<string,string>")
    groups = F.regexp_extract_all(text, F.lit(r"(?s)\P{M}\p{M}*|\p{M}+"), F.lit(0))
    joined = F.array_join(F.transform(groups, lambda g: F.when(F.length(g) > 1, F.coalesce(F.element_at(table, g), g)).otherwise(g)), "")
    return F.when(text.rlike(r"\p{M}"), joined).otherwise(text)


def duplicate_key(text: Column) -> Column:
    """The words of a text, composed and in lower case, one space apart."""
    return F.trim(F.regexp_replace(F.lower(composed(text)), NOT_WORD, " "))


def clean_text(text: Column) -> Column:
    """Composed, byte order marks dropped, white space of any kind collapsed, content kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(composed(text), "\ufeff", ""), r"(?U)\s+", " "))


def transcript_style(text: Column) -> Column:
    """As a speech recogniser writes: no punctuation, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, "[.,!?;:…]", "")), r"\s+", " "))


def tidy_dots(text: Column) -> Column:
    """Runs of three dots or more as one; a text of nothing but dots is empty."""
    t = F.trim(F.regexp_replace(text, r"(\s*\.){3,}", "."))
    return F.when(t.rlike(r"^[.\s]*$"), "").otherwise(t)


#: What counts as personal data, by kind.
PERSONAL_DATA = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "url": r"(?i)(https?://|www\.)[^\s]+",
    "long_number": r"[0-9]{9,}",
    "phone": r"(^|[^0-9])(\+?84|0)[0-9]{9}($|[^0-9])",
}


def personal_data(text: Column) -> list[Column]:
    """A flag for each kind of personal data in a text."""
    return [F.coalesce(text.rlike(rx), F.lit(False)).alias(f"has_{name}") for name, rx in PERSONAL_DATA.items()]


def template(pattern: str, values: dict[str, Column]) -> Column:
    """A text with {key} replaced by values and {Key} by values with a first capital."""
    out = F.lit(pattern)
    for key, value in values.items():
        capital = F.concat(F.upper(F.left(value, F.lit(1))), F.substring(value, 2, 1 << 30))
        out = F.replace(F.replace(out, F.lit("{" + key + "}"), value), F.lit("{" + key.capitalize() + "}"), capital)
    return out
