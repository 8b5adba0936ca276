"""Corrections of transcripts by a table of edits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed_repeats(text: Column, most: int = 3) -> Column:
    """A text one space apart in which no word comes more than ``most`` times on end."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))
    # The words are handed on as the one element of an array, so that they are taken apart once.
    return F.get(F.transform(F.array(words), lambda ws: F.array_join(F.filter(ws, lambda w, i: ~F.coalesce(
        _all([F.get(ws, i - back) == w for back in range(1, most + 1)]), F.lit(False))), " ")), 0)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def corrected(text: Column, start_at: Column, end_after: Column, remove: Column, everywhere: list[tuple[str, str]]) -> Column:
    """``text`` cut at two markers, without the fragments of ``remove``, with ``everywhere`` replaced, and repeats collapsed.

    In this order, each step on what the one before left: from the first ``start_at``
    on, up to the end of the first ``end_after``, fragments one after the other, replacements one
    after the other.  A null or absent marker cuts nothing, an empty fragment is ignored.
    """
    begin = F.position(start_at, text)
    cut = F.when(begin > 0, F.substring(text, begin, F.length(text))).otherwise(text)

    def ended(t: Column) -> Column:
        stop = F.position(end_after, t)
        return F.when(stop > 0, F.left(t, stop + F.length(end_after) - 1)).otherwise(t)

    gone = lambda t: F.aggregate(F.coalesce(remove, F.array().cast("array<string>")), t, lambda x, f: F.when(F.coalesce(f, F.lit("")) == "", x).otherwise(F.replace(x, f, F.lit(" "))))
    out = gone(ended(cut))
    for wrong, right in everywhere:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return collapsed_repeats(out)
