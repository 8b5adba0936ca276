"""Windows of tokens, call probabilities and the risk score, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the score.
MODEL_POINTS = 70.0
RULE_CAP = 35
PAIR_POINTS = 25
RULE_POINTS = {"LOW": 3, "MEDIUM": 8, "HIGH": 15}
SEVERITY_POINTS = {"LOW": 3, "MEDIUM": 8, "HIGH": 20}
SHORT_WORDS = 45
SHORT_EVIDENCE = 17
SHORT_SCORE = 59
STRONG_EVIDENCE = 30
IMPERSONATION = ["BANK_IMPERSONATION", "AUTHORITY_IMPERSONATION"]
REQUEST = ["SENSITIVE_INFORMATION", "OTP_REQUEST", "MONEY_TRANSFER", "REMOTE_ACCESS_REQUEST", "UNUSUAL_PAYMENT"]


def token_windows(tokens: Column, size: int, stride: int) -> Column:
    """Windows of at most ``size`` tokens every ``stride``; the first that reaches the end is the last; one for no tokens."""
    last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - size) / stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(tokens, k * stride + 1, size))


def call_probability(chunks: Column, how: str = "top2") -> Column:
    """Chunk probabilities as one: ``mean``, ``max`` or the mean of the two largest."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
    if how == "mean":
        return mean(chunks)
    return F.array_max(chunks) if how == "max" else mean(F.slice(F.sort_array(chunks, asc=False), 1, 2))


def _points(severities: Column, table: dict[str, int]) -> Column:
    value = lambda s: F.when(s == "HIGH", table["HIGH"]).when(s == "MEDIUM", table["MEDIUM"]).when(s == "LOW", table["LOW"]).otherwise(0)
    return F.transform(severities, value)


def risk(codes: Column, severities: Column, probability: Column, words: Column) -> Column:
    """struct(score, level, confidence, capped) of one text.

    ``confidence`` is not rounded.  A probability outside 0..1 is an error.
    """
    wrong = F.raise_error(F.lit("probability outside 0..1")).cast("double")
    p = F.when((probability < 0) | (probability > 1), wrong).otherwise(probability)
    has = lambda names: F.arrays_overlap(codes, F.array(*[F.lit(x) for x in names]))
    pattern = F.when(has(IMPERSONATION) & has(REQUEST), PAIR_POINTS).otherwise(0)
    rule = F.least(F.lit(RULE_CAP), F.aggregate(_points(severities, RULE_POINTS), F.lit(0), lambda a, x: a + x) + pattern)
    severity = F.coalesce(F.array_max(_points(severities, SEVERITY_POINTS)), F.lit(0))
    evidence = rule + severity
    full = F.bround(F.least(F.lit(100.0), p * MODEL_POINTS + evidence), 0).cast("int")
    capped = (words < SHORT_WORDS) & (full >= 60) & (evidence < SHORT_EVIDENCE)
    scam = p >= 0.5
    support = (F.when(evidence >= STRONG_EVIDENCE, F.when(scam, 1.0).otherwise(0.0)).when(evidence == 0, F.when(scam, 0.5).otherwise(1.0)).otherwise(0.75))
    confidence = 0.5 * F.abs(2 * p - 1) + 0.5 * support
    score = F.when(capped, SHORT_SCORE).otherwise(full)
    level = F.when(score >= 60, "HIGH").when(score >= 30, "MEDIUM").otherwise("LOW")
    return F.struct(score.alias("score"), level.alias("level"), F.when(capped, F.least(confidence, F.lit(0.5))).otherwise(confidence).alias("confidence"), capped.alias("capped"))


def suspicious(severities: Column) -> Column:
    """Any HIGH indicator, or two and more of which one is above LOW."""
    return F.array_contains(severities, "HIGH") | ((F.size(severities) >= 2) & F.exists(severities, lambda s: s != "LOW"))
