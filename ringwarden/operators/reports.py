"""Reports of phone numbers: which are taken, and what reviews make of them and of the blacklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwarden.functions.scalar import canonical_phone


def stripped(name: str) -> Column:
    """A free text without blanks and control characters around it; null if nothing is left."""
    text = F.regexp_replace(name, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.when(text.rlike(r"(?U)\S"), text)


def decided(submitted: DataFrame, calls: DataFrame, listed: DataFrame, most_pending: int = 20, most_signs: int = 1000) -> DataFrame:
    """Each of ``submitted`` (id, reporter_id, call_id, raw_number, reason, created_at) with phone_number, its reason
    trimmed (null if blank) and ``outcome``: ACCEPTED or the first rule that refuses it.

    ``calls`` holds (id, user_id, caller_number), ``listed`` the active (phone_number), once each.  Reports arrive by
    (created_at, id), ids are unique, a null time comes first.  Nothing is reviewed meanwhile, so what a reporter has
    waiting only grows: of the numbers in the order of their first valid report the first ``most_pending`` are taken,
    once each, and all others are refused whenever they come.  That needs a minimum a (reporter, number) and the first
    few of each reporter, both summed before the exchange, and no run over a reporter's reports.
    """
    owned = calls.select(F.col("id").alias("call_id"), F.col("user_id").alias("reporter_id"), "caller_number", F.lit(True).alias("_owned"))
    typed, text = canonical_phone(F.col("raw_number")), stripped("reason")
    given = F.col("raw_number").rlike(r"(?U)\S")
    s = submitted.join(owned, ["call_id", "reporter_id"], "left").withColumns({"_typed": typed, "phone_number": F.coalesce(typed, "caller_number")})
    refusal = (F.when(given & F.col("_typed").isNull(), "INVALID_PHONE_NUMBER").when(F.col("call_id").isNotNull() & F.col("_owned").isNull(), "CALL_NOT_FOUND")
               .when(F.col("_typed") != F.col("caller_number"), "PHONE_NUMBER_MISMATCH").when(F.col("phone_number").isNull(), "INVALID_PHONE_NUMBER")
               .when(text.isNotNull() & (F.length("reason") > most_signs), "VALIDATION_FAILED").when(F.col("_listed"), "PHONE_NUMBER_ALREADY_BLACKLISTED"))
    s = s.join(listed.select("phone_number", F.lit(True).alias("_listed")), "phone_number", "left").withColumn("_refusal", refusal)
    s = s.select("id", "reporter_id", "call_id", "phone_number", text.alias("reason"), "created_at", F.struct("created_at", "id").alias("_at"), "_refusal")
    first = s.where("_refusal is null").groupBy("reporter_id", "phone_number").agg(F.min("_at").alias("_first"))
    taken = first.withColumn("_place", F.row_number().over(Window.partitionBy("reporter_id").orderBy("_first"))).where(F.col("_place") <= most_pending)
    out = s.join(taken, ["reporter_id", "phone_number"], "left")
    outcome = (F.when(F.col("_refusal").isNotNull(), F.col("_refusal")).when(F.col("_first").isNull(), "TOO_MANY_PENDING_REPORTS")
               .when(F.col("_at") == F.col("_first"), "ACCEPTED").otherwise("NUMBER_ALREADY_REPORTED"))
    return out.select("id", "reporter_id", "call_id", "phone_number", "reason", "created_at", outcome.alias("outcome"))


def _turning_points(reports: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each decision with its report's number and whether it is the report's first, and the approval that counts by number."""
    at = F.struct("at", "decision_id")
    first = decisions.groupBy("report_id").agg(F.min(at).alias("_first"))
    number = reports.select(F.col("id").alias("report_id"), "phone_number", F.col("reason").alias("_reported"))
    each = (decisions.join(first, "report_id").join(number, "report_id")
            .withColumns({"_at": at, "_leads": at == F.col("_first")}))
    approved = (each.where("_leads and verdict = 'APPROVE'").groupBy("phone_number")
                .agg(F.min(F.struct("_at", stripped("reason").alias("reason"), "_reported")).alias("_win")))
    return each, approved


def reviewed(reports: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``decisions`` (decision_id, report_id, verdict APPROVE or REJECT, reason, at) make of pending ``reports``.

    Returns the reports with ``status``; (decision_id, result), where a decision on a report that is settled already is
    REPORT_ALREADY_REVIEWED and one on an unknown report BLACKLIST_REPORT_NOT_FOUND; and the approved numbers with
    (reason, reported): the reviewer's reason and that of the report.  Decisions come by (at, decision_id), which is
    unique.  Only a report's first decision can count.  A number is approved by the earliest approval that is the first
    decision of its report; it settles all its reports but those rejected before.
    """
    each, approved = _turning_points(reports, decisions)
    rejected = each.where("_leads and verdict = 'REJECT'").select(F.col("report_id").alias("id"), F.col("_at").alias("_rejected"))
    won = approved.select("phone_number", F.col("_win._at").alias("_won"))
    before = lambda a: a.isNotNull() & (F.col("_won").isNull() | (a < F.col("_won")))
    status = F.when(before(F.col("_rejected")), "REJECTED").when(F.col("_won").isNotNull(), "APPROVED").otherwise("PENDING")
    states = reports.join(rejected, "id", "left").join(won, "phone_number", "left").withColumn("status", status).select(*reports.columns, "status")
    counts = F.col("_leads") & F.when(F.col("verdict") == "REJECT", before(F.col("_at"))).otherwise(F.col("_at") == F.col("_won"))
    done = F.when(F.col("verdict") == "REJECT", "REJECTED").otherwise("APPROVED")
    results = each.join(won, "phone_number", "left").select("decision_id", F.when(counts, done).otherwise("REPORT_ALREADY_REVIEWED").alias("result"))
    lost = decisions.select("decision_id", "report_id").join(reports.select(F.col("id").alias("report_id")), "report_id", "left_anti")
    results = results.unionByName(lost.select("decision_id", F.lit("BLACKLIST_REPORT_NOT_FOUND").alias("result")))
    return states, results, approved.select("phone_number", F.col("_win.reason").alias("reason"), F.col("_win._reported").alias("reported"))


def blacklist_after(numbers: DataFrame, approved: DataFrame) -> DataFrame:
    """``numbers`` (phone_number, active, reason) after the approvals: a known number is active again and takes the
    reviewer's reason if there is one, a new one takes that or else the report's."""
    a = approved.select("phone_number", F.col("reason").alias("_new"), "reported", F.lit(True).alias("_approved"))
    known = F.col("active").isNotNull()
    return numbers.join(a, "phone_number", "full").select(
        "phone_number", F.coalesce("_approved", "active").alias("active"), F.when(known, F.coalesce("_new", "reason")).otherwise(F.coalesce("_new", "reported")).alias("reason"))
