"""Queries on reports of phone numbers: submission, the reviewers' list, reviews and the blacklist after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwarden.functions.scalar import search_digits
from ringwarden.operators.latest import optional
from ringwarden.operators.reports import blacklist_after, decided, reviewed
from ringwarden.sources.domain import PRELUDE, blacklist_numbers, call_records, phone

QUERIES, ORACLES = {}, {}

#: Every call is reported once: by its owner or by another user, with its number written in another way, a wrong one,
#: none or nonsense, or by one of five busy users without naming the call.
SUBMITTED = """, submitted AS (SELECT id, CASE WHEN id % 4 = 3 THEN 1 + id % 5 WHEN id % 13 = 0 THEN user_id + 1 ELSE user_id END AS reporter_id, CASE WHEN id % 4 <> 3 THEN id END AS call_id,
  CASE WHEN id % 17 = 0 THEN 'call me' WHEN id % 4 = 0 THEN '  ' WHEN id % 4 = 1 THEN '0' || caller_number[4:] WHEN id % 4 = 2 THEN '+849' || lpad(CAST(id % 97 AS VARCHAR), 8, '0')
    ELSE '84 (9) ' || lpad(CAST(id % 97 AS VARCHAR), 8, '0') END AS raw_number,
  CASE WHEN id % 97 = 0 THEN repeat('x', 1001) WHEN id % 5 = 0 THEN '   ' ELSE ' report ' || id END AS reason, created_at FROM call_records),
"""

REPORTS = PRELUDE + SUBMITTED + r"""typed AS (SELECT *, regexp_replace(raw_number, '[\s.()-]', '', 'g') AS s FROM submitted),
canonical AS (SELECT *, CASE WHEN NOT regexp_full_match(s, '\+?[0-9]{6,15}') THEN NULL WHEN s LIKE '0%' AND len(s) >= 10 THEN '+84' || s[2:] WHEN s LIKE '84%' AND len(s) >= 11 THEN '+' || s ELSE s END AS number FROM typed),
found AS (SELECT t.*, c.id AS known, c.caller_number FROM canonical t LEFT JOIN call_records c ON c.id = t.call_id AND c.user_id = t.reporter_id),
checked AS (SELECT id, reporter_id, call_id, coalesce(number, caller_number) AS phone_number, nullif(trim(reason), '') AS reason, created_at,
  CASE WHEN s <> '' AND number IS NULL THEN 'INVALID_PHONE_NUMBER' WHEN call_id IS NOT NULL AND known IS NULL THEN 'CALL_NOT_FOUND' WHEN number <> caller_number THEN 'PHONE_NUMBER_MISMATCH'
    WHEN coalesce(number, caller_number) IS NULL THEN 'INVALID_PHONE_NUMBER' WHEN len(reason) > 1000 THEN 'VALIDATION_FAILED'
    WHEN coalesce(number, caller_number) IN (SELECT b.phone_number FROM blacklist_numbers b WHERE b.active) THEN 'PHONE_NUMBER_ALREADY_BLACKLISTED' END AS refusal FROM found),
nth AS (SELECT *, row_number() OVER (PARTITION BY reporter_id, phone_number ORDER BY created_at, id) AS nth FROM checked WHERE refusal IS NULL),
places AS (SELECT *, count(*) FILTER (WHERE nth = 1) OVER (PARTITION BY reporter_id ORDER BY created_at, id) AS place FROM nth),
numbered AS (SELECT *, min(place) OVER (PARTITION BY reporter_id, phone_number) AS number_place FROM places),
outcomes AS (SELECT id, reporter_id, call_id, phone_number, reason, created_at, CASE WHEN number_place > 20 THEN 'TOO_MANY_PENDING_REPORTS' WHEN nth = 1 THEN 'ACCEPTED' ELSE 'NUMBER_ALREADY_REPORTED' END AS outcome FROM numbered
  UNION ALL SELECT id, reporter_id, call_id, phone_number, reason, created_at, refusal FROM checked WHERE refusal IS NOT NULL),
reports AS (SELECT id, reporter_id, call_id, phone_number, reason, created_at FROM outcomes WHERE outcome = 'ACCEPTED'),
decisions AS (SELECT 2 * id AS decision_id, id AS report_id, CASE WHEN id % 57 = 0 THEN 'APPROVE' ELSE 'REJECT' END AS verdict, CASE WHEN id % 2 = 0 THEN 'seen ' || id END AS reason, id * 7919 % 10007 AS moment FROM outcomes WHERE id % 3 < 2
  UNION ALL SELECT 2 * id + 1, id, 'APPROVE', NULL, id * 104729 % 10007 FROM outcomes WHERE id % 133 = 0),
each AS (SELECT d.*, r.phone_number, r.reason AS reported, row_number() OVER (PARTITION BY report_id ORDER BY moment, decision_id) AS nth FROM decisions d JOIN reports r ON r.id = d.report_id),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phone_number ORDER BY moment, decision_id) AS k FROM each WHERE nth = 1 AND verdict = 'APPROVE') WHERE k = 1),
states AS (SELECT r.*, CASE WHEN e.verdict = 'REJECT' AND (w.moment IS NULL OR (e.moment, e.decision_id) < (w.moment, w.decision_id)) THEN 'REJECTED' WHEN w.moment IS NOT NULL THEN 'APPROVED' ELSE 'PENDING' END AS status
  FROM reports r LEFT JOIN each e ON e.report_id = r.id AND e.nth = 1 LEFT JOIN won w ON w.phone_number = r.phone_number)
"""


def query(sql: str):
    """Register a query under its function's name, with the SQL of the same rows."""
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = REPORTS + sql
        return f

    return add


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All submitted reports with their outcome."""
    calls, i = call_records(spark, sf_dir), F.col("id")
    typed = (F.when(i % 17 == 0, "call me").when(i % 4 == 0, "  ").when(i % 4 == 1, F.concat(F.lit("0"), F.substring("caller_number", 4, 20))).when(i % 4 == 2, phone(i))
             .otherwise(F.concat(F.lit("84 (9) "), F.substring(phone(i), 5, 8))))
    reason = F.when(i % 97 == 0, "x" * 1001).when(i % 5 == 0, "   ").otherwise(F.concat(F.lit(" report "), i.cast("string")))
    sent = calls.select("id", F.when(i % 4 == 3, 1 + i % 5).when(i % 13 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("reporter_id"), F.when(i % 4 != 3, i).alias("call_id"),
                        typed.alias("raw_number"), reason.alias("reason"), "created_at")
    return decided(sent, calls, blacklist_numbers(spark, sf_dir).where("active"))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, reporter_id, call_id, phone_number, reason, created_at) of the reports that were taken."""
    return outcomes(spark, sf_dir).where("outcome = 'ACCEPTED'").drop("outcome")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of reviewers by the ids of calls, some on reports that were never taken, some twice on one report."""
    i = F.col("id")
    one = F.when(i % 3 < 2, F.struct((2 * i).alias("decision_id"), i.alias("report_id"), F.when(i % 57 == 0, "APPROVE").otherwise("REJECT").alias("verdict"),
                                     F.when(i % 2 == 0, F.concat(F.lit("seen "), i.cast("string"))).alias("reason"), (i * 7919 % 10007).alias("at")))
    two = F.when(i % 133 == 0, F.struct((2 * i + 1).alias("decision_id"), i.alias("report_id"), F.lit("APPROVE").alias("verdict"), F.lit(None).cast("string").alias("reason"), (i * 104729 % 10007).alias("at")))
    return call_records(spark, sf_dir).select(F.inline(F.array_compact(F.array(one, two))))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(phone_number, active, reason): the blacklist before the reviews."""
    return blacklist_numbers(spark, sf_dir).withColumn("reason", F.concat(F.lit("listed "), "phone_number"))


@query("SELECT id, reporter_id, phone_number, reason, outcome FROM outcomes")
def validate_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every submitted report with its number and outcome."""
    return outcomes(spark, sf_dir).select("id", "reporter_id", "phone_number", "reason", "outcome")


@query("SELECT phone_number, count(*) AS pending, count(DISTINCT reporter_id) AS reporters, max(created_at) AS last_report FROM reports GROUP BY 1")
def report_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted reports by number."""
    return (accepted(spark, sf_dir).groupBy("phone_number")
            .agg(F.count(F.lit(1)).alias("pending"), F.countDistinct("reporter_id").alias("reporters"), F.max("created_at").alias("last_report")))


@query("SELECT id, phone_number, status FROM states")
def apply_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports after all decisions: an approval settles every report of its number that waits, a rejection one."""
    return reviewed(accepted(spark, sf_dir), decisions(spark, sf_dir))[0].select("id", "phone_number", "status")


@query("""SELECT d.decision_id, CASE WHEN e.decision_id IS NULL THEN 'BLACKLIST_REPORT_NOT_FOUND' WHEN e.nth > 1 THEN 'REPORT_ALREADY_REVIEWED'
WHEN e.verdict = 'REJECT' AND (w.moment IS NULL OR (e.moment, e.decision_id) < (w.moment, w.decision_id)) THEN 'REJECTED' WHEN e.decision_id = w.decision_id THEN 'APPROVED' ELSE 'REPORT_ALREADY_REVIEWED' END AS result
FROM decisions d LEFT JOIN each e USING (decision_id) LEFT JOIN won w ON w.phone_number = e.phone_number""")
def review_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came of every decision."""
    return reviewed(accepted(spark, sf_dir), decisions(spark, sf_dir))[1]


@query("""SELECT coalesce(b.phone_number, w.phone_number) AS phone_number, w.phone_number IS NOT NULL OR b.active AS active,
CASE WHEN b.phone_number IS NULL THEN coalesce(w.reason, w.reported) ELSE coalesce(w.reason, 'listed ' || b.phone_number) END AS reason FROM blacklist_numbers b FULL JOIN won w ON w.phone_number = b.phone_number""")
def reviewed_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blacklist after all approvals."""
    return blacklist_after(listed(spark, sf_dir), reviewed(accepted(spark, sf_dir), decisions(spark, sf_dir))[2])


@query("""SELECT s.id, s.phone_number, s.reporter_id, s.status, n.reports_for_number, s.phone_number IN (SELECT phone_number FROM blacklist_numbers WHERE active) OR EXISTS (SELECT 1 FROM won w WHERE w.phone_number = s.phone_number) AS blacklisted
FROM states s JOIN (SELECT phone_number, count(DISTINCT reporter_id) AS reports_for_number FROM reports GROUP BY 1) n USING (phone_number) WHERE s.status = 'PENDING' AND contains(s.phone_number, '9000000')""")
def report_search(spark: SparkSession, sf_dir: str, status: str | None = "PENDING", digits: str | None = "09000000") -> DataFrame:
    """The reviewers' list under an optional status and digits of the number: how many users reported a number, whether it is listed now."""
    states, _, approved = reviewed(accepted(spark, sf_dir), decisions(spark, sf_dir))
    counts = states.groupBy("phone_number").agg(F.countDistinct("reporter_id").alias("reports_for_number"))
    now = blacklist_after(listed(spark, sf_dir), approved).where("active").select("phone_number", F.lit(True).alias("listed"))
    wanted = states.where(optional(F.col("status") == status if status else None, F.col("phone_number").contains(search_digits(F.lit(digits))) if digits else None))
    return (wanted.join(counts, "phone_number").join(now, "phone_number", "left")
            .select("id", "phone_number", "reporter_id", "status", "reports_for_number", F.coalesce("listed", F.lit(False)).alias("blacklisted")))
