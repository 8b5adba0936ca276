"""Queries on the call database: histories, statistics, queues and list mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringwarden.functions.scalar import canonical_phone, email_key, search_digits
from ringwarden.operators.latest import latest_by, optional, page, page_info, zero_filled
from ringwarden.session import read_table
from ringwarden.sources.domain import ANALYSIS_ORDER, PRELUDE, analyses, blacklist_numbers, call_records, users

LEVELS = ["LOW", "MEDIUM", "HIGH"]
STATUSES = ["PENDING", "PROCESSING", "COMPLETED", "FAILED"]
SOURCES = ["RECORDED", "UPLOADED", "LIVE"]
ZONE = "Asia/Ho_Chi_Minh"
TODAY = "2001-07-31"
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, prelude: str = PRELUDE):
    """Register a query under its function's name, with the SQL of the same rows."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = prelude + sql
        return f

    return add


def latest_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest analysis of each call that has a result."""
    return latest_by(analyses(spark, sf_dir).where("risk_score is not null"), ["call_id"], ANALYSIS_ORDER)


def latest_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest analysis of each call, whatever its status."""
    return latest_by(analyses(spark, sf_dir), ["call_id"], ANALYSIS_ORDER)


@query("""SELECT c.caller_number AS phone_number, count(*) AS calls, count(DISTINCT c.user_id) AS users, max(c.created_at) AS last_call
FROM latest_risk r JOIN call_records c ON c.id = r.call_id
WHERE r.risk_level = 'HIGH' AND c.caller_number IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM blacklist_numbers b WHERE b.active AND b.phone_number = c.caller_number)
GROUP BY 1 ORDER BY calls DESC, last_call DESC, phone_number LIMIT 10""")
def top_suspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with most calls whose newest result is HIGH, not on the active blacklist."""
    high = latest_risk(spark, sf_dir).where("risk_level = 'HIGH'").select("call_id")
    calls = call_records(spark, sf_dir).where("caller_number is not null")
    listed = blacklist_numbers(spark, sf_dir).where("active").select(F.col("phone_number").alias("caller_number"))
    return (calls.join(high, calls["id"] == high["call_id"], "left_semi").join(listed, "caller_number", "left_anti")
            .groupBy(F.col("caller_number").alias("phone_number"))
            .agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("user_id").alias("users"), F.max("created_at").alias("last_call"))
            .orderBy(F.desc("calls"), F.desc("last_call"), "phone_number").limit(10))


@query("""SELECT code, count(*) AS calls FROM (SELECT unnest(codes) AS code FROM latest_risk) GROUP BY code ORDER BY calls DESC, code LIMIT 10""")
def top_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent indicators of newest results."""
    return (latest_risk(spark, sf_dir).select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("calls"))
            .orderBy(F.desc("calls"), "code").limit(10))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each call with its owner, newest analysis, sorted indicators and whether the caller is blacklisted."""
    calls, people = call_records(spark, sf_dir), users(spark, sf_dir).select(F.col("id").alias("user_id"), "full_name", "status")
    newest = latest_any(spark, sf_dir).select(F.col("call_id").alias("id"), F.col("status").alias("analysis_status"), "risk_score", "risk_level", "codes")
    listed = blacklist_numbers(spark, sf_dir).where("active").select(F.col("phone_number").alias("caller_number"), F.lit(True).alias("listed"))
    return (calls.join(people, "user_id").join(newest, "id", "left").join(listed, "caller_number", "left")
            .select("id", "user_id", "full_name", "caller_number", "source", "created_at", "analysis_status", "risk_score", "risk_level",
                    F.array_join(F.array_sort(F.coalesce("codes", F.array().cast("array<string>"))), ",").alias("indicators"),
                    F.coalesce("listed", F.lit(False)).alias("caller_blacklisted")))


HISTORY = """, history AS (SELECT c.id, c.user_id, u.full_name, c.caller_number, c.source, c.created_at, a.status AS analysis_status, a.risk_score, a.risk_level,
  array_to_string(list_sort(coalesce(a.codes, [])), ',') AS indicators,
  EXISTS (SELECT 1 FROM blacklist_numbers b WHERE b.active AND b.phone_number = c.caller_number) AS caller_blacklisted
FROM call_records c JOIN users u ON u.id = c.user_id LEFT JOIN latest_any a ON a.call_id = c.id)
"""


@query(HISTORY + "SELECT * FROM history")
def call_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history row of every call (inner, left, latest-one and existence joins, ordered array)."""
    return history(spark, sf_dir)


@query(HISTORY + """SELECT * FROM history WHERE risk_level = 'HIGH' AND source = 'LIVE' AND created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1999-01-01'
AND contains(caller_number, '0000001')""")
def history_filtered(spark: SparkSession, sf_dir: str, level: str | None = "HIGH", source: str | None = "LIVE", start: str | None = "1996-01-01",
                     end: str | None = "1999-01-01", digits: str | None = "0000001") -> DataFrame:
    """Histories under optional filters; a missing one does not filter, the time range is half open."""
    h = history(spark, sf_dir)
    return h.where(optional(
        F.col("risk_level") == level if level else None, F.col("source") == source if source else None,
        F.col("created_at") >= F.lit(start).cast("timestamp_ntz") if start else None, F.col("created_at") < F.lit(end).cast("timestamp_ntz") if end else None,
        F.col("caller_number").contains(digits) if digits else None))


@query(HISTORY + "SELECT * FROM history WHERE user_id = 7 ORDER BY created_at DESC, id DESC LIMIT 5 OFFSET 5")
def history_page(spark: SparkSession, sf_dir: str, user_id: int = 7, number: int = 1, size: int = 5) -> DataFrame:
    """One page of an owner's calls, newest first."""
    return page(history(spark, sf_dir).where(F.col("user_id") == user_id), [F.desc("created_at"), F.desc("id")], number, size)


@query(HISTORY + "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM history WHERE risk_level = 'MEDIUM'")
def history_page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and pages of the histories at level MEDIUM."""
    return page_info(history(spark, sf_dir).where("risk_level = 'MEDIUM'"), 20)


@query(f""", days AS (SELECT CAST(unnest(generate_series(DATE '{TODAY}' - 29, DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT d.day, count(c.id) AS calls, count(*) FILTER (WHERE r.risk_level = 'HIGH') AS high, count(*) FILTER (WHERE r.risk_level = 'MEDIUM') AS medium,
  count(*) FILTER (WHERE r.risk_level = 'LOW') AS low
FROM days d LEFT JOIN call_records c ON CAST(timezone('{ZONE}', timezone('UTC', c.created_at)) AS DATE) = d.day LEFT JOIN latest_risk r ON r.call_id = c.id
GROUP BY d.day""")
def daily_report(spark: SparkSession, sf_dir: str, today: str = TODAY, days: int = 30, zone: str = ZONE) -> DataFrame:
    """Calls by local day and level over the last ``days`` (1 to 365) days; days without calls appear."""
    days = max(1, min(365, days))
    spine = spark.range(days).select(F.date_sub(F.lit(today).cast("date"), F.col("id").cast("int")).alias("day"))
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("created_at")))
    calls = call_records(spark, sf_dir).select("id", local.alias("day")).where(F.col("day").between(F.date_sub(F.lit(today).cast("date"), days - 1), F.lit(today).cast("date")))
    risk = latest_risk(spark, sf_dir).select(F.col("call_id").alias("id"), "risk_level")
    return spine.join(calls.join(risk, "id", "left"), "day", "left").groupBy("day").agg(F.count("id").alias("calls"), *[F.count_if(F.col("risk_level") == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW")])


@query("""SELECT l.level, coalesce(n.n, 0) AS n FROM (SELECT unnest(['LOW', 'MEDIUM', 'HIGH']) AS level) l
LEFT JOIN (SELECT risk_level, count(*) AS n FROM latest_risk GROUP BY 1) n ON n.risk_level = l.level""")
def risk_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest results by level; every level appears."""
    n = latest_risk(spark, sf_dir).groupBy(F.col("risk_level").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(n, "level", "n", LEVELS)


@query("""SELECT s.status, coalesce(n.n, 0) AS n FROM (SELECT unnest(['PENDING', 'PROCESSING', 'COMPLETED', 'FAILED', 'CANCELLED']) AS status) s
LEFT JOIN (SELECT status, count(*) AS n FROM analyses GROUP BY 1) n USING (status)""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses by status, one status of the list without a row."""
    n = analyses(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(n, "status", "n", [*STATUSES, "CANCELLED"])


@query("""SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM users WHERE status = 'LOCKED') AS locked, (SELECT count(*) FROM call_records) AS calls,
(SELECT count(*) FROM analyses) AS analyses, (SELECT count(*) FROM analyses WHERE status = 'FAILED') AS failed,
(SELECT count(*) FROM blacklist_numbers) AS numbers, (SELECT count(*) FROM blacklist_numbers WHERE active) AS active_numbers""")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar counts, one pass a table."""
    u = users(spark, sf_dir).agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("status") == "LOCKED").alias("locked"))
    c = call_records(spark, sf_dir).agg(F.count(F.lit(1)).alias("calls"))
    a = analyses(spark, sf_dir).agg(F.count(F.lit(1)).alias("analyses"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    b = blacklist_numbers(spark, sf_dir).agg(F.count(F.lit(1)).alias("numbers"), F.count_if("active").alias("active_numbers"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(u).join(one(c), "_k").join(one(a), "_k").join(one(b), "_k").drop("_k")


@query("SELECT call_id, created_at, status, risk_score FROM latest_any")
def latest_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest analysis of each call."""
    return latest_any(spark, sf_dir).select("call_id", "created_at", "status", "risk_score")


@query("SELECT c.id, c.user_id FROM call_records c WHERE EXISTS (SELECT 1 FROM analyses a WHERE a.call_id = c.id AND a.status IN ('PENDING', 'PROCESSING'))")
def calls_in_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with an unfinished analysis (semi join)."""
    open_ = analyses(spark, sf_dir).where(F.col("status").isin("PENDING", "PROCESSING")).select(F.col("call_id").alias("id"))
    return call_records(spark, sf_dir).select("id", "user_id").join(open_, "id", "left_semi")


@query("""SELECT b.phone_number, count(c.id) AS calls, count(DISTINCT c.user_id) AS users FROM blacklist_numbers b LEFT JOIN call_records c ON c.caller_number = b.phone_number
WHERE b.active GROUP BY 1""")
def blacklist_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and users of every active blacklisted number."""
    calls = call_records(spark, sf_dir).select(F.col("caller_number").alias("phone_number"), "id", "user_id")
    return (blacklist_numbers(spark, sf_dir).where("active").join(calls, "phone_number", "left").groupBy("phone_number")
            .agg(F.count("id").alias("calls"), F.countDistinct("user_id").alias("users")))


@query("SELECT id, full_name, email, status FROM users WHERE (contains(lower(full_name), '00012') OR contains(lower(email), '77@')) AND status = 'ACTIVE'")
def search_users(spark: SparkSession, sf_dir: str, texts: tuple[str, str] = ("00012", "77@"), status: str | None = "ACTIVE") -> DataFrame:
    """Users whose name or email contains a text, any case, with an optional status."""
    hit = F.lower("full_name").contains(texts[0].lower()) | F.lower("email").contains(texts[1].lower())
    return users(spark, sf_dir).where(optional(hit, F.col("status") == status if status else None))


@query("""SELECT c.id, c.caller_number, regexp_replace(regexp_replace(c.caller_number, '[^0-9]', '', 'g'), '^0', '') AS digits FROM call_records c WHERE c.caller_number IS NOT NULL""")
def caller_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digits by which a number is searched."""
    return call_records(spark, sf_dir).where("caller_number is not null").select("id", "caller_number", search_digits(F.col("caller_number")).alias("digits"))


@query(r""", raw AS (SELECT id, CASE id % 6 WHEN 0 THEN '0' || (900000000 + id) WHEN 1 THEN '84 ' || (900000000 + id) WHEN 2 THEN '+84-' || (900000000 + id)
  WHEN 3 THEN '(09) 12.' || id WHEN 4 THEN 'call ' || id ELSE '  ' END AS raw FROM call_records), s AS (SELECT id, regexp_replace(raw, '[\s.()-]', '', 'g') AS s FROM raw)
SELECT id, CASE WHEN NOT regexp_full_match(s, '\+?[0-9]{6,15}') THEN NULL WHEN s LIKE '0%' AND len(s) >= 10 THEN '+84' || s[2:]
  WHEN s LIKE '84%' AND len(s) >= 11 THEN '+' || s ELSE s END AS phone FROM s""")
def phone_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical forms of numbers written in several ways; what is no number is null."""
    i = F.col("id")
    raw = (F.when(i % 6 == 0, F.concat(F.lit("0"), (i + 900000000).cast("string"))).when(i % 6 == 1, F.concat(F.lit("84 "), (i + 900000000).cast("string")))
           .when(i % 6 == 2, F.concat(F.lit("+84-"), (i + 900000000).cast("string"))).when(i % 6 == 3, F.concat(F.lit("(09) 12."), i.cast("string")))
           .when(i % 6 == 4, F.concat(F.lit("call "), i.cast("string"))).otherwise("  "))
    return call_records(spark, sf_dir).select("id", canonical_phone(raw).alias("phone"))


@query("""SELECT call_id, bool_or(status = 'COMPLETED') AS completed, coalesce(arg_min(status, (created_at, line)) FILTER (WHERE status IN ('COMPLETED', 'FAILED')),
CASE WHEN bool_or(status = 'PROCESSING') THEN 'PROCESSING' ELSE 'PENDING' END) AS state FROM analyses GROUP BY call_id""")
def call_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that a call's status events lead to; the first of COMPLETED and FAILED, by time, is final; at one time and line, the one stored first."""
    stored = F.struct("_metadata.file_path", "_metadata.row_index").alias("stored")
    final = F.when(F.col("status").isin("COMPLETED", "FAILED"), F.struct("created_at", "line", "stored", "status"))
    grouped = analyses(spark, sf_dir, stored).groupBy("call_id").agg(F.bool_or(F.col("status") == "COMPLETED").alias("completed"), F.min(final)["status"].alias("final"),
                                                             F.bool_or(F.col("status") == "PROCESSING").alias("working"))
    return grouped.select("call_id", "completed", F.coalesce("final", F.when(F.col("working"), "PROCESSING").otherwise("PENDING")).alias("state"))


@query("""SELECT user_id, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM call_records) WHERE rn <= 10""")
def keep_newest(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """The ``n`` newest calls of each user; the others would be deleted."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return call_records(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select("user_id", "id", "created_at")


@query("""SELECT caller_number, user_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY caller_number ORDER BY created_at DESC, id DESC) AS rn FROM call_records
WHERE caller_number IS NOT NULL) WHERE rn = 1""")
def upsert_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert of later rows over earlier ones by number: the last writer wins."""
    calls = call_records(spark, sf_dir).where("caller_number is not null")
    old, new = calls.where("id % 2 = 0"), calls.where("id % 2 = 1")
    both = old.unionByName(new).select("caller_number", "user_id", "created_at", "id")
    return latest_by(both, ["caller_number"], ["created_at", "id"]).drop("id")


@query("""SELECT a.status, count(*) AS rows FROM analyses a WHERE a.call_id NOT IN (SELECT c.id FROM call_records c JOIN users u ON u.id = c.user_id WHERE u.status = 'LOCKED'
AND NOT EXISTS (SELECT 1 FROM analyses x WHERE x.call_id = c.id AND x.status IN ('PENDING', 'PROCESSING'))) GROUP BY 1""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses left, by status, after the calls of locked users go, unless one is still in work."""
    locked = users(spark, sf_dir).where("status = 'LOCKED'").select(F.col("id").alias("user_id"))
    gone = call_records(spark, sf_dir).join(locked, "user_id", "left_semi").select("id").join(calls_in_work(spark, sf_dir).select("id"), "id", "left_anti")
    return (analyses(spark, sf_dir).join(gone.withColumnRenamed("id", "call_id"), "call_id", "left_anti").groupBy("status").agg(F.count(F.lit(1)).alias("rows")))


@query("""SELECT CASE WHEN status IN ('PENDING', 'PROCESSING') THEN 'FAILED' ELSE status END AS status, count(*) AS rows, count(*) FILTER (WHERE status IN ('PENDING', 'PROCESSING')) AS changed
FROM analyses GROUP BY 1""")
def fail_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bulk update that fails unfinished analyses, with the number of changed rows."""
    open_ = F.col("status").isin("PENDING", "PROCESSING")
    after = analyses(spark, sf_dir).select(F.when(open_, "FAILED").otherwise(F.col("status")).alias("status"), open_.alias("changed"))
    return after.groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.count_if("changed").alias("changed"))


@query("SELECT id, lower(trim(email)) AS email FROM (SELECT id, '  ' || upper(email) || ' ' AS email FROM users)")
def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails in the form by which they are unique."""
    return users(spark, sf_dir).select("id", email_key(F.concat(F.lit("  "), F.upper("email"), F.lit(" "))).alias("email"))


@query("""SELECT u.id AS user_id, count(a.call_id) AS notified, count(*) FILTER (WHERE a.risk_level = 'HIGH') AS unread FROM users u LEFT JOIN call_records c ON c.user_id = u.id
LEFT JOIN latest_risk a ON a.call_id = c.id AND a.risk_level <> 'LOW' GROUP BY 1""")
def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications of results above LOW by user; those of HIGH are unread."""
    risky = latest_risk(spark, sf_dir).where("risk_level <> 'LOW'").select(F.col("call_id").alias("id"), "risk_level")
    calls = call_records(spark, sf_dir).select("id", "user_id").join(risky, "id")
    return (users(spark, sf_dir).select(F.col("id").alias("user_id")).join(calls, "user_id", "left").groupBy("user_id")
            .agg(F.count("id").alias("notified"), F.count_if(F.col("risk_level") == "HIGH").alias("unread")))


@query("""SELECT floor((row_number() OVER (ORDER BY id) - 1) / 100)::BIGINT AS batch, id FROM users""")
def send_batches(spark: SparkSession, sf_dir: str, size: int = 100) -> DataFrame:
    """Users in batches of ``size`` by id."""
    from ringwarden.operators.ranking import rank_by_range

    ranked = rank_by_range(users(spark, sf_dir).select("id").withColumn("all", F.lit(0)), ["all"], "id", "place")
    return ranked.select(F.floor(F.col("place") / size).cast("long").alias("batch"), "id")


@query("""SELECT user_id, id, prev, CAST(minutes AS BIGINT) AS minutes FROM (SELECT user_id, id, lag(id) OVER w AS prev, date_diff('second', lag(created_at) OVER w, created_at) // 60 AS minutes
FROM call_records WINDOW w AS (PARTITION BY user_id ORDER BY created_at, id))""")
def call_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call before each call of a user and the whole minutes between."""
    w = Window.partitionBy("user_id").orderBy("created_at", "id")
    gap = F.timestamp_diff("SECOND", F.lag("created_at").over(w), F.col("created_at"))
    return call_records(spark, sf_dir).select("user_id", "id", F.lag("id").over(w).alias("prev"), F.floor(gap / 60).alias("minutes"))
