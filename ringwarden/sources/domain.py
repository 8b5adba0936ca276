"""The call-database views, derived from the given tables.

users <- customer, call_records <- orders, analyses with their risk results <-
lineitem, indicators <- flags of lineitem, blacklist <- supplier.  The same
derivations in SQL are the prelude of the checking queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwarden.session import read_table

#: Orders analyses of one call totally; rows equal in all of these are the same to every query.
ANALYSIS_ORDER = ["created_at", "line", "part_id", "supplier_id", "quantity", "price"]


def phone(number: Column) -> Column:
    """A synthetic phone number of a small number space."""
    return F.concat(F.lit("+849"), F.lpad((number % 97).cast("string"), 8, "0"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, full_name, email, status)."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"),
                    F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")), F.lit("@example.com")).alias("email"),
                    F.when(F.col("c_acctbal") < 0, "LOCKED").otherwise("ACTIVE").alias("status"))


def call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, caller_number, source, created_at); some numbers are null."""
    o = read_table(spark, sf_dir, "orders")
    source = F.when(F.col("o_orderkey") % 3 == 0, "RECORDED").when(F.col("o_orderkey") % 3 == 1, "UPLOADED").otherwise("LIVE")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
                    F.when(F.col("o_orderkey") % 11 != 0, phone(F.col("o_custkey"))).alias("caller_number"),
                    source.alias("source"), F.col("o_orderdate").alias("created_at"))


def analyses(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """(call_id, created_at, status, risk_score, risk_level, codes, ...); score and level are null unless completed.  ``more`` are columns over the stored rows."""
    li = read_table(spark, sf_dir, "lineitem")
    done = F.col("l_linestatus") == "F"
    status = F.when(done, "COMPLETED").when(F.col("l_returnflag") == "A", "FAILED").when(F.col("l_returnflag") == "R", "PROCESSING").otherwise("PENDING")
    score = F.when(done, (F.col("l_quantity") * 2).cast("int"))
    codes = F.array_compact(F.array(
        F.when(F.col("l_returnflag") == "R", "OTP_REQUEST"), F.when(F.col("l_returnflag") == "A", "MONEY_TRANSFER"),
        F.when(F.col("l_discount") > 0.05, "URGENCY"), F.when(F.col("l_quantity") > 30, "BANK_IMPERSONATION")))
    return li.select(
        F.col("l_orderkey").alias("call_id"), F.col("l_shipdate").alias("created_at"), status.alias("status"), score.alias("risk_score"),
        F.when(score >= 60, "HIGH").when(score >= 30, "MEDIUM").when(score.isNotNull(), "LOW").alias("risk_level"),
        F.when(done, codes).alias("codes"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), *more)


def blacklist_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(phone_number, active): one row a number."""
    s = read_table(spark, sf_dir, "supplier")
    return (s.select(phone(F.col("s_suppkey")).alias("phone_number"), (F.col("s_acctbal") > 5000).alias("active"))
            .groupBy("phone_number").agg(F.bool_or("active").alias("active")))


#: The same views for the checking SQL.
PRELUDE = """
WITH users AS (
  SELECT c_custkey AS id, c_name AS full_name, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '@example.com' AS email,
         CASE WHEN c_acctbal < 0 THEN 'LOCKED' ELSE 'ACTIVE' END AS status FROM customer),
call_records AS (
  SELECT o_orderkey AS id, o_custkey AS user_id,
         CASE WHEN o_orderkey % 11 <> 0 THEN '+849' || lpad(CAST(o_custkey % 97 AS VARCHAR), 8, '0') END AS caller_number,
         CASE o_orderkey % 3 WHEN 0 THEN 'RECORDED' WHEN 1 THEN 'UPLOADED' ELSE 'LIVE' END AS source, o_orderdate AS created_at FROM orders),
analyses AS (
  SELECT *, CASE WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM' WHEN risk_score IS NOT NULL THEN 'LOW' END AS risk_level,
         row_number() OVER (PARTITION BY call_id ORDER BY created_at DESC, line DESC, part_id DESC, supplier_id DESC, quantity DESC, price DESC) AS rn_any
  FROM (SELECT l_orderkey AS call_id, l_shipdate AS created_at,
               CASE WHEN l_linestatus = 'F' THEN 'COMPLETED' WHEN l_returnflag = 'A' THEN 'FAILED' WHEN l_returnflag = 'R' THEN 'PROCESSING' ELSE 'PENDING' END AS status,
               CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity * 2 AS INTEGER) END AS risk_score,
               CASE WHEN l_linestatus = 'F' THEN list_filter([CASE WHEN l_returnflag = 'R' THEN 'OTP_REQUEST' END, CASE WHEN l_returnflag = 'A' THEN 'MONEY_TRANSFER' END,
                    CASE WHEN l_discount > 0.05 THEN 'URGENCY' END, CASE WHEN l_quantity > 30 THEN 'BANK_IMPERSONATION' END], lambda x: x IS NOT NULL) END AS codes,
               l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supplier_id, l_quantity AS quantity, l_extendedprice AS price FROM lineitem)),
latest_any AS (SELECT * FROM analyses WHERE rn_any = 1),
latest_risk AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY created_at DESC, line DESC, part_id DESC, supplier_id DESC, quantity DESC, price DESC) AS rn
                 FROM analyses WHERE risk_score IS NOT NULL) WHERE rn = 1),
blacklist_numbers AS (
  SELECT '+849' || lpad(CAST(s_suppkey % 97 AS VARCHAR), 8, '0') AS phone_number, bool_or(s_acctbal > 5000) AS active FROM supplier GROUP BY 1)
"""
