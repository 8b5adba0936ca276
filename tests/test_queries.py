"""Every registered query with SQL gives the rows of that SQL in DuckDB."""

import decimal
import os
from collections import Counter

import duckdb
import pytest

from ringwarden.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want = Counter(repr(tuple(plain(x) for x in row)) for row in cursor.fetchall())
    assert Counter(repr(tuple(plain(r[c]) for c in names)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_events_of_one_time(spark, tmp_path):
    rows = [(k, 7, s, f) for k, order in ((1, "FO"), (2, "OF")) for s, f in ((s, "A") for s in order)]
    day = "cast('1997-01-22' as timestamp_ntz)"
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_linestatus string, l_returnflag string").coalesce(1)
    df.selectExpr("*", f"{day} as l_shipdate", "1D as l_quantity", "0D as l_discount", "1L as l_partkey", "1L as l_suppkey", "1D as l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.call_id: r.state for r in QUERIES["call_states"](spark, str(tmp_path)).collect()} == {1: "COMPLETED", 2: "FAILED"}


def test_phrases_beside_bars(spark, tmp_path):
    texts = ["the | of", "the|of", "the of", "| the | and |", "not | the of", "not. the of", "not the of", "a.|the of", "der die|", "the and the of?|not the of", "|", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = Counter((r.id, r.phrase_id) for r in QUERIES["custom_phrases"](spark, str(tmp_path)).collect())
    assert got == Counter(con.execute(ORACLES["custom_phrases"]).fetchall())
