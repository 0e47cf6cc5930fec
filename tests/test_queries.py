"""Every registered query of the library against its DuckDB oracle, and some plans."""

import datetime
import decimal
import os

import duckdb
import pytest

from marlstone.operators import all_queries

QUERIES = {q.name: q for q in all_queries()}
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, duck, name):
    q = QUERIES[name]
    frame = q.run(spark, SF)
    got = frame.collect()
    assert q.ids and len(set(frame.columns)) == len(frame.columns)
    if q.oracle:
        want = duck.sql(q.oracle)
        assert sorted(frame.columns) == sorted(want.columns)
        assert rows(frame.columns, got) == rows(want.columns, want.fetchall())


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["having_filter"].run(spark, SF))
    assert "ReadSchema: struct<o_custkey:bigint>" in text
    text = plan(QUERIES["join_semi"].run(spark, SF))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,300000" in text
    text = plan(QUERIES["brand_category_split"].run(spark, SF))
    assert "In(p_brand, [Brand#1,Brand#2])" in text


@pytest.mark.parametrize("name", ["scoped_items", "users_by_country_k5", "root_cause", "feedback_latest", "agg_distinct", "newest_n_per_owner", "bm25_search"])
def test_no_product_of_tables(spark, name):
    text = plan(QUERIES[name].run(spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text or name == "bm25_search"  # one row of corpus totals


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["category", "revenue"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
