"""Governed queries keep to their columns and their oracle as the rewrites change."""

import duckdb
import pytest

from marlstone.operators import all_queries
from marlstone.plans import rewrite

QUERIES = {q.name: q for q in all_queries()}
SF = "/root/testdata/sf0.01"


def against_oracle(spark, name):
    """The query's rows, found equal to its SQL over a larger table than test_queries has."""
    con = duckdb.connect()
    for table in ("customer", "part", "orders", "lineitem", "nation", "region"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    frame, want = QUERIES[name].run(spark, SF), con.sql(QUERIES[name].oracle)
    assert sorted(frame.columns) == sorted(want.columns)
    got = sorted(tuple(r) for r in frame.select(*want.columns).collect())
    assert got == sorted(want.fetchall())
    return got


def test_small_cells_without_counts_by_one_expression(spark):
    assert rewrite.CELL_DIM + "0" not in QUERIES["users_by_country_k5"].run(spark, SF).columns
    assert against_oracle(spark, "users_by_country_k5")


def test_small_cells_without_counts_by_two_expressions(spark):
    assert against_oracle(spark, "users_by_country_segment_k5")


def test_instrumented_cells_have_no_text_copy_of_their_group(spark):
    assert against_oracle(spark, "instrumented_cells")


def test_population_check_returns_people_only(spark):
    assert len(against_oracle(spark, "population_check_pass")[0]) == 1


def test_small_cells_by_two_expressions_count_people_not_rows(spark, tmp_path, monkeypatch):
    tables = {
        "region": "SELECT 0 AS r_regionkey, 'R' AS r_name",
        "nation": "SELECT * FROM (VALUES (0, 'A', 0), (1, 'B', 0)) t(n_nationkey, n_name, n_regionkey)",
        "part": "SELECT * FROM (VALUES (1, 'p', 'Brand#1', 't', 1, 1.0::DOUBLE), (2, 'q', 'Brand#3', 't', 1, 1.0::DOUBLE)) t(p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)",
        # A: five people; four in five rows; five, one at the bound; five, one out of scope.  B: five without a segment in six rows.
        "customer": """
            SELECT i::BIGINT AS c_custkey, CASE WHEN i < 20 THEN 0 ELSE 1 END AS c_nationkey, CASE WHEN i = 10 THEN 7000.0 ELSE 7000.01 END::DOUBLE AS c_acctbal,
              CASE WHEN i < 5 THEN 'five' WHEN i < 10 THEN 'four' WHEN i < 15 THEN 'bound' WHEN i < 20 THEN 'outside' END AS c_mktsegment
            FROM (SELECT CASE WHEN i = 9 THEN 8 ELSE i END AS i FROM range(25) r(i) UNION ALL SELECT 24)""",
        "orders": "SELECT i AS o_orderkey, i AS o_custkey, 'O' AS o_orderstatus, 'p' AS o_orderpriority, TIMESTAMP '2020-01-01' AS o_orderdate FROM range(25) r(i)",
        "lineitem": """
            SELECT i AS l_orderkey, CASE WHEN i = 19 THEN 2 ELSE 1 END AS l_partkey, 1.0::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount,
              'N' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '2020-01-02' AS l_shipdate FROM range(25) r(i)""",
    }
    for name, sql in tables.items():
        duckdb.connect().sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    monkeypatch.setitem(globals(), "SF", str(tmp_path))
    got = [tuple(r) for r in QUERIES["users_by_country_segment_k5"].run(spark, SF).select("country", "traffic_source", "n").collect()]
    assert sorted(got) == [("A", "five", 5), ("B", None, 6)]
    assert len(against_oracle(spark, "users_by_country_segment_k5")) == 2
