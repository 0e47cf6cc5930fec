"""NOT IN without a broadcast of its list, against DuckDB with nulls on both sides."""

import duckdb
import pytest

from marlstone.operators import all_queries

QUERY = next(q for q in all_queries() if q.name == "join_not_in")


@pytest.mark.parametrize("listed", [[(1, 10.0), (1, 20.0), (2, 50.0), (4, None)], [(1, 10.0), (None, 10.0)], [(1, 50.0), (None, 45.0)], []])
def test_join_not_in_with_nulls_and_without_broadcast(spark, tmp_path, listed):
    con = duckdb.connect()
    con.sql("create table part (p_partkey bigint)")
    con.executemany("insert into part values (?)", [(1,), (2,), (2,), (3,), (4,), (None,)])
    con.sql("create table lineitem (l_partkey bigint, l_quantity double)")
    if listed:
        con.executemany("insert into lineitem values (?, ?)", listed)
    for name in ("part", "lineitem"):
        con.sql(f"copy {name} to '{tmp_path}/{name}.parquet'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = QUERY.run(spark, str(tmp_path))
        assert "BroadcastExchange" not in frame._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, frame.collect())) == sorted(f"Row(p_partkey={r[0]})" for r in con.sql(QUERY.oracle).fetchall())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
