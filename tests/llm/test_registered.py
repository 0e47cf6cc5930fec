"""The registered training-data queries against their SQL, on a small scale."""

import os

import duckdb
import pytest

from marlstone.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    want = con.sql(ORACLES[name])
    frame = QUERIES[name](spark, SF)
    assert sorted(frame.columns) == sorted(want.columns)
    order = sorted(frame.columns)
    pick = lambda columns, found: sorted(tuple(str(r[columns.index(c)]) for c in order) for r in found)
    assert pick(frame.columns, frame.collect()) == pick(want.columns, want.fetchall())


def test_every_operator_is_registered():
    assert [sum(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 11)] == [1] * 10
