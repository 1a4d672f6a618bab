"""The trie's rows against its SQL, nulls as None."""

import os

import duckdb
import pytest

from lectern.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_trie_rows_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    got = queries.QUERIES["op11_prefix_trie"](spark, SF)
    want = con.sql(queries.ORACLE_SQL["op11_prefix_trie"])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(map(tuple, got.select(want.columns).collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr) and any(None in r for r in rows)
