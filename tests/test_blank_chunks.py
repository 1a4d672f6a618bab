"""Documents without text among the chunks."""

import os

import duckdb
import pytest

from lectern.operators import integrity
from lectern.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("blank", ["", "   "])
def test_chunk_violations_equal_sql_with_blank_documents(spark, tmp_path, blank):
    """blank documents were given as faults that the SQL doesn't have, and hid those that it has."""
    rows = ", ".join(f"({k}, '{blank if k % 5 == 0 else 'text'}', 'src{k % 3}', 'en')" for k in range(150))
    duckdb.sql(f"COPY (SELECT doc_id::BIGINT AS doc_id, text, source, lang FROM (VALUES {rows}) t(doc_id, text, source, lang)) TO '{tmp_path}/documents.parquet'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    want = sorted(con.execute(ORACLE_SQL["chunk_violations"]).fetchall())
    got = sorted((r.chunk_id, r.reason) for r in QUERIES["chunk_violations"](spark, os.fspath(tmp_path)).collect())
    assert got == want and {r for _, r in got} == {"RANGE", "NODE"}


def test_blank_text_is_a_fault_of_a_chunk(spark):
    chunks = spark.createDataFrame([(1, "m", "m/s0", 1, 1, " "), (2, "m", "m/s0", 1, 0, "x"), (3, "m", "m/s9", 1, 1, "x"), (4, "m", "m/s0", 1, 1, "x")], "chunk_id long, material_id string, node_id string, start_page long, end_page long, content string")
    nodes = spark.createDataFrame([("m/s0", "m")], "node_id string, material_id string")
    assert {(r.chunk_id, r.reason) for r in integrity.chunk_violations(chunks, nodes).collect()} == {(1, "BLANK"), (2, "RANGE"), (3, "NODE")}
