"""Registered searches with the trigram branch, against their SQL."""

import os
import random

import duckdb
import pytest

from lectern.plans.registry import ORACLE_SQL, QUERIES
from tests.test_similar_extents import invented, single


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Texts that have a query's words cut, stretched or repeated, and vectors for some of them."""
    rng, folder = random.Random(12), tmp_path_factory.mktemp("tables")
    asked = ["brachial plexus", "abca bode gihoju fégi", "hojuho", invented(rng, 12), "nowhere"]
    texts = ["the brachil plexus", "brachial nerves, a plexsus", "zz " * 700 + "abca boda gihoju fegi", "abca zz zz zz bode gihoju fégi " * 30, "hojuhoju", "", asked[3].replace(" ", "s "), " ".join(asked[3].split()[2:])]
    texts += [invented(rng, rng.randrange(90)) for _ in range(60)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR, lang VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR); CREATE TABLE embeddings (vec_id BIGINT, label INTEGER, embedding FLOAT[])")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, 'en')", [(k, t, f"src{k % 3}") for k, t in enumerate(texts, 1)])
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [(k if k < 4 else 5, t + ". more") for k, t in enumerate(asked)])
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [(k, k % 10, [rng.uniform(-1, 1) for _ in range(4)]) for k in range(80)])
    for name in ("documents", "benchmark", "embeddings"):
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet'")
    return con, os.fspath(folder), texts, asked


def both(spark, tables, name):
    con, folder, *_ = tables
    want = con.execute(f"SELECT * FROM ({ORACLE_SQL[name]})")
    cols = [x[0] for x in want.description]
    plain = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    rows = plain(QUERIES[name](spark, folder).select(*cols).collect())
    assert rows == plain(want.fetchall())
    return [dict(zip(cols, r)) for r in rows]


def test_lexical_search_has_what_is_alike_only(spark, tables):
    """texts that are alike by trigrams, but hold neither all words nor the query, weren't found."""
    *_, texts, asked = tables
    rows = both(spark, tables, "lexical_search")
    only = [r for r in rows if not r["exact"] and not r["rank"]]
    assert {(0, 1), (1, 3), (3, 7)} <= {(r["query_id"], r["chunk_id"]) for r in only}
    for r in rows:
        assert abs(r["trigram"] - single(asked[r["query_id"]], texts[r["chunk_id"] - 1])) < 1e-6


def test_hybrid_search_has_what_is_alike_only(spark, tables):
    """the lexical channel left out what is alike by trigrams only."""
    rows = both(spark, tables, "hybrid_search")
    ranked = {(r["query_id"], r["chunk_id"]) for r in rows if r["lexical_rank"]}
    assert {(0, 1), (1, 3), (3, 7)} <= ranked
