"""All registered queries of the library and the DuckDB SQL of the same rows."""

from __future__ import annotations

from lectern.plans import integrity_queries, learner_queries, retrieval_queries, streaming_queries, text_queries

_PARTS = (retrieval_queries, text_queries, learner_queries, integrity_queries, streaming_queries)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: text for part in _PARTS for name, text in part.ORACLE_SQL.items()}
