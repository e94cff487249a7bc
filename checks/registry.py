"""All registered queries."""

from __future__ import annotations

from checks import board_queries, board_sql, corpus_queries, corpus_sql, publication_queries, publication_sql

QUERIES = {**board_queries.QUERIES, **publication_queries.QUERIES, **corpus_queries.QUERIES}
SQL = {**board_sql.SQL, **publication_sql.SQL, **corpus_sql.SQL}
