"""Name of each query to its callable and to its oracle."""

from __future__ import annotations

from glosswork.plans import contract_queries, corpus_queries, evaluation_queries, extra_queries, file_queries, packing_queries, retrieval_queries, table_queries, text_queries

MODULES = (text_queries, corpus_queries, retrieval_queries, evaluation_queries, table_queries, extra_queries, file_queries, contract_queries, packing_queries)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
