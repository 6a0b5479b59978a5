"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from lawframe.plans import document_queries, index_queries, lateral_queries, more_queries, search_queries, store_queries, stream_queries, structure_queries, text_queries


def _all() -> dict:
    return text_queries.QUERIES | search_queries.QUERIES | structure_queries.QUERIES | store_queries.QUERIES | more_queries.QUERIES | document_queries.QUERIES | stream_queries.QUERIES | index_queries.QUERIES | lateral_queries.QUERIES


def queries() -> dict:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}
