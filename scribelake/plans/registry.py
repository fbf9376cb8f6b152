"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import corpus_queries, ledger_queries, listing_queries, search_queries, sync_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (search_queries, ledger_queries, corpus_queries, sync_queries, listing_queries):
    QUERIES |= _module.BOOK.queries
    ORACLE_SQL |= _module.BOOK.sql
