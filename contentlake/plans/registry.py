"""All queries on the reference's operators, by name, and their SQL."""

from __future__ import annotations

from contentlake.plans import archive_queries, ingest_queries, page_queries, sync_queries, table_queries, text_queries

MODULES = [archive_queries, sync_queries, text_queries, page_queries, table_queries, ingest_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
