"""All queries of the core, by name, and the SQL that each is compared with."""

from __future__ import annotations

from versemill.plans import agent_queries, corpus_queries, poem_queries, source_queries, verse_queries

MODULES = [verse_queries, poem_queries, corpus_queries, agent_queries, source_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
