"""Registered queries of the search and verification engine, with SQL that gives the same rows."""

from __future__ import annotations

from findspar.plans import answers, events, indexing, replies, retrieval, texts

MODULES = (texts, retrieval, indexing, answers, replies, events)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
