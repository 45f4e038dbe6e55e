"""The registered queries and their DuckDB twins."""

from __future__ import annotations

from threadloom.plans import decision_queries, evaluation_queries, lifecycle_queries, message_queries, retrieval_queries, rollup_queries, session_queries, store_queries, text_queries, tree_queries

MODULES = [retrieval_queries, store_queries, text_queries, decision_queries, tree_queries, message_queries, evaluation_queries, lifecycle_queries, rollup_queries, session_queries]


def queries():
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
