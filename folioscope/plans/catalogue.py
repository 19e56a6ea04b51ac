"""Catalogue of the engine's queries and the SQL that each must agree with."""

from __future__ import annotations

from folioscope.plans import latex_queries, layout_queries, model_queries, record_queries, report_queries, table_queries, text_queries, vector_queries

PARTS = (text_queries, latex_queries, layout_queries, model_queries, record_queries, report_queries, table_queries, vector_queries)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.Q.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.Q.sql.items()}
