"""Queries over the driver tables and their DuckDB SQL, gathered from the plans."""

from __future__ import annotations

from veridian.plans import box_queries, curation_queries, evaluation_queries, file_queries, mining_queries, table_queries, text_queries, vector_queries

PLANS = (text_queries, box_queries, vector_queries, table_queries, evaluation_queries, curation_queries, file_queries, mining_queries)
QUERIES = {name: query for plan in PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}
