"""All queries over the test tables and their DuckDB twins, by name."""

from __future__ import annotations

from lodestone.plans import answer_queries, candidate_queries, pipeline_queries, pool_queries, ranking_queries, report_queries, source_queries, text_queries

MODULES = (text_queries, ranking_queries, source_queries, pipeline_queries, candidate_queries, pool_queries, report_queries, answer_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
