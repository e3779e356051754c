"""All queries of the subpackage and their SQL, by name."""

from __future__ import annotations

from lodestone.llm import conversations, exact_dedup, exact_topk, language_id, license_scan, mixing, near_dedup, packing, repeats, sitestyle, toxicity, warc, whitening

MODULES = (exact_dedup, mixing, near_dedup, exact_topk, language_id, warc, repeats, license_scan, toxicity, packing, conversations, whitening, sitestyle)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
