"""All queries of the core and the SQL of those that SQL can express."""

from __future__ import annotations

from lauda.plans import closed_queries, loop_queries, policy_queries, quality_queries, system_queries, text_queries

_MODULES = (quality_queries, text_queries, policy_queries, loop_queries, system_queries, closed_queries)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in _MODULES for k, q in m.ORACLE.items()}
