"""All registered queries of the library and their SQL."""

from __future__ import annotations

from evidenta.plans import association_queries, claim_queries, exact_queries, insight_queries, prepare_queries, report_queries

MODULES = (exact_queries, prepare_queries, association_queries, claim_queries, insight_queries, report_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
