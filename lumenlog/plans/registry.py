"""Registered queries of the audit engine and the oracle SQL of each."""

from __future__ import annotations

from lumenlog.plans import audit, loading, models, oracle, reports

QUERIES = audit.QUERIES | loading.QUERIES | models.QUERIES | reports.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | loading.ORACLE_SQL | models.ORACLE_SQL | reports.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
