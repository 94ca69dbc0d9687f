"""All queries of the analytics engine and their SQL, over the tables of a folder."""

from __future__ import annotations

from fathomline.plans import details, mechanisms, metrics, surface, texts

QUERIES = texts.QUERIES | metrics.QUERIES | surface.QUERIES | details.QUERIES | mechanisms.QUERIES
ORACLE_SQL = texts.ORACLE_SQL | metrics.ORACLE_SQL | surface.ORACLE_SQL | details.ORACLE_SQL | mechanisms.ORACLE_SQL
