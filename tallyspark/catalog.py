"""Every query of the library by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .plans import queries_compare, queries_extract, queries_forecast, queries_identity, queries_ratings, queries_records, queries_simulation, queries_sources, queries_tuning

PARTS = (queries_records, queries_ratings, queries_forecast, queries_simulation, queries_tuning, queries_compare, queries_identity, queries_extract, queries_sources)
QUERIES: dict = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict = {k: v for part in PARTS for k, v in part.ORACLE_SQL.items()}
