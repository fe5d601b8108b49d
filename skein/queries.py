"""All queries of the library by name, with the SQL that checks each."""

from __future__ import annotations

from skein.plans import corpus, pipelines, warehouse

QUERIES: dict = {**corpus.QUERIES, **warehouse.QUERIES, **pipelines.QUERIES}
ORACLE_SQL: dict[str, str] = {**corpus.ORACLE_SQL, **warehouse.ORACLE_SQL, **pipelines.ORACLE_SQL}
