"""What __spark_entry__.py adds from this subpackage: its queries and, where SQL expresses them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from .queries import ORACLE_SQL, QUERIES


def queries() -> dict:
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
