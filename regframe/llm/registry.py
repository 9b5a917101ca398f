"""What ``__spark_entry__.py`` adds when this subpackage is there."""

from __future__ import annotations

import corpus_pipeline
from regframe.llm import queries as _q


def queries() -> dict:
    return _q.QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return _q.SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
