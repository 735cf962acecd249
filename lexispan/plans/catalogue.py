"""All queries of the library, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexispan.plans import models, statistics, text

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (statistics, text, models)


def queries() -> dict[str, Query]:
    return {q.__name__: q for m in MODULES for q in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
