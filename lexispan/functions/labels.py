"""Column helpers for labels that are written unevenly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_label(column: Column) -> Column:
    """A label without case and outer white space; an empty one is null."""
    trimmed = F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    return F.when(trimmed != "", trimmed)
