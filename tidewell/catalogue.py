"""Every registered query of the library's own operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.plans import answered, curated, indexed, judged, kept, reports, retrieved, seen, shapes, worded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for family in (reports, curated, retrieved, judged, seen, answered, kept, worded, shapes, indexed):
    QUERIES |= family.QUERIES
    ORACLE_SQL |= family.ORACLE_SQL
