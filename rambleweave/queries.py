"""All queries of the core operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import collections, notes, records
from .catalog.common import Query

QUERIES: dict[str, Query] = {**records.QUERIES, **notes.QUERIES, **collections.QUERIES}
SQL: dict[str, str] = {**records.SQL, **notes.SQL, **collections.SQL}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return notes.g15_roam(spark, sf)
