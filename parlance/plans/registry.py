"""All core queries by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.plans import filling, prompting, records, relational, scalars, storage, streams, windows
from parlance.plans.base import QUERIES, SQL

_LOADED = (prompting, relational, scalars, storage, streams, windows)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return records.prompt_records(spark, sf)


def queries() -> dict:
    return QUERIES | filling.queries()


def oracle_sql() -> dict[str, str]:
    return SQL | filling.oracle_sql()
