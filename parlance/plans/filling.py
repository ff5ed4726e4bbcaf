"""Queries of the imputation operator (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.operators import impute
from parlance.runtime import read_table

LEVEL_FIELDS = ["intensity_level", "pitch_level", "rate_level"]
NUMBER_FIELDS = ["intensity_mean_db", "pitch_mean_hz", "articulation_rate_syll_per_s"]


def _fill(spark: SparkSession, sf: str) -> impute.Filling:
    u = read_table(spark, sf, "utterance").select("row_id", "dialog_id", "speaker", *LEVEL_FIELDS, *NUMBER_FIELDS)
    return impute.fill(u, "row_id", LEVEL_FIELDS, NUMBER_FIELDS, ["dialog_id", "speaker"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _fill(spark, sf).cells.select("row_id", "level_field")


def p4_filled(spark: SparkSession, sf: str) -> DataFrame:
    return _fill(spark, sf).rows


def queries() -> dict:
    return {"p4_found": p4_found, "p4_filled": p4_filled}


def oracle_sql() -> dict[str, str]:
    one = "SELECT row_id, '{f}' AS level_field FROM utterance WHERE coalesce(regexp_replace(trim(lower({f}), E' \\t\\n\\r'), '[ _]+', ' ', 'g'), '') NOT IN ('very low', 'low', 'medium', 'high', 'very high')"
    return {"p4_found": " UNION ALL ".join(one.format(f=f) for f in LEVEL_FIELDS)}
