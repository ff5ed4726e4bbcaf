"""A registry of queries with their SQL twins, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import key
from parlance.runtime import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of all dialogues: one row per dialogue and turn number; rows without a turn number have no place.

    Redelivered rows give way to the smallest row id; speakers and labels are taken spelling aside; a null text is empty,
    a null label or a null or blank speaker unknown.
    """
    u = read_table(spark, sf, "utterance").withColumn("speaker", F.coalesce(F.nullif(F.lower(F.trim("speaker")), F.lit("")), F.lit("unknown")))
    u = u.filter(F.col("turn_idx").isNotNull())
    cols = ["row_id", "source", "split", "dialog_idx", "speaker", "gender", "emotion", "emotion_code", "erc_target", "utterance", "mapped_emotion", "turn_id", "session"]
    first = u.groupBy("dialog_id", "turn_idx").agg(F.min_by(F.struct(*cols), "row_id").alias("s")).select("dialog_id", "turn_idx", "s.*")
    return first.select(
        "row_id", "source", "split", "session", "dialog_id", "dialog_idx", "turn_id", "turn_idx", "speaker", "gender", "emotion", "emotion_code", "erc_target",
        F.coalesce("utterance", F.lit("")).alias("utterance"), F.coalesce(F.trim(F.lower("mapped_emotion")), F.lit("unknown")).alias("label"),
        key(F.when(F.col("source") == "meld", "m").otherwise("i"), F.col("dialog_idx"), F.col("turn_idx")).alias("idx"),
    )


#: The same table in SQL, to be put before a query.
T = """WITH t AS (SELECT row_id, source, split, session, dialog_id, dialog_idx, turn_id, turn_idx, coalesce(nullif(lower(trim(speaker)), ''), 'unknown') AS speaker, gender, emotion, emotion_code, erc_target,
 coalesce(utterance, '') AS utterance, coalesce(trim(lower(mapped_emotion)), 'unknown') AS label,
 CASE WHEN source = 'meld' THEN 'm' ELSE 'i' END || '_' || dialog_idx || '_' || turn_idx AS idx
 FROM utterance WHERE turn_idx IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY dialog_id, turn_idx ORDER BY row_id) = 1)
"""
