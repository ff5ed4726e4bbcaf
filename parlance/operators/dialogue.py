"""Operators over ordered dialogues: positions, aliases, and context windows.

Dialogues are partitions of a window. Ranks over all dialogues are taken on the list of distinct dialogues (one row per
dialogue) and joined back, so no window over all rows runs in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import strip_newlines


def position(df: DataFrame, keys: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """0-based position within a group."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def rank_distinct(keys: DataFrame, order: list[Column], out: str) -> DataFrame:
    """0-based dense rank over a table of distinct keys, without a window in one task.

    Keys are sorted by range; a key's rank is the number of keys in earlier partitions plus its place in its own.
    """
    from parlance.runtime import cut_lineage

    s = cut_lineage(keys.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    n = s.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__m0"))
    n = n.select(F.col("__p").alias("__q"), "__m0", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return s.join(n, F.col("__p") == F.col("__q")).withColumn(out, F.col("__before") + F.col("__m") - F.col("__m0")).drop("__p", "__m", "__q", "__m0", "__before")


def running(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Running sums over a whole table in a unique order, the row itself included, without a window in one task.

    Rows are sorted by range; a sum is that of earlier partitions plus the one within the row's own.
    """
    from parlance.runtime import cut_lineage

    s = cut_lineage(df.select("*", *[c.alias(f"__v_{k}") for k, c in values.items()]).orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    first = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sums = s.groupBy("__p").agg(*[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in values])
    before = sums.select(F.col("__p").alias("__q"), *[F.coalesce(F.sum(f"__s_{k}").over(first), F.lit(0)).alias(f"__b_{k}") for k in values])
    own = Window.partitionBy("__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, 0)
    j = s.join(before, F.col("__p") == F.col("__q"))
    return j.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.sum(f"__v_{k}").over(own) + F.col(f"__b_{k}")).alias(k) for k in values])


def factorize(df: DataFrame, keys: list[str], order: Column, out: str = "group_idx") -> DataFrame:
    """Number groups by first appearance, 0-based."""
    first = df.groupBy(*keys).agg(F.min(order).alias("__first"))
    ranked = rank_distinct(first, [F.col("__first")], out).drop("__first")
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return df.alias("l").join(ranked.alias("r"), cond).select("l.*", F.col(f"r.{out}").alias(out))


def ngroup(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Sorted number of a value within a group."""
    return df.withColumn(out, (F.dense_rank().over(Window.partitionBy(*keys).orderBy(value)) - 1).cast("long"))


def aliases(df: DataFrame, keys: list[str], speaker: str, turn: str, letters: bool = False, out: str = "alias") -> DataFrame:
    """Speaker_0 (or Speaker_A) by first appearance in the dialogue."""
    first = df.withColumn("__f", F.min(turn).over(Window.partitionBy(*keys, speaker)))
    no = F.dense_rank().over(Window.partitionBy(*keys).orderBy("__f", speaker)) - 1
    tag = F.char(no + 65) if letters else no.cast("string")
    return first.withColumn(out, F.concat(F.lit("Speaker_"), tag)).drop("__f")


def cast_of(df: DataFrame, keys: list[str], speaker: str, turn: str, letters: bool = False) -> DataFrame:
    """Per dialogue the array of struct<name, alias> in order of first appearance."""
    one = df.groupBy(*keys, speaker).agg(F.min(turn).alias("__f"))
    no = F.dense_rank().over(Window.partitionBy(*keys).orderBy("__f", speaker)) - 1
    tag = F.char(no + 65) if letters else no.cast("string")
    one = one.withColumn("__s", F.struct(no.alias("i"), F.col(speaker).alias("name"), F.concat(F.lit("Speaker_"), tag).alias("alias")))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("__s")), lambda s: F.struct(s["name"].alias("name"), s["alias"].alias("alias"))).alias("cast"))


def lines(keys: list[str], turn: str, line: Column, before: int) -> Column:
    """The lines of the turn and of ``before`` turns before it."""
    w = Window.partitionBy(*keys).orderBy(turn).rowsBetween(-before, 0)
    return F.array_join(F.collect_list(line).over(w), "\n")


def history(keys: list[str], turn: str, line: Column, k: int) -> Column:
    """k turns before and the turn itself, newlines stripped at both ends."""
    return strip_newlines(lines(keys, turn, line, k))


def label_flow(keys: list[str], turn: str, label_no: Column, m: int) -> Column:
    """Label numbers over m turns ending with this one."""
    return F.collect_list(label_no).over(Window.partitionBy(*keys).orderBy(turn).rowsBetween(-(m - 1), 0))


def flow_text(flow: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(flow, ", "), F.lit("]"))


def hybrid_tail(line: Column) -> Column:
    return F.concat(F.lit("\n\nThe target utterance is: "), line)
