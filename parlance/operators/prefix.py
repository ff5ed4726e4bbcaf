"""Taking the smallest keys of each group up to a budget, and ranks within groups, without a group in one task.

A group may hold a third of all rows. Rows are put into ``2**BITS`` ranges of a hash key; the sums per (group, range)
are small, tell where each group's budget falls, and only the rows of that one range have to be ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 12


def hash_key(seed: int, *cols: Column) -> Column:
    """A non-negative 63-bit key, the same for the same row on every run."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def _bucket(key: str) -> Column:
    return F.shiftright(F.col(key), 63 - BITS).cast("int")


def take_smallest(df: DataFrame, group: str, key: str, tie: str, size: str, budget: DataFrame, overshoot: bool = False) -> DataFrame:
    """Rows of ``df`` in key order per group while their sizes fit into ``budget(group, __budget)``.

    ``overshoot`` also takes the row that crosses the budget. Groups without a budget give no rows. Exact.
    """
    src = df.withColumn("__bkt", _bucket(key))
    sums = src.groupBy(F.col(group).alias("__g"), "__bkt").agg(F.sum(size).alias("__sum"))
    run = Window.partitionBy("__g").orderBy("__bkt").rowsBetween(Window.unboundedPreceding, 0)
    marks = (
        sums.withColumn("__cum", F.sum("__sum").over(run))
        .join(budget.select(F.col(group).alias("__bg"), "__budget"), F.col("__g") == F.col("__bg"))
        .withColumn("__before", F.col("__cum") - F.col("__sum"))
        .filter(F.col("__before") < F.col("__budget"))
        .select("__g", F.col("__bkt").alias("__b"), "__before", "__budget", (F.col("__cum") <= F.col("__budget")).alias("__whole"))
    )
    hit = src.join(marks, (F.col(group) == F.col("__g")) & (F.col("__bkt") == F.col("__b")))
    extra = ["__bkt", "__g", "__b", "__before", "__budget", "__whole"]
    whole = hit.filter("__whole").drop(*extra)
    order = Window.partitionBy(group).orderBy(key, tie).rowsBetween(Window.unboundedPreceding, 0)
    edge = hit.filter(~F.col("__whole")).withColumn("__run", F.col("__before") + F.sum(size).over(order))
    fits = (F.col("__run") - F.col(size)) < F.col("__budget") if overshoot else F.col("__run") <= F.col("__budget")
    return whole.unionByName(edge.filter(fits).drop("__run", *extra))


def rank_in_group(df: DataFrame, group: str, key: str, tie: str, out: str, buckets: int = 64) -> DataFrame:
    """0-based dense position of every row within its group; a hot group is spread over ``buckets`` tasks."""
    src = df.withColumn("__bkt", F.pmod(F.col(key), F.lit(buckets)).cast("int"))
    n = src.groupBy(F.col(group).alias("__g"), F.col("__bkt").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    start = n.select("__g", "__b", F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__start"))
    pos = F.row_number().over(Window.partitionBy(group, "__bkt").orderBy(key, tie)) - 1
    return (
        src.withColumn("__pos", pos)
        .join(start, (F.col(group) == F.col("__g")) & (F.col("__bkt") == F.col("__b")))
        .withColumn(out, F.col("__start") + F.col("__pos"))
        .drop("__bkt", "__pos", "__g", "__b", "__start")
    )
