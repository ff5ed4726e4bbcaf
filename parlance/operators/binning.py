"""Quantile bins fitted on training rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.impute import finite
from parlance.runtime import cut_lineage

#: Quantiles per number of bins and corpus, names per number of bins.
CUTS = {2: [0.5], (3, "meld"): [0.3, 0.7], (3, "iemocap"): [0.25, 0.75], 5: [0.2, 0.4, 0.6, 0.8]}
NAMES = {2: ["low", "high"], 3: ["low", "medium", "high"], 5: ["very low", "low", "medium", "high", "very high"]}


def cuts(n: int, corpus: str = "meld") -> list[float]:
    return CUTS[(n, corpus.lower())] if n == 3 else CUTS[n]


def quantiles(df: DataFrame, value: str, q: list[float]) -> DataFrame:
    """One row with the exact, linearly interpolated quantiles of the finite values; null if there are none."""
    got = _quantiles(df.select(F.lit("ALL").alias("g"), finite(F.col(value)).alias("v")), q)
    return df.sparkSession.createDataFrame([(got.get("ALL"),)], "q array<double>")


def quantiles_by(df: DataFrame, value: str, group: str, q: list[float], groups: list[str]) -> DataFrame:
    """Quantiles per listed group and, under ALL, of all rows; groups without values take those of ALL."""
    v = df.select(F.col(group).alias("g"), finite(F.col(value)).alias("v"))
    got = _quantiles(v.filter(F.col("g").isin(groups)).unionByName(v.withColumn("g", F.lit("ALL"))), q)
    return df.sparkSession.createDataFrame([(g, got.get(g) or got.get("ALL")) for g in [*groups, "ALL"]], "grp string, q array<double>")


def _quantiles(df: DataFrame, q: list[float]) -> dict[str, list[float]]:
    """Quantiles of ``v`` per ``g`` by order statistics: two rows a quantile and group come to the driver.

    Rows are sorted by ranges of (group, value); a row's rank is its place in its range plus the rows of the group in
    earlier ones. Ties are parted by a row number, so neither a hot group nor a hot value is one task's.
    """
    s = df.filter("v is not null").withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("g", "v", "tie")
    s = cut_lineage(s.sortWithinPartitions("g", "v").select("g", "v", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")))
    per = s.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("g").orderBy("p")
    per = per.select("g", "p", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("all"))
    rank = F.row_number().over(Window.partitionBy("g", "p").orderBy("m")) - 1 + F.col("before")
    at = F.array(*[f(F.lit(x) * (F.col("all") - 1)) for x in q for f in (F.floor, F.ceil)])
    rows = s.join(per, ["g", "p"]).withColumn("rank", rank).filter(F.array_contains(at, F.col("rank"))).select("g", "v", "rank", "all").collect()
    found: dict[str, dict[int, float]] = {}
    sizes = {r["g"]: r["all"] for r in rows}
    for r in rows:
        found.setdefault(r["g"], {})[r["rank"]] = r["v"]
    out = {}
    for g, by in found.items():
        spots = [x * (sizes[g] - 1) for x in q]
        out[g] = [by[math.floor(x)] + (by[math.ceil(x)] - by[math.floor(x)]) * (x - math.floor(x)) for x in spots]
    return out


def digitize(value: Column, q: Column, names: list[str]) -> Column:
    """Right-open bins; non-finite values and missing thresholds give null."""
    x = finite(value)
    at = F.size(F.filter(q, lambda t: t <= x)) + 1
    return F.when(x.isNotNull() & q.isNotNull(), F.element_at(F.array(*[F.lit(n) for n in names]), F.least(at, F.lit(len(names)))))
