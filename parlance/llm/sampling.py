"""Problem 7: a sample whose category shares follow given targets."""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.prefix import hash_key, take_smallest
from parlance.runtime import bounded_rows, plain

MAX_TARGETS = 100_000


def allocate(total: int, shares: list[float], floors: list[int], available: list[int]) -> list[int]:
    """Integer quotas by largest remainder, at least the floor and at most what is available.

    Floors beyond the availability are cut to it; what a capped category leaves is given to the others in proportion.
    Ties go to the earlier category. The sum is ``total`` unless floors exceed it or the availability is less.
    """
    n = len(shares)
    low = [min(f, a) for f, a in zip(floors, available)]
    fixed: dict[int, int] = {}
    while True:
        free = [i for i in range(n) if i not in fixed]
        left = total - sum(fixed.values())
        mass = sum(shares[i] for i in free)
        ideal = {i: max(0.0, left) * shares[i] / mass if mass > 0 else 0.0 for i in free}
        under = [i for i in free if ideal[i] < low[i]]
        over = [i for i in free if ideal[i] > available[i]]
        lack, excess = sum(low[i] - ideal[i] for i in under), sum(ideal[i] - available[i] for i in over)
        if not under and not over:
            break
        # the larger violation is fixed first: fixing it moves the other categories towards their bounds
        if excess >= lack and over:
            fixed |= {i: available[i] for i in over}
        else:
            fixed |= {i: low[i] for i in under}
    quota = [fixed.get(i, 0) for i in range(n)]
    for i in ideal:
        quota[i] = floor(ideal[i] + 1e-9)
    rest = min(total, sum(available)) - sum(quota)
    order = sorted(ideal, key=lambda i: (quota[i] - ideal[i], i))
    while rest > 0:
        given = [i for i in order if quota[i] < available[i]][:rest]
        if not given:
            break
        for i in given:
            quota[i] += 1
        rest -= len(given)
    return quota


@dataclass
class Sample:
    rows: DataFrame
    report: DataFrame


def draw(df: DataFrame, targets: DataFrame, id_col: str, split_col: str, label_col: str, seed: int = 7) -> Sample:
    """Draw a sample per split whose labels follow ``targets``.

    ``targets``: split, label, target_share, min_rows, sample_frac; bounded by MAX_TARGETS rows. Splits and labels are
    compared spelling aside. The sample size of a split is sample_frac times its rows with a listed label, rounded.
    Rows with a null or unlisted label or split are never drawn and do not count. Repeated rows count as rows; equal
    ids share a random key and are taken in any order. Null ids are allowed. Empty tables give an empty sample and a
    report with availability 0. The report has every target row: available, wanted (real number), quota, drawn (rows of
    the sample) and short: the sample drawn holds fewer rows than wanted, and there are no more to be had (a target
    missed because the floors of others took its room is not short). Extra columns of ``df`` are kept, whatever their names.
    """
    spark = df.sparkSession
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(id_col).alias("__tie"), plain(F.col(split_col)).alias("__split"), plain(F.col(label_col)).alias("__label"))
    want = targets.select(
        F.col(split_col).alias("__ts"), F.col(label_col).alias("__tl"), plain(F.col(split_col)).alias("__k1"), plain(F.col(label_col)).alias("__k2"),
        F.col("target_share").cast("double").alias("share"), F.col("min_rows").cast("long").alias("low"), F.col("sample_frac").cast("double").alias("frac"),
    )
    counts = rows.groupBy("__split", "__label").agg(F.count(F.lit(1)).alias("n"))
    plan = want.join(counts, (F.col("__k1") == F.col("__split")) & (F.col("__k2") == F.col("__label")), "left")
    plan = bounded_rows(plan.select("__ts", "__tl", "__k1", "__k2", "share", "low", "frac", F.coalesce("n", F.lit(0)).alias("n")), MAX_TARGETS, "the target table")
    report, quotas = [], []
    for split in sorted({p["__k1"] for p in plan if p["__k1"] is not None}):
        own = sorted((p for p in plan if p["__k1"] == split and p["__k2"] is not None), key=lambda p: p["__k2"])
        size = sum(p["n"] for p in own)
        frac = max((p["frac"] or 0.0 for p in own), default=0.0)
        got = allocate(round(frac * size), [p["share"] or 0.0 for p in own], [p["low"] or 0 for p in own], [p["n"] for p in own])
        for p, q in zip(own, got):
            wanted = (p["share"] or 0.0) * (p["frac"] or 0.0) * size
            grp = f"{split}\x1f{p['__k2']}"
            report.append((p["__ts"], p["__tl"], grp, p["n"], float(wanted), int(q)))
            quotas.append((grp, int(q)))
    budget = spark.createDataFrame(quotas, "__grp string, __budget long")
    keyed = (
        rows.filter(F.col("__split").isNotNull() & F.col("__label").isNotNull())
        .withColumn("__grp", F.concat("__split", F.lit("\x1f"), "__label"))
        .withColumn("__key", hash_key(seed, F.col("__tie")))
        .withColumn("__one", F.lit(1).cast("long"))
    )
    taken = take_smallest(keyed, "__grp", "__key", "__tie", "__one", budget)
    drawn = taken.groupBy(F.col("__grp").alias("__dg")).agg(F.count(F.lit(1)).alias("drawn"))
    schema = f"`{split_col}` string, `{label_col}` string, __grp string, available long, wanted double, quota long"
    full = spark.createDataFrame(report, schema).join(drawn, F.col("__grp") == F.col("__dg"), "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    full = full.withColumn("short", (F.col("drawn") < F.col("wanted")) & (F.col("available") < F.col("wanted"))).drop("__grp", "__dg")
    return Sample(taken.select("__row.*"), full)
