"""Problem 9: mixing sources to target weights with a cap on repetition."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.prefix import hash_key, take_smallest
from parlance.runtime import bounded_rows, plain

MAX_SOURCES = 10_000


def temperature(shares: list[float], alpha: float) -> list[float]:
    """Shares to the power ``alpha``, normalised; zero shares stay zero."""
    x = [s**alpha if s > 0 else 0.0 for s in shares]
    t = sum(x)
    return [v / t for v in x] if t else x


def entropy(p: list[float]) -> float:
    return -sum(v * math.log(v) for v in p if v > 0)


def bisect_exponent(shares: list[float], accept, steps: int = 60) -> float:
    """The largest exponent in [0, 1] whose tempered shares are accepted; 0 if only equal shares are or none is."""
    if accept(temperature(shares, 1.0)):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if accept(temperature(shares, mid)) else (low, mid)
    return low


def exponent_for_entropy(shares: list[float], target: float) -> float:
    """The exponent at which the tempered shares have at least ``target`` nats of entropy."""
    return bisect_exponent(shares, lambda p: entropy(p) >= target)


def exponent_for_repeats(tokens: list[int], total: float, limits: list[float]) -> float:
    """The largest exponent at which no source is used more often than its limit."""
    t = sum(tokens) or 1
    return bisect_exponent([x / t for x in tokens], lambda p: all(w * total <= m * x + 1e-9 for w, x, m in zip(p, tokens, limits)))


def budgets(tokens: list[int], weights: list[float], limits: list[float], total: float) -> list[float]:
    """Token budgets: the target share of ``total`` each, at most ``limit`` uses of a source.

    What capped sources leave goes to those with room by their token shares raised to an exponent (temperature mixing):
    the largest in [0, 1] at which no source exceeds its limit and at which the spread is at least as even as the target
    weights of these sources are (their entropy). Sources that are full are closed and the rest is shared again.
    """
    cap = [m * x for m, x in zip(limits, tokens)]
    got = [min(w * total, c) for w, c in zip(weights, cap)]
    for _ in range(len(tokens) + 1):
        left = total - sum(got)
        room = [i for i in range(len(tokens)) if got[i] < cap[i] - 1e-9 and weights[i] > 0]
        if left <= 1e-6 * max(1.0, total) or not room:
            break
        own, want = [tokens[i] for i in room], temperature([weights[i] for i in room], 1.0)
        shares = temperature(own, 1.0)
        repeats = exponent_for_repeats(own, left, [(cap[i] - got[i]) / tokens[i] for i in room])
        alpha = min(repeats, exponent_for_entropy(shares, min(entropy(want), math.log(len(room)) - 1e-12)))
        for i, q in zip(room, temperature(shares, alpha)):
            got[i] = min(cap[i], got[i] + left * q)
    return got


@dataclass
class Mix:
    rows: DataFrame
    report: DataFrame


def mix(df: DataFrame, targets: DataFrame, id_col: str, source_col: str, size_col: str, seed: int = 9) -> Mix:
    """Choose documents so that each source has its target share of all tokens.

    ``targets``: source, target_weight (adds up to 1), max_uses; bounded by MAX_SOURCES rows. Sources are compared
    spelling aside. The total is the tokens of all rows that have a source (not null, not blank). A source whose share
    exceeds max_uses times its tokens cannot reach it: it is used in full and reported (``unreachable``: the tokens of the
    documents chosen stay below the target, and max_uses times its tokens does too). A document is used in as many
    whole passes as fit, then once more if it stands in the permutation (hash order) before the rest of the budget ends;
    the last document of a pass may cross the budget unless that would exceed the cap. Rows with a null source or one
    without target are not used but count in the total. Null or zero sizes take no room. Rows: id, source, size,
    ``use_no`` from 1 and ``block_key``, the order within a pass. Repeated rows are rows. Empty tables give no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("__tie"), F.col(source_col).alias("__given"), plain(F.col(source_col)).alias("__src"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("__size"))
    rows = rows.filter(F.col("__src").isNotNull() & (F.col("__src") != ""))
    sums = rows.groupBy("__src").agg(F.sum("__size").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    want = targets.select(F.col(source_col).alias("__name"), plain(F.col(source_col)).alias("__k"), F.col("target_weight").cast("double").alias("w"), F.col("max_uses").cast("long").alias("m"))
    plan = bounded_rows(want.join(sums, F.col("__k") == F.col("__src"), "left").select("__name", "__k", "w", "m", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs")), MAX_SOURCES, "the target table")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    plan = sorted(plan, key=lambda p: p["__k"] or "")
    tokens, weights, limits = [p["tokens"] for p in plan], [p["w"] or 0.0 for p in plan], [p["m"] or 0 for p in plan]
    got = budgets(tokens, weights, limits, total)
    uses, report = [], []
    for p, b in zip(plan, got):
        t, m = p["tokens"], p["m"] or 0
        full = min(m, int(b // t)) if t else 0
        rest = b - full * t if t and full < m else 0.0
        # within half a document of a whole pass nothing is left to draw
        uses.append((p["__k"], full, float(rest)))
        report.append((p["__name"], p["w"], m, t, p["docs"], float(b), (p["w"] or 0.0) * total))
    spark_uses = spark.createDataFrame(uses, "__k string, __full int, __rest double")
    keyed = rows.withColumn("__key", hash_key(seed, F.col("__tie")))
    whole = (
        keyed.join(spark_uses, F.col("__src") == F.col("__k"))
        .filter("__full > 0")
        .withColumn("use_no", F.explode(F.sequence(F.lit(1), F.col("__full"))))
        .drop("__k", "__full", "__rest")
    )
    budget = spark_uses.filter("__rest >= 1").select(F.col("__k").alias("__src"), F.floor("__rest").alias("__budget"))
    part = take_smallest(keyed, "__src", "__key", "__tie", "__size", budget, overshoot=True)
    part = part.join(spark_uses, F.col("__src") == F.col("__k")).withColumn("use_no", F.col("__full") + 1).drop("__k", "__full", "__rest")
    out = whole.unionByName(part).withColumn("block_key", hash_key(seed + 1, F.col("use_no"), F.col("__key")))
    used = out.groupBy(F.col("__src").alias("__u")).agg(F.sum("__size").alias("used_tokens"), F.max("use_no").alias("most_uses"))
    schema = f"`{source_col}` string, target_weight double, max_uses long, source_tokens long, source_docs long, budget_tokens double, __want double"
    base = spark.createDataFrame(report, schema)
    full_report = (
        base.join(used, plain(F.col(source_col)) == F.col("__u"), "left")
        .withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
        .withColumn("most_uses", F.coalesce("most_uses", F.lit(0)))
        # the mix falls short of the target share, and the limit on uses is why
        .withColumn("unreachable", (F.col("used_tokens") < F.col("__want")) & (F.col("__want") > F.coalesce("max_uses", F.lit(0)) * F.col("source_tokens")))
        .withColumn("__all", F.sum("used_tokens").over(Window.partitionBy()))  # at most MAX_SOURCES rows
        .withColumn("actual_share", F.coalesce(F.try_divide(F.col("used_tokens").cast("double"), F.col("__all")), F.lit(0.0)))
        .drop("__u", "__all", "__want")
    )
    return Mix(out.select(F.col("__tie").alias(id_col), F.col("__given").alias(source_col), F.col("__size").alias(size_col), "use_no", "block_key"), full_report)
