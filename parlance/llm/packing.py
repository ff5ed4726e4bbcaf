"""Problem 8: filling containers of fixed capacity with whole items."""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.prefix import hash_key, rank_in_group
from parlance.runtime import bounded_rows


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over a length histogram.

    Gives (length, first rank, items, first container, per container, offset): items of one length with ranks
    [first rank, first rank + items) go into consecutive containers, ``per container`` side by side from ``offset``.
    Containers are handled as runs with the same free space, so the work depends on the number of lengths, not items.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    free: list[int] = []  # sorted free spaces
    runs: dict[int, list[tuple[int, int]]] = {}  # free space -> [(first container, containers)]
    used = 0

    def add(space: int, start: int, n: int) -> None:
        if space <= 0 or not n:
            return
        if space not in runs:
            runs[space] = []
            insort(free, space)
        runs[space].append((start, n))

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        if length <= 0:
            continue
        while rank < count:
            at = bisect_left(free, length)
            if at < len(free):
                space = free[at]
                start, n = runs[space].pop()
                if not runs[space]:
                    del runs[space]
                    free.pop(at)
            else:
                space, start, n = capacity, used, -(-(count - rank) // (capacity // length))
                used += n
            per = space // length
            left = count - rank
            whole = min(n, left // per)
            if whole:
                slots.append((length, rank, whole * per, start, per, capacity - space))
                rank += whole * per
                add(space - per * length, start, whole)
            some = count - rank if whole < n else 0
            if some and some < per:
                slots.append((length, rank, some, start + whole, some, capacity - space))
                rank += some
                add(space - some * length, start + whole, 1)
                whole += 1
            add(space, start + whole, n - whole)
    return slots


@dataclass
class Packing:
    pieces: DataFrame
    over_capacity: DataFrame


def pack(df: DataFrame, id_col: str, size_col: str, capacity: int, seed: int = 8) -> Packing:
    """Put every item into a container of ``capacity``; only items longer than it are cut.

    A longer item becomes whole containers and one rest, which is packed like any item. Pieces: id, piece (from 0),
    start and length within the item, container and offset in it. Items of size 0 or null need no room: container is
    null. Negative sizes count as 0. Repeated ids are separate items; null ids are allowed. An empty table gives no
    pieces. The histogram has at most ``capacity`` lengths, whatever the number of items, and is planned on the driver.
    Containers with a rest come first, then those filled by one cut piece. ``over_capacity``: ids and sizes of the items that were
    cut. Extra columns of ``df`` are not carried.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    spark = df.sparkSession
    items = df.select(F.col(id_col).alias("__id"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("__n"))
    items = items.withColumn("__full", F.floor(F.col("__n") / capacity)).withColumn("__len", F.col("__n") % capacity)
    hist = bounded_rows(items.groupBy("__len").agg(F.count(F.lit(1)).alias("c"), F.sum("__full").alias("f")), capacity, "the length histogram")
    slots = plan({r["__len"]: r["c"] for r in hist if r["__len"] > 0}, capacity)
    # a hot length, or the whole containers, are numbered by as many tasks as there are millions of items
    buckets = 64 + sum(r["c"] + (r["f"] or 0) for r in hist) // 1_000_000
    opened = max([s[3] + -(-s[2] // s[4]) for s in slots], default=0)
    table = spark.createDataFrame(slots, "__sl long, __rank long, __items long, __first long, __per long, __off long")
    ranked = rank_in_group(items.filter("__len > 0").withColumn("__key", hash_key(seed, F.col("__id"))), "__len", "__key", "__id", "__r", buckets)
    # the size of the plan is known, so the way of joining is left to the planner
    placed = ranked.join(table, (F.col("__len") == F.col("__sl")) & (F.col("__r") >= F.col("__rank")) & (F.col("__r") < F.col("__rank") + F.col("__items")))
    step = F.col("__r") - F.col("__rank")
    rest = placed.select(
        F.col("__id"), F.col("__full").cast("long").alias("piece"), (F.col("__full") * capacity).cast("long").alias("start"), F.col("__len").alias("length"),
        (F.col("__first") + F.floor(step / F.col("__per"))).cast("long").alias("container"), (F.col("__off") + (step % F.col("__per")) * F.col("__len")).cast("long").alias("offset"), F.col("__n").alias("__size"),
    )
    # whole containers: numbered after the planned ones by a running sum of the cuts over hash buckets
    cut = items.filter("__full > 0").withColumn("__all", F.lit(1)).withColumn("__key", hash_key(seed, F.col("__id")))
    pieces = cut.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__full").cast("long") - 1)))
    numbered = rank_in_group(pieces.withColumn("__key", hash_key(seed, F.col("__id"), F.col("piece"))), "__all", "__key", "__id", "__r", buckets)
    full = numbered.select("__id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), (F.lit(opened) + F.col("__r")).cast("long").alias("container"), F.lit(0).cast("long").alias("offset"), F.col("__n").alias("__size"))
    nil = F.lit(None).cast("long")
    zero = items.filter("__n = 0").select("__id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), nil.alias("container"), nil.alias("offset"), F.col("__n").alias("__size"))
    out = rest.unionByName(full).unionByName(zero).withColumnRenamed("__id", id_col)
    # an item longer than a container is one that had to be cut: it has a second piece
    return Packing(out.drop("__size"), out.filter("piece = 1").select(id_col, F.col("__size").alias("n_tokens")))
