"""Problem 6: rebuilding conversations from message rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.runtime import cut_lineage, outer_trim, plain

#: Messages of a conversation that one task sorts with Kahn's algorithm; longer ones are sorted by pointer doubling.
MAX_IN_TASK = 20_000


def says_something(text: Column) -> Column:
    """Whether a turn has a letter or digit outside brackets."""
    bare = text
    for _ in range(3):  # nested brackets, from the inside
        bare = F.regexp_replace(bare, r"\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\}|<[^<>]*>", " ")
    return F.coalesce(bare.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def levels(convs: np.ndarray, keys: np.ndarray, parents: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Kahn's algorithm over all conversations at once: every round releases all messages whose parents have left.

    Gives the level of every message (0 for roots), -1 for leftovers: messages on or behind a cycle or a parent that is
    absent. A key may occur several times in a conversation (rival messages); children wait for all of them.
    """
    codes, kinds = pd.factorize(np.concatenate([keys, parents]))
    own, up = convs * len(kinds) + codes[: len(keys)], convs * len(kinds) + codes[len(keys) :]
    group, known = pd.factorize(own)
    parent = np.where(root, -1, pd.Index(known).get_indexer(up))
    rivals = np.bincount(group, minlength=len(known))
    waiting = np.where(root, 0, np.where(parent >= 0, rivals[parent], 1))
    order = np.argsort(parent, kind="stable")
    begin, end = np.searchsorted(parent[order], np.arange(len(known))), np.searchsorted(parent[order], np.arange(len(known)), "right")
    level, ready, now = np.full(len(keys), -1), np.flatnonzero(waiting == 0), 0
    while len(ready):
        level[ready] = now
        left, times = np.unique(group[ready], return_counts=True)
        many = end[left] - begin[left]
        if not many.sum():
            break
        at = np.repeat(begin[left] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        children = order[at]
        waiting[children] -= np.repeat(times, many)
        ready, now = children[waiting[children] == 0], now + 1
    return level


def kahn(keys: list[int], parents: list[int | None], order: Sequence = ()) -> list[int]:
    """``levels`` of one conversation; ``order`` breaks ties within a level, so it does not change them."""
    root = np.array([p is None for p in parents], bool)
    return levels(np.zeros(len(keys), "int64"), np.array(keys, "int64"), np.array([p or 0 for p in parents], "int64"), root).tolist()


def _levels_in_tasks(nodes: DataFrame) -> DataFrame:
    """Kahn's algorithm over partitions that are clustered by conversation, all whole conversations of a batch at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def done(g: pd.DataFrame) -> pd.DataFrame:
            root = g["__parent"].isna().to_numpy()
            lev = levels(pd.factorize(g["__conv"])[0], g["__node"].to_numpy("int64"), g["__parent"].fillna(0).to_numpy("int64"), root)
            return g[["__conv", "__id"]].assign(__level=lev)

        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(b):
                continue
            open_ = b["__conv"] == b["__conv"].iloc[-1]
            held, whole = b[open_], b[~open_]
            if len(whole):
                yield done(whole)
        if held is not None and len(held):
            yield done(held)

    small = nodes.select("__conv", "__node", "__parent", "__id")
    return small.repartition("__conv").sortWithinPartitions("__conv").mapInPandas(run, "__conv string, __id long, __level long")


def _levels_by_doubling(nodes: DataFrame) -> DataFrame:
    """The same levels for conversations of any length: every node's pointer doubles its reach until all have ended."""
    keys = nodes.groupBy("__conv", "__node").agg(F.max("__parent").alias("__parent"))
    cur = cut_lineage(keys.select("__conv", "__node", F.col("__parent").alias("__to"), F.when(F.col("__parent").isNull(), 0).otherwise(1).cast("long").alias("__hops")))
    n = cur.groupBy("__conv").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < 2 * n:
        nxt = cur.select(F.col("__conv").alias("__c2"), F.col("__node").alias("__n2"), F.col("__to").alias("__to2"), F.col("__hops").alias("__h2"))
        j = cur.join(nxt, (F.col("__conv") == F.col("__c2")) & (F.col("__to") == F.col("__n2")), "left")
        cur = cut_lineage(
            j.select(
                "__conv", "__node",
                # an absent parent stays where it points to: the node never gets to an end
                F.when(F.col("__n2").isNotNull(), F.col("__to2")).otherwise(F.col("__to")).alias("__to"),
                (F.col("__hops") + F.coalesce("__h2", F.lit(0))).alias("__hops"),
            )
        )
        if not cur.filter(F.col("__to").isNotNull()).limit(1).count():
            break
        reach *= 2
    lev = cur.select("__conv", "__node", F.when(F.col("__to").isNull(), F.col("__hops")).otherwise(F.lit(-1)).alias("__level"))
    return nodes.join(lev, ["__conv", "__node"]).select("__conv", "__id", F.col("__level").cast("long"))


@dataclass
class Conversations:
    messages: DataFrame
    status: DataFrame


def rebuild(df: DataFrame, conv: str, turn: str, speaker: str, text: str, row_id: str, ts: str, max_in_task: int = MAX_IN_TASK, reply: str | None = None) -> Conversations:
    """Put message rows together to ordered conversations.

    ``reply`` names the column with the turn number that a message replies to (null: it opens the conversation); without
    it a message replies to the next lower turn number, and turn 0 opens. Redelivered rows (same turn, speaker and text,
    spelling aside) are one message, that of the earliest row. The reply graphs are sorted by Kahn's algorithm, ties
    within a level by time and row id; leftover messages reveal gaps and cycles. A conversation of more than
    ``max_in_task`` messages is no task's: its levels, which are the same, come from pointers that double their reach.

    ``status``: one row per conversation with ``defect``, the first that applies: ``empty`` (no message has a letter or
    digit outside brackets), ``broken`` (a row without turn number, leftover messages, one turn number with two
    messages, a message that says something without speaker), ``no_reply`` (fewer than two speakers, spelling aside, say
    anything), else null; and ``alternates``: no message replies to one of its own speaker.
    ``messages``: conversation, position (dense from 0; null for leftovers), turn, speaker (outer blanks removed), text, row id, of all
    conversations; join to ``status`` to leave out defective ones. Rows with a null conversation are left out. Negative
    turn numbers are leftovers. Null texts say nothing. An empty table gives empty results.
    """
    src = df.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("string").alias("__conv"), F.col(turn).cast("long").alias("__turn"), F.nullif(outer_trim(F.col(speaker)), F.lit("")).alias("__who"),
        F.col(text).alias("__text"), F.col(row_id).cast("long").alias("__id"), F.col(ts).cast("timestamp").alias("__at"),
        (F.when(F.col(turn).cast("long") != 0, F.col(turn).cast("long") - 1) if reply is None else F.col(reply).cast("long")).alias("__parent"),
    )
    src = src.withColumn("__says", says_something(F.col("__text"))).withColumn("__w", F.lower("__who")).withColumn("__x", plain(F.col("__text")))
    first = F.min_by(F.struct("__who", "__text", "__id", "__at", "__parent"), F.struct("__at", "__id"))
    msg = src.groupBy("__conv", "__turn", "__w", "__x").agg(first.alias("m"), F.max("__says").alias("__says"))
    msg = cut_lineage(msg.select("__conv", "__turn", "__w", "__says", "m.*"))
    nodes = msg.filter(F.col("__turn").isNotNull()).select(
        "__conv", F.col("__turn").alias("__node"), "__parent", "__id",
    )
    sizes = nodes.groupBy("__conv").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > max_in_task).select("__conv")
    levels = _levels_in_tasks(nodes.join(sizes, "__conv", "left_anti"))
    if sizes.limit(1).count():
        levels = levels.unionByName(_levels_by_doubling(nodes.join(sizes, "__conv", "left_semi")))
    lev = levels.select("__conv", F.col("__id").alias("__lid"), "__level")
    m = msg.alias("a").join(lev.alias("b"), (F.col("a.__conv") == F.col("b.__conv")) & (F.col("__id") == F.col("__lid")), "left").select("a.*", F.coalesce("__level", F.lit(-1)).alias("__level"))
    m = cut_lineage(m)
    # per turn first, so that a conversation that holds most rows is counted in many tasks
    turns = m.groupBy("__conv", "__turn").agg(F.count(F.lit(1)).alias("n"), F.min("__level").alias("low"), F.max("__says").alias("says"), F.max(F.col("__says") & F.col("__who").isNull()).alias("mute"), F.min("__w").alias("w"), F.max("__w").alias("w2"), F.max("__parent").alias("up"))
    per = turns.groupBy("__conv").agg(
        F.max("says").alias("says"), F.max(F.col("__turn").isNull() | (F.col("n") > 1) | (F.col("low") < 0) | F.col("mute")).alias("broken"),
    )
    voices = m.filter("__says and __w is not null").groupBy("__conv").agg((F.min("__w") != F.max("__w")).alias("two"))
    before = turns.select(F.col("__conv").alias("__pc"), F.col("__turn").alias("__pt"), F.col("w2").alias("pw"))
    same = turns.join(before, (F.col("__conv") == F.col("__pc")) & (F.col("up") == F.col("__pt"))).groupBy("__conv").agg(F.max(F.col("w") == F.col("pw")).alias("same"))
    status = per.join(voices, "__conv", "left").join(same, "__conv", "left")
    defect = F.when(~F.col("says"), "empty").when(F.col("broken"), "broken").when(~F.coalesce("two", F.lit(False)), "no_reply")
    status = status.select(F.col("__conv").alias(conv), defect.alias("defect"), (~F.coalesce("same", F.lit(False))).alias("alternates"))
    # position = messages of lower levels + rank within the level; only rivals of one turn share a level, leftovers have none
    left, m = m.filter("__level < 0"), m.filter("__level >= 0")
    rank = F.row_number().over(Window.partitionBy("__conv", "__level").orderBy("__at", "__id")) - 1
    width = m.groupBy(F.col("__conv").alias("__lc"), F.col("__level").alias("__ll")).agg(F.count(F.lit(1)).alias("__n"))
    wide = width.filter("__n > 1").groupBy(F.col("__lc").alias("__wc")).agg(F.lit(True).alias("__wide"))
    extra = width.join(wide, F.col("__lc") == F.col("__wc"), "left_semi").withColumn("__blk", F.floor(F.col("__ll") / 1000))
    blk = extra.groupBy("__lc", "__blk").agg(F.sum("__n").alias("__bn"))
    blk = blk.select(F.col("__lc").alias("__bc"), F.col("__blk").alias("__bb"), F.coalesce(F.sum("__bn").over(Window.partitionBy("__lc").orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b0"))
    inner = F.coalesce(F.sum("__n").over(Window.partitionBy("__lc", "__blk").orderBy("__ll").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = extra.withColumn("__in", inner).join(blk, (F.col("__lc") == F.col("__bc")) & (F.col("__blk") == F.col("__bb"))).select("__lc", "__ll", (F.col("__b0") + F.col("__in")).alias("__start"))
    placed = m.withColumn("__rank", rank).join(start, (F.col("__conv") == F.col("__lc")) & (F.col("__level") == F.col("__ll")), "left")
    # conversations whose levels hold one message each: the level is the position
    out = placed.select(
        F.col("__conv").alias(conv), (F.coalesce("__start", F.col("__level")) + F.col("__rank")).cast("long").alias("position"), F.col("__turn").alias(turn),
        F.col("__who").alias(speaker), F.col("__text").alias(text), F.col("__id").alias(row_id),
    )
    lost = left.select(F.col("__conv").alias(conv), F.lit(None).cast("long").alias("position"), F.col("__turn").alias(turn), F.col("__who").alias(speaker), F.col("__text").alias(text), F.col("__id").alias(row_id))
    return Conversations(out.unionByName(lost), status)
