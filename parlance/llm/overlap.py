"""Problem 5: records of evaluation splits that occur, alike or almost, in the training split."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.runtime import cut_lineage, plain

#: One word in SIX may differ; containment counts n-grams of GRAM words; records are looked up by SEG words in a row.
SIX, GRAM, SEG, MIN_WORDS = 6, 2, 3, 8
#: Up to LONG words the places of a record are chosen together, beyond that one in every stretch.
LONG = 200
#: Evaluation records that share one key, beyond which the key is split.
HOT = 1_000
#: Counters of the table of key loads, a power of two; the same for tables of any size.
SLOTS = 1 << 20


def words(text: Column) -> Column:
    """Lower-case words of a text; punctuation and spacing do not count, apostrophes and hyphens only split or vanish."""
    joined = F.regexp_replace(F.lower(text), r"(?<=[\p{L}\p{N}])['’ʼ](?=[\p{L}\p{N}])", "")
    return F.filter(F.split(joined, r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


def word_distance(a: list[str], b: list[str]) -> int:
    """Levenshtein distance of word sequences by bit-parallel columns in one big integer (any length)."""
    if len(a) < len(b):
        a, b = b, a
    m = len(b)
    if not m:
        return len(a)
    pos: dict[str, int] = {}
    for i, w in enumerate(b):
        pos[w] = pos.get(w, 0) | (1 << i)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, dist = mask, 0, m
    for w in a:
        eq = pos.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        if ph & top:
            dist += 1
        elif mh & top:
            dist -= 1
        ph, mh = ((ph << 1) | 1) & mask, (mh << 1) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
    return dist


@dataclass
class Overlaps:
    texts: DataFrame
    links: DataFrame
    rows: DataFrame


def find(df: DataFrame, id_col: str, split_col: str, text_col: str, train: str = "train", evaluation: tuple[str, ...] = ("dev", "test"), min_words: int = MIN_WORDS) -> Overlaps:
    """All pairs of an evaluation and a training record whose word sequences differ in at most one word in six.

    Rows with fewer than ``min_words`` words, null texts, null or other splits take no part (splits: spelling aside). Equal
    word sequences are one text, known by two checksums (text_id, check); ``links`` has the pairs of different or equal
    texts with ``distance`` and ``containment`` (share of the evaluation record's n-grams in the training record), so
    copies are not multiplied. ``rows``: split, text and row id, for expanding.

    A training record of n words has k = n/5 differences to a partner at most, so of k + 1 places that do not overlap one
    is whole in the partner. A place has SEG words; of all ways to lay the places that with the fewest evaluation records
    behind them is taken, by a table of SLOTS counts (it only steers the choice; places nobody else has are no keys). An
    evaluation record is looked up by all its runs of SEG words. Each side's keys are partitioned and joined; no pair is
    lost. Candidates whose lengths or word signatures differ too much, then those with too few n-grams in common, are
    dropped; the rest is verified by exact word distance over whole texts. Nothing that grows is broadcast. Empty tables give empty results.
    """
    if min_words < 1:
        raise ValueError("a record needs a word")
    base = df.select(F.col(id_col).cast("long").alias("id"), plain(F.col(split_col)).alias("split"), F.col(text_col).alias("raw"))
    base = base.filter(F.col("split").isin(train, *evaluation) & (F.length("raw") >= 2 * min_words - 1)).select("id", "split", words(F.col("raw")).alias("w"))
    base = base.filter(F.size("w") >= min_words).select("id", "split", (F.col("split") == train).alias("is_train"), F.concat_ws(" ", "w").alias("t"))
    ids = [F.xxhash64("t").alias("text_id"), (F.crc32("t") - 2**31).cast("int").alias("check")]
    rows = base.select("id", "split", "is_train", *ids)
    # not written: whoever reads the texts shares this exchange
    side = F.when(F.col("is_train"), 1).otherwise(2)
    texts = base.select("t", side.alias("side"), *ids).groupBy("text_id", "check").agg(F.first("t").alias("t"), F.bit_or("side").alias("sides"))
    sizes = sorted({_place(n) for n in range(min_words, MIN_WORDS)} | {SEG})
    load = _loads(base.filter(~F.col("is_train")).select(_grams(F.split("t", " "), sizes).alias("gs")))
    keys = texts.withColumn("w", F.split("t", " ")).select("text_id", "check", "sides", F.size("w").alias("n"), _signature(F.col("w")).alias("sig"), *[_grams(F.col("w"), [q]).alias(f"g{q}") for q in sizes])
    own = F.col(f"g{SEG}")
    for q in sizes[:-1]:
        own = F.when(F.col("n").isin([n for n in range(min_words, MIN_WORDS) if _place(n) == q]), F.col(f"g{q}")).otherwise(own)
    none = F.array().cast("array<bigint>")
    keys = keys.withColumn("laid", _lay(F.when(F.expr("sides & 1 = 1"), own).otherwise(none), F.col("n"), load))
    every = F.when(F.expr("sides & 2 = 2"), F.concat(*[F.col(f"g{q}") for q in sizes])).otherwise(none)
    key = lambda e: lambda g: F.struct(F.lit(e).alias("e"), g.alias("g"))
    keys = keys.select("text_id", "check", F.col("n").cast("int").alias("n"), "sig", F.inline(F.concat(F.transform(F.array_distinct(every), key(True)), F.transform("laid", key(False)))))
    cand = _meet(keys)
    a = texts.filter("sides & 2 = 2").select(F.col("text_id").alias("e_id"), F.col("check").alias("e_check"), F.col("t").alias("ew"))
    b = texts.filter("sides & 1 = 1").select(F.col("text_id").alias("t_id"), F.col("check").alias("t_check"), F.col("t").alias("tw"))
    pair = cand.join(a.hint("merge"), ["e_id", "e_check"]).join(b.hint("merge"), ["t_id", "t_check"])
    # written before the filter, which would evaluate the comparison a second time
    found = pair.select("e_id", "e_check", "t_id", "t_check", _compare(F.split("ew", " "), F.split("tw", " ")).alias("c"))
    links = cut_lineage(found.select("e_id", "e_check", "t_id", "t_check", "c.distance", "c.containment"))
    return Overlaps(texts, links.filter("distance is not null"), rows)


def _place(n: int) -> int:
    """Words of a place of a record of n words: SEG, but for some of fewer than MIN_WORDS words."""
    return min(SEG, n // (n // (SIX - 1) + 1))


def _grams(w: Column, sizes: list[int]) -> Column:
    """Checksums of all runs of so many words."""
    none = F.array().cast("array<bigint>")

    def runs(q: int) -> Column:
        return F.when(F.size(w) >= q, F.transform(F.sequence(F.lit(1), F.size(w) - (q - 1)), lambda i: F.xxhash64(F.slice(w, i, q)))).otherwise(none)

    return F.concat(*[runs(q) for q in sizes])


def _signature(w: Column) -> Column:
    """64 bits, one set per word, so that a word which one side has alone sets at most one bit that the other lacks."""
    one = F.transform(w, lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(x).bitwiseAND(F.lit(63)).cast("int")))
    return F.aggregate(one, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def _loads(grams: DataFrame) -> np.ndarray:
    """How many evaluation records hold a run of words, runs being told by some bits of their checksum: SLOTS counts."""
    slot = F.col("g").bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    got = grams.select(F.explode(F.array_distinct("gs")).alias("g")).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    load = np.zeros(SLOTS, "int64")
    load[got["slot"].to_numpy()] = got["n"].to_numpy()
    return np.minimum(load, 2**31 - 1).astype("int32")


def _cheapest(cost: np.ndarray, parts: int, width: int) -> np.ndarray:
    """For every row of ``cost`` (by first word of a place) the ``parts`` places of ``width`` words without overlap that cost least."""
    many, n = len(cost), cost.shape[1] + width - 1
    if n > LONG:
        cuts = [i * n // parts for i in range(parts + 1)]
        return np.stack([a + cost[:, a : b - width + 1].argmin(1) for a, b in zip(cuts, cuts[1:])], 1)
    best, last = np.zeros((many, n + 1), "int64"), []
    for _ in range(parts):
        here = np.full((many, n + 1), 1 << 60, "int64")
        here[:, width:] = best[:, : n + 1 - width] + cost
        best = np.minimum.accumulate(here, 1)
        last.append(np.maximum.accumulate(np.where(here == best, np.arange(n + 1), 0), 1).astype("int32"))
    out, end = np.zeros((many, parts), "int64"), np.full(many, n)
    for r in range(parts - 1, -1, -1):
        end = last[r][np.arange(many), end] - width
        out[:, r] = end
    return out


def _lay(gs: Column, n: Column, load: np.ndarray) -> Column:
    """The keys of a training record: of its runs of words those on the places laid, without those no evaluation record has."""

    @F.pandas_udf("array<long>")
    def run(s: pd.Series, n: pd.Series) -> pd.Series:
        out: list[list[int]] = [[] for _ in s]
        alike = defaultdict(list)
        for at, (g, words_) in enumerate(zip(s, n)):
            if len(g):
                alike[(words_, len(g))].append((at, g))
        for (words_, runs), those in alike.items():
            for i in range(0, len(those), 256):
                some = those[i : i + 256]
                g = np.stack([x for _, x in some])
                cost = load[g & (SLOTS - 1)]
                at = _cheapest(cost, int(words_) // (SIX - 1) + 1, int(words_) - runs + 1)
                g, cost = np.take_along_axis(g, at, 1), np.take_along_axis(cost, at, 1)
                for (k, _), x, c in zip(some, g, cost):
                    out[k] = list(set(x[c > 0].tolist()))
        return pd.Series(out, dtype=object)

    return run(gs, n)


def _compare(eval_words: Column, train_words: Column) -> Column:
    """struct<distance, containment>: the share of the evaluation record's n-grams that the training record holds too.

    k differences destroy at most GRAM * k n-grams: where fewer are shared than the limit leaves, or the exact word
    distance is beyond it, the distance is null.
    """

    def grams(w: list[str]) -> Counter:
        return Counter(zip(*[w[i:] for i in range(GRAM)]))

    @F.pandas_udf("distance int, containment double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for e, t in zip(x, y):
            e, t = list(e), list(t)
            own, limit = grams(e), max(len(e), len(t)) // SIX
            n, shared = own.total(), (own & grams(t)).total()
            d = word_distance(e, t) if shared >= n - GRAM * limit else limit + 1
            out.append((d if d <= limit else None, shared / n))
        return pd.DataFrame(out, columns=["distance", "containment"]).astype({"distance": "Int32", "containment": "float64"})

    return run.asNondeterministic()(eval_words, train_words)


def _meet(keys: DataFrame) -> DataFrame:
    """(e_id, e_check, t_id, t_check) of records that share a key, one as evaluation record (``e``), one as training record, with lengths and signatures within the limit.

    Keys of one side only are dropped first. A key with more than HOT * HOT pairs is split: its evaluation records are
    spread over salts, its training records repeated once a salt. k differences leave at most k words of either side
    without partner, so at most k bits of one signature are not in the other.
    """
    of = Window.partitionBy("g")
    keys = keys.repartition("g").withColumn("es", F.count_if("e").over(of)).withColumn("ts", F.count_if(~F.col("e")).over(of)).filter("es > 0 and ts > 0")
    hot = F.col("es") * F.col("ts") > HOT * HOT
    limit = F.floor(F.greatest("e_n", "t_n") / SIX)
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    near = (F.abs(F.col("e_n") - F.col("t_n")) <= limit) & (apart("e_sig", "t_sig") <= limit) & (apart("t_sig", "e_sig") <= limit)

    def side(x: DataFrame, p: str, *more: str) -> DataFrame:
        return x.select(F.col("text_id").alias(f"{p}_id"), F.col("check").alias(f"{p}_check"), F.col("n").alias(f"{p}_n"), F.col("sig").alias(f"{p}_sig"), "g", *more)

    ev, tr = keys.filter("e"), keys.filter("not e")
    cold = side(ev.filter(~hot), "e").join(side(tr.filter(~hot), "t").hint("merge"), "g").filter(near)
    salts = F.ceil(F.col("es") / HOT).cast("int")
    spread = side(ev.filter(hot).withColumn("salt", F.pmod(F.xxhash64("text_id", "check"), salts).cast("int")), "e", "salt")
    every = side(tr.filter(hot).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))), "t", "salt")
    split = spread.join(every.hint("merge"), ["g", "salt"]).filter(near)
    pairs = ["e_id", "e_check", "t_id", "t_check"]
    return cold.select(*pairs).unionByName(split.select(*pairs)).distinct()


def row_pairs(o: Overlaps) -> DataFrame:
    """Pairs of rows, the smaller id first; one of train and one of an evaluation split."""
    e = o.rows.filter(~F.col("is_train")).select(F.col("id").alias("e_row"), F.col("text_id").alias("e_id"), F.col("check").alias("e_check"))
    t = o.rows.filter("is_train").select(F.col("id").alias("t_row"), F.col("text_id").alias("t_id"), F.col("check").alias("t_check"))
    both = o.links.join(e.hint("merge"), ["e_id", "e_check"]).join(t.hint("merge"), ["t_id", "t_check"])
    return both.select(F.least("e_row", "t_row").alias("row_id_a"), F.greatest("e_row", "t_row").alias("row_id_b"), "distance", "containment")
