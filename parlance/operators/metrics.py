"""Classification and text-overlap measures."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.round(F.avg((F.col(y) == F.col(p)).cast("double")), 4).alias("accuracy"))


def f1_parts(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per label of either column: support, predicted, hits and F1 (0 where undefined)."""
    pairs = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    both = pairs.select(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("hits"))
    both = both.unionByName(pairs.select(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")))
    per = both.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    f1 = F.coalesce(F.try_divide(2 * F.col("hits").cast("double"), (F.col("support") + F.col("predicted")).cast("double")), F.lit(0.0))
    return per.withColumn("f1", f1)


def f1_weighted(df: DataFrame, y: str, p: str) -> DataFrame:
    per = f1_parts(df, y, p)
    return per.agg(F.round(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support").cast("double")), 4).alias("f1_weighted"))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """Row-normalised confusion as (y, p, n, share)."""
    pairs = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tot = pairs.groupBy("y").agg(F.sum("n").alias("t"))
    return pairs.join(tot, "y").select("y", "p", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def shared_ngrams(pred: Column, ref: Column, most: int) -> Column:
    """array<struct<hits, pred, ref>> for n-grams of 1 to ``most`` words: clipped matches and the n-grams of either side.

    Counted in Arrow batches, in time linear in the texts; null arrays count as empty.
    """

    def grams(w: list[str], n: int) -> Counter:
        return Counter(zip(*[w[i:] for i in range(n)]))

    @F.pandas_udf("array<struct<hits:long,pred:long,ref:long>>")
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            out = []
            for x, y in zip(a, b):
                x, y = ([] if v is None else list(v) for v in (x, y))
                row = []
                for n in range(1, most + 1):
                    g, h = grams(x, n), grams(y, n)
                    row.append(((g & h).total(), g.total(), h.total()))
                out.append(row)
            yield pd.Series(out)

    return count(pred, ref)


def f_measure(counts: Column) -> Column:
    """F measure of the n-gram counts of ``shared_ngrams``; 0 where neither side has any."""
    return F.coalesce(F.try_divide(2 * counts["hits"].cast("double"), (counts["pred"] + counts["ref"]).cast("double")), F.lit(0.0))


def rouge_l(pred: Column, ref: Column) -> Column:
    """F measure of the longest common subsequence of words, in Arrow batches."""

    @F.pandas_udf("double")
    def lcs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([lcs_f(list(x), list(y)) for x, y in zip(a, b)], dtype="float64")

    return lcs(pred, ref)


def lcs_f(a: list[str], b: list[str]) -> float:
    """By one big integer per word of ``b`` (bit-parallel), so long texts are fine."""
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    mask = (1 << len(a)) - 1
    v = mask
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & mask
    hit = len(a) - v.bit_count()
    return 2 * hit / (len(a) + len(b))


@lru_cache(maxsize=100_000)
def _word_vector(word: str, dims: int) -> np.ndarray:
    v, w = np.zeros(dims), f"^{word}$"
    for i in range(max(1, len(w) - 2)):
        h = zlib.crc32(w[i : i + 3].encode())
        v[h % dims] += 1.0 if h & 0x10000 else -1.0
    n = np.linalg.norm(v)
    return v / n if n else v


def word_vectors(words: list[str], dims: int = 64) -> np.ndarray:
    """A deterministic stand-in for a model of token vectors: signed hashes of a word's trigrams, without its context."""
    return np.stack([_word_vector(w, dims) for w in words])


def greedy_match(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Precision, recall and F1 of two arrays of token vectors: the best cosine of every token, both ways."""
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1.0)
    near = unit(a) @ unit(b).T
    p, r = float(near.max(1).mean()), float(near.max(0).mean())
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def given(vectors: list) -> np.ndarray:
    return np.stack([np.asarray(v, "float64") for v in vectors])


def bertscore(pred: Column, ref: Column, encode: Callable[[list], np.ndarray] = word_vectors) -> Column:
    """Greedy match of the token vectors of two arrays of tokens, in Arrow batches; 0 where a side is empty or null.

    ``encode`` gives the vectors of a list of tokens; ``given`` is for arrays that hold the vectors themselves.
    """

    @F.pandas_udf("precision double, recall double, f1 double")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            out = [greedy_match(encode(list(x)), encode(list(y))) if x is not None and y is not None and len(x) and len(y) else (0.0, 0.0, 0.0) for x, y in zip(a, b)]
            yield pd.DataFrame(out, columns=["precision", "recall", "f1"], dtype="float64")

    return match(pred, ref)


def bleu(df: DataFrame, pred: str, ref: str, most: int = 4) -> DataFrame:
    """Corpus BLEU over white-space words: clipped n-gram counts and lengths are summed, then combined."""
    rows = df.select(pred, ref, shared_ngrams(F.col(pred), F.col(ref), most).alias("g"))
    cols = [F.sum(F.col("g")[n - 1][part]).alias(f"{to}{n}") for n in range(1, most + 1) for part, to in (("hits", "h"), ("pred", "t"))]
    s = rows.agg(*cols, F.sum(F.size(pred)).alias("lp"), F.sum(F.size(ref)).alias("lr"))
    logs = sum((F.log(F.try_divide(F.col(f"h{n}").cast("double"), F.col(f"t{n}").cast("double"))) for n in range(1, most + 1)), F.lit(0.0))
    short = F.when(F.col("lp") < F.col("lr"), F.exp(1 - F.col("lr") / F.col("lp"))).otherwise(1.0)
    return s.select(F.round(F.coalesce(short * F.exp(logs / most), F.lit(0.0)), 6).alias("bleu"))
