"""Character n-gram naive Bayes over languages, with a class for anything else."""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.prefix import hash_key, take_smallest
from parlance.runtime import bounded_rows, cut_lineage, plain

#: Bounded training sample: documents per language, characters of one document (longer ones are not drawn), languages.
SAMPLE, LONGEST, CLASSES = 400, 4_000, 200
#: Weights of the 3-, 2- and 1-character models and of a uniform one over code points.
WEIGHTS, UNIFORM = (0.6, 0.3, 0.0999, 0.0001), 1 / 110_000
OTHER = "other"
#: Texts that are rated together.
BATCH = 1_000
_WORD, _QUOTED = re.compile(r"\w+"), re.compile(r"[\"“„«»][^\"“”„«»]*[\"”“«»]")


class _Letters(dict):
    """Letters and marks in lower case, any other character as a blank."""

    def __missing__(self, o: int) -> str:
        c = chr(o)
        got = c.lower() if unicodedata.category(c)[0] in "LM" else " "
        if len(self) < 100_000:
            self[o] = got
        return got


_LETTERS = _Letters()


def clean(t: str) -> str:
    """Letters in lower case, everything else one blank, blanks at both ends."""
    return " " + " ".join(t.translate(_LETTERS).split()) + " "


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the number of the text each belongs to."""
    a = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4").astype("int64")
    return a, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


class Languages:
    """Per-class log-probabilities of character trigrams; ``other`` is a unigram model of all languages together."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names = [*sorted(texts), OTHER]
        tri, bi, uni = [], [], []
        for name in self.names[:-1]:
            a, at = _codes([" " + clean(d) for d in texts[name]])
            tri.append(np.unique((a[:-2] << 42 | a[1:-1] << 21 | a[2:])[at[:-2] == at[2:]], return_counts=True))
            bi.append(np.unique((a[:-1] << 21 | a[1:])[at[:-1] == at[1:]], return_counts=True))
            uni.append(np.unique(a, return_counts=True))
        self.tri, self.bi, self.uni = (self._table(x) for x in (tri, bi, uni))
        k1, n1 = self.uni
        total = np.maximum(n1.sum(0), 1)
        a, b, c, d = WEIGHTS
        # conditional shares, weighted; a context that a class never has gives none
        k3, n3 = self.tri
        self.p3 = a * n3 / np.maximum(self._at(self.bi, k3 >> 21), 1)
        k2, n2 = self.bi
        self.p2 = b * n2 / np.maximum(self._at(self.uni, k2 >> 21), 1)
        self.p1 = c * n1 / total + d * UNIFORM
        self.p0 = d * UNIFORM
        self.every = 0.9 * n1.sum(1) / max(1, total.sum())

    @staticmethod
    def _table(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([k for k, _ in parts] or [np.zeros(0, "int64")]))
        n = np.zeros((len(keys), len(parts)))
        for i, (k, v) in enumerate(parts):
            n[np.searchsorted(keys, k), i] = v
        return keys, n

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
        return i, (keys[i] == x if len(keys) else np.zeros(len(x), bool))

    def _at(self, table: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        i, hit = self._find(table[0], x)
        return np.where(hit[:, None], table[1][i], 0) if len(table[0]) else np.zeros((len(x), table[1].shape[1]))

    def logs(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of every whole text per class, the last one being ``other``."""
        a, at = _codes([" " + clean(t) for t in texts])
        same = at[:-2] == at[2:]
        x, y, z, of = a[:-2][same], a[1:-1][same], a[2:][same], at[2:][same]
        grams, where = np.unique(x << 42 | y << 21 | z, return_inverse=True)
        two, one = grams & (1 << 42) - 1, grams & (1 << 21) - 1
        p = np.full((len(grams), len(self.names)), self.p0)
        p[:, -1] = 0.1 * UNIFORM
        for keys, share, k in ((self.tri[0], self.p3, grams), (self.bi[0], self.p2, two)):
            i, hit = self._find(keys, k)
            p[hit, :-1] += share[i[hit]]
        i, hit = self._find(self.uni[0], one)
        p[hit, :-1] += self.p1[i[hit]] - self.p0
        p[hit, -1] += self.every[i[hit]]
        p = np.log(p)
        return np.stack([np.bincount(of, p[where, j], len(texts)) for j in range(len(self.names))], 1)

    def best(self, text: str) -> tuple[str, float]:
        """The likeliest class and its posterior under equal priors; no letters give (other, 0)."""
        if len(clean(text)) < 3:
            return OTHER, 0.0
        x = self.logs([text])[0]
        return self.names[int(x.argmax())], float(1 / np.exp(x - x.max()).sum())


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE, longest: int = LONGEST, classes: int = CLASSES, more: dict[str, list[DataFrame]] | None = None, seed: int = 1) -> Languages:
    """Fit on at most ``sample`` texts per language, of at most ``longest`` characters each, drawn by hash order, of the
    ``classes`` languages with most texts.

    ``more``: language -> one-column frames of further texts in that language, each sampled alike. Languages: spelling aside;
    null and blank are left out. The sample's bound is documented here, so the model's size is bounded too.
    """
    rows = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), plain(F.col(lang_col)).alias("l"))
    for name, frames in (more or {}).items():
        for n, extra in enumerate(frames, 1):
            rows = rows.unionByName(extra.select(F.xxhash64(extra.columns[0]).alias("i"), F.col(extra.columns[0]).alias("t"), F.lit("+" * n + name).alias("l")))
    rows = rows.filter(F.col("t").isNotNull() & (F.length("t") <= longest) & (F.coalesce("l", F.lit("")) != ""))
    rows = rows.withColumn("k", hash_key(seed, F.col("i"), F.col("t"))).withColumn("one", F.lit(1).cast("long"))
    # the labels with most texts are classes; dirty ones beyond the bound would each have a handful
    budget = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(classes).select("l", F.lit(sample).cast("long").alias("__budget"))
    got = bounded_rows(take_smallest(rows, "l", "k", "t", "one", cut_lineage(budget)).select("l", "t"), sample * classes, "the language sample")
    texts: dict[str, list[str]] = {}
    for r in got:
        texts.setdefault(r["l"].lstrip("+"), []).append(r["t"])
    return Languages(texts)


def own_words(text: str, near: str) -> str:
    """A text without quoted passages and without capitalised words that its inputs use too: names tell no language."""
    t = _QUOTED.sub(" ", text)
    seen = set(_WORD.findall(near.lower()))
    kept = _WORD.sub(lambda m: " " if m[0][0].isupper() and m[0].lower() in seen else m[0], t)
    return kept if len(clean(kept)) > 6 else text


def _rate(model: Languages, texts: list[str | None], expected: str) -> pd.DataFrame:
    sizes = np.array([len(clean(t)) if t else 0 for t in texts])
    x = model.logs([t or "" for t in texts])
    at = model.names.index(expected) if expected in model.names else None
    some = sizes >= 3
    post = 1 / np.exp(x - x.max(1, keepdims=True)).sum(1)
    lang = np.array(model.names, object)[x.argmax(1)]
    margin = np.full(len(texts), np.nan) if at is None else (x[:, at] - np.delete(x, at, 1).max(1)) / np.maximum(sizes, 1)
    out = pd.DataFrame({"lang": np.where(some, lang, OTHER), "posterior": np.where(some, post, 0.0), "margin": margin})
    out["margin"] = out["margin"].astype("Float64").where(some & ~np.isnan(margin), pd.NA)
    return out


def classify(model: Languages, text: Column, near: Column, expected: str) -> Column:
    """struct<lang, posterior, margin> of a text beside its inputs ``near``.

    ``margin``: log-odds per character of the expected language against the likeliest other class. Null texts and those
    without letters give class other, posterior 0 and a null margin.
    """

    @F.pandas_udf("lang string, posterior double, margin double")
    def run(s: pd.Series, inputs: pd.Series) -> pd.DataFrame:
        out = []
        texts = [own_words(t, n or "") if t else "" for t, n in zip(s, inputs)]
        for i in range(0, len(texts), BATCH):
            out.append(_rate(model, texts[i : i + BATCH], expected))
        return pd.concat(out, ignore_index=True) if out else _rate(model, [], expected)

    return run(text, near)


def split_points(bins: list[tuple[bool, float, int]], steps: int = 100) -> dict[bool, float]:
    """Where a low group of values parts from the main one: two normal curves by expectation maximisation.

    ``bins``: class, value, count. Both classes share the curves, the share of the low one is fitted for each class and
    leans on that of all by ten values; no curve is narrower than 0.1. The main curve starts at the median, the low one at the lowest hundredth. A
    class's point is the highest value below the main mean at which the low curve is the likelier; without such a value
    it is minus infinity.
    """
    classes = np.array([b[0] for b in bins], bool)
    x, n = np.array([b[1] for b in bins], float), np.array([b[2] for b in bins], float)
    if not len(x):
        return {False: -math.inf, True: -math.inf}
    order = np.argsort(x, kind="stable")
    classes, x, n = classes[order], x[order], n[order]
    cum = np.cumsum(n) / n.sum()
    mid, low = x[np.searchsorted(cum, 0.5)], x[np.searchsorted(cum, 0.01)]
    mean, sd, share = np.array([mid, min(low, mid - 0.3)]), np.array([0.1, 0.3]), np.array([0.97, 0.03])
    of = {c: share for c in (False, True)}
    curves = lambda v: np.exp(-(((v[:, None] - mean) / sd) ** 2) / 2) / sd + 1e-300
    for _ in range(steps):
        d = curves(x) * np.where(classes[:, None], of[True], of[False])
        w = d / d.sum(1, keepdims=True) * n[:, None]
        mass = w.sum(0)
        if mass.min() < 1e-3:
            break
        mean = (w * x[:, None]).sum(0) / mass
        sd = np.maximum(np.sqrt((w * (x[:, None] - mean) ** 2).sum(0) / mass), 0.1)
        share = mass / mass.sum()
        of = {c: (w[classes == c].sum(0) + 10 * share) / (n[classes == c].sum() + 10) for c in (False, True)}
    out = {}
    for c in (False, True):
        grid = np.arange(x[0] - 0.01, mean[0], 0.005)
        d = curves(grid) * of[c]
        under = np.flatnonzero(d[:, 1] > d[:, 0])
        out[c] = float(grid[under[-1]]) if len(under) and mean[1] < mean[0] else -math.inf
    return out
