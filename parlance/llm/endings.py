"""Problem 10 (and the truncation test of problem 1): does a text stop before its last sentence is finished?

A backward character n-gram model reads from the end of a text. Its last word: how often the corpus ends a sentence, and
how often it goes on, behind each suffix of that word, the longer suffix leaning on the shorter one. The words before:
every character given the ORDER characters behind it and the number of words to the end, in sentences that end there,
against the same in running text. The log-odds of going on and ending are compared with a threshold per group.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.runtime import cut_lineage, plain

#: Characters of context, words read backwards, characters of the last word that are read.
ORDER, DEPTH, SUFFIX = 4, 6, 16
#: Characters that are counted at a time, and counts that a task holds before it adds them up.
CHUNK, HELD = 1_000_000, 1_000_000
#: Copies of the counts of contexts of up to one character, which most texts look up.
SALTS = 32
#: A trailing bracketed note, smiley or heart; a signature line.
_NOTE = re.compile(r"(?:<3|[:;]-?[)(DPp]|\([^()]{0,60}\)|\[[^\[\]]{0,60}\])$")
_SIGNED = re.compile(r"\s*[—–-]{1,2}\s*(\S).{0,60}$")
#: A final mark with closing quotes, and what may open the next sentence; a mark that is the last of several dots.
_END = re.compile(r"""[.!?。！？]["'”’»)\]]*(?=\s+["'“«‘(\[¿¡—–]*(\S)|$)""")
_DOTTED, _DOTS = re.compile(r"(?:\.\s?\.|…)$"), re.compile(r"\.\s?\.\s?\.+|…")
_LOOSE = re.compile(r"(?:\s+[^\w\s]+)+$")


def body(text: str) -> str:
    """A text without trailing blanks, signs, notes and signatures, stripped one by one from the end."""
    while text := text.rstrip():
        c = text[-1]
        if not c.isalnum() and (c in "*_~#|•♥♪\ufe0f" or unicodedata.category(c) in ("So", "Sk", "Cf")):
            text = text[:-1]
            continue
        line = text.rfind("\n")
        if line >= 0 and len(text) - line < 200 and (m := _SIGNED.match(text, line + 1)) and m[1].isupper():
            text = text[:line]
        elif c in ")](DPp3" and (m := _NOTE.search(text, max(0, len(text) - 70))):
            text = text[: m.start()]
        else:
            break
    return text


class _Letters(dict):
    """Characters as the model reads them: lower case, digits alike, any blank as one, no quotes and brackets."""

    def __missing__(self, o: int) -> str:
        c = chr(o)
        got = "0" if c.isdigit() else " " if c.isspace() else "" if c in "\"'“”«»‘’([])\x00" else c.lower()
        if len(self) < 100_000:
            self[o] = got
        return got


_LETTERS = _Letters()


def _norm(s: str) -> str:
    return " ".join(s.translate(_LETTERS).split())


def sentences(text: str) -> tuple[list[str], str | None]:
    """The finished sentences of a body without their marks, and the unfinished rest (None without any)."""
    out, at = [], 0
    for m in _END.finditer(text):
        after = m[1]
        if after is not None and not (after.isupper() or after.isdigit() or (after.isalpha() and not after.islower())):
            continue
        if _DOTTED.search(text[max(at, m.start() - 3) : m.start() + 1]):
            continue
        out.append(_norm(text[at : m.start()]))
        at = m.end()
    rest = text[at:]
    return [s for s in out if s], (rest if rest.strip() else None)


def open_end(rest: str | None) -> str | None:
    """The unfinished rest of a text as the model reads it; None if it has no letter or digit."""
    if rest is None:
        return None
    s = _norm(_LOOSE.sub("", _DOTS.sub("", rest)))
    return s if re.search(r"\w", s) else None


def _key(h: np.ndarray, order: int, distance: np.ndarray | int) -> np.ndarray:
    """One number for a context, its length and the words to the end (0: anywhere)."""
    x = h + np.uint64(order * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) + np.asarray(distance, "uint64") * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _expand(grams: np.ndarray, distance: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per order: the rows of ``grams`` (a character, then the ORDER characters behind it, 0 beyond the sentence) whose
    context is whole, and its number."""
    h, whole = np.zeros(len(grams), "uint64"), np.ones(len(grams), bool)
    for order in range(ORDER + 1):
        if order:
            whole = whole & (grams[:, order] > 0)
            h = h * np.uint64(0x100000001B3) + grams[:, order] + np.uint64(1)
        at = np.flatnonzero(whole)
        yield order, at, _key(h[at], order, distance[at])


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and counts of the different numbers."""
    codes, kinds = pd.factorize(h)
    first = np.zeros(len(kinds), "int64")
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first, np.bincount(codes, minlength=len(kinds))


def _tally(parts: list[str], ended: list[bool]) -> pd.DataFrame:
    """Counts of characters in contexts, anywhere and by the words to the end of a sentence.

    Grams of full length are counted over all characters; the shorter contexts are summed from the different ones.
    """
    a = np.frombuffer(("\x00" * ORDER).join([*parts, ""]).encode("utf-32-le"), "<u4").astype("uint64")
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + ORDER) - ORDER
    h = a[: len(a) - ORDER].copy()
    for k in range(1, ORDER + 1):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += a[k : len(a) - ORDER + k]
    real = np.flatnonzero(a[: len(a) - ORDER])
    blank = np.cumsum(a == 32, dtype="int32")
    of = np.repeat(np.arange(len(parts)), sizes)
    words = blank[ends - 1][of] - blank[real] + (a[real] == 32)
    near = np.array(ended)[of] & (words >= 1) & (words < DEPTH)
    out = []
    for at, d in ((real, np.zeros(len(real), "int32")), (real[near], words[near])):
        first, n = _distinct(h[at] * np.uint64(64) + d.astype("uint64") + (h[at] >> np.uint64(40)))
        grams = np.stack([a[at[first] + k] for k in range(ORDER + 1)], 1) if len(first) else np.zeros((0, ORDER + 1), "uint64")
        for order, rows, key in _expand(grams, d[first]):
            out.append(pd.DataFrame({"x": key.view("int64"), "c": grams[rows, 0].astype("int64"), "k": order, "n": n[rows]}))
    return pd.concat(out).groupby(["x", "c", "k"], as_index=False)["n"].sum()


def _window(s: str) -> tuple[str, list[str]]:
    """The last word of an unfinished end and, for every character of the words before it, a unit: words to the end,
    the character and up to ORDER characters behind it."""
    s = "^" + s
    cut = s.rfind(" ")
    units, d = [], 0
    for j in range(cut, -1, -1):
        d += s[j] == " "
        if d >= DEPTH:
            break
        units.append(f"{d}{s[j : j + ORDER + 1]}")
    return (s[cut:] if cut >= 0 else s), units


_READ = "x long, c long, k int, n long, w string, e long, o long, id long, units array<string>"


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a partition: (context, character) and words (n in all, e at sentence ends, o at unfinished ends); and
    the window of every unfinished text that has an id."""
    grams: list[pd.DataFrame] = []
    every, last, open_ = Counter(), Counter(), Counter()
    parts: list[str] = []
    ended: list[bool] = []
    columns = [c.split()[0] for c in _READ.split(", ")]

    def full(f: pd.DataFrame) -> pd.DataFrame:
        return f.assign(**{c: pd.Series([None] * len(f), dtype=object) for c in columns if c not in f})[columns]

    def flush() -> None:
        if parts:
            grams.append(_tally(parts, ended))
        parts.clear(), ended.clear()
        if sum(map(len, grams)) > HELD:
            grams[:] = [pd.concat(grams).groupby(["x", "c", "k"], as_index=False)["n"].sum()]

    size = 0
    for b in batches:
        windows = []
        for i, t in zip(b["id"], b["t"]):
            done, rest = sentences(body(t))
            tail = open_end(rest)
            if tail and not pd.isna(i):
                windows.append((i, *_window(tail)))
            for s, e in [*((s, True) for s in done), *([(tail, False)] if tail else [])]:
                parts.append("^" + s)
                ended.append(e)
                size += len(s)
                w = parts[-1].split(" ")
                every.update(w)
                (last if e else open_)[w[-1]] += 1
            if size > CHUNK:
                flush()
                size = 0
        if windows:
            yield full(pd.DataFrame(windows, columns=["id", "w", "units"]))
    flush()
    if grams:
        yield full(pd.concat(grams).groupby(["x", "c", "k"], as_index=False)["n"].sum())
    if every:
        w = list(every)
        yield full(pd.DataFrame({"n": [every[x] for x in w], "w": w, "e": [last[x] for x in w], "o": [open_[x] for x in w]}))


@dataclass
class EndModel:
    grams: DataFrame
    suffixes: DataFrame
    windows: DataFrame
    ends: int
    places: int


def fit(texts: DataFrame, text: str, key: str) -> EndModel:
    """Count the backward model over all positions of all texts, and note the windows of unfinished ones.

    Places of continuation are all characters but blanks behind which a sentence goes on; the end of an unfinished text
    is no evidence. ``key``: number of a text that is to be rated (equal texts have equal numbers), or null.
    """
    got = texts.filter(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    got = cut_lineage(got.mapInPandas(_count, _READ))
    one = got.filter("x is not null").groupBy("x", "c", "k").agg(F.sum("n").alias("n"))
    # contexts of up to one character are few and looked up by every text
    grams = one.groupBy("x", "k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("by"))
    grams = grams.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("k") <= 1, SALTS - 1).otherwise(0))))
    words = got.filter("n is not null and w is not null").groupBy("w").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("o").alias("o"))
    # a word within running text has a blank in front, which is part of it; the first of a sentence has its sign
    words = words.select(F.when(F.col("w").startswith("^"), F.col("w")).otherwise(F.concat(F.lit(" "), "w")).alias("w"), "n", "e", "o")
    # only the last characters before a place are read
    inner = words.select(F.explode(F.expr(f"transform(sequence(2, length(w)), i -> struct(substring(w, greatest(1, i - {SUFFIX - 1}), least(i, {SUFFIX})) as p, if(i < length(w), n, n - o) as a, if(i < length(w), 0L, e) as e))")).alias("p"))
    starts = cut_lineage(inner.select("p.*").groupBy("p").agg(F.sum("a").alias("a"), F.sum("e").alias("e")))
    ends, places = starts.agg(F.sum("e"), F.sum("a")).first()
    tails = starts.select(F.explode(F.expr(f"transform(sequence(1, least(length(p), {SUFFIX})), i -> substring(p, -i, i))")).alias("s"), "a", "e")
    windows = got.filter("id is not null").select("id", "w", "units").dropDuplicates(["id"])
    return EndModel(cut_lineage(grams), cut_lineage(tails.groupBy("s").agg(F.sum("a").alias("a"), F.sum("e").alias("e"))), cut_lineage(windows), ends or 0, places or 0)


def _lookups(u: pd.Series) -> pd.Series:
    """Per order of a unit: its character and the numbers of its context anywhere and at that distance."""
    out: list[list] = [[] for _ in u]
    if not len(u):
        return pd.Series(out)
    grams = np.frombuffer("".join(x[1:].ljust(ORDER + 1, "\x00") for x in u).encode("utf-32-le"), "<u4").astype("uint64").reshape(-1, ORDER + 1)
    words = np.array([int(x[0]) for x in u])
    for (order, rows, b), (_, _, e) in zip(_expand(grams, np.zeros(len(u), "int64")), _expand(grams, words)):
        for i, x, y in zip(rows.tolist(), b.view("int64").tolist(), e.view("int64").tolist()):
            out[i].append((order, int(grams[i, 0]), x, y))
    return pd.Series(out)


def _odds(model: EndModel, units: DataFrame) -> DataFrame:
    """(u, lr): log of running text over sentence end for each unit, orders 0 to ORDER, each leaning on the one below.

    Unseen characters share as much as there are kinds in a context; a context never seen at sentence ends says nothing.
    """
    look = cut_lineage(units.select("u", F.explode(F.pandas_udf(_lookups, "array<struct<k:int,c:long,b:long,e:long>>")("u")).alias("q")).select("u", "q.k", "q.c", F.explode(F.array(F.struct(F.lit(False).alias("at"), F.col("q.b").alias("x")), F.struct(F.lit(True).alias("at"), F.col("q.e").alias("x")))).alias("y")).select("u", "k", "c", "y.*"))
    look = look.withColumn("salt", F.when(F.col("k") <= 1, F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int")).otherwise(0))
    got = look.join(model.grams.drop("k").hint("merge"), ["x", "salt"]).select("u", "k", "at", "n", "kinds", F.coalesce(F.col("by")[F.col("c")], F.lit(0)).alias("m"))
    cells = [F.max(F.when((F.col("k") == k) & (F.col("at") == at), F.struct("n", "kinds", "m"))).alias(f"{'e' if at else 'b'}{k}") for k in range(ORDER + 1) for at in (False, True)]
    wide = got.groupBy("u").agg(*cells).withColumn("p", F.lit(1 / 200)).withColumn("r", F.lit(1.0))
    for k in range(ORDER + 1):
        b, e = (lambda f: F.col(f"b{k}.{f}")), (lambda f: F.col(f"e{k}.{f}"))
        wide = wide.withColumn("p", F.coalesce((b("m") + b("kinds") * F.col("p")) / (b("n") + b("kinds")), "p"))
        wide = wide.withColumn("r", F.coalesce((e("m") + e("kinds") * F.col("p") * F.col("r")) / ((e("n") + e("kinds")) * F.col("p")), "r"))
    return wide.select("u", (-F.log("r")).alias("lr"))


def scores(model: EndModel) -> DataFrame:
    """(id, log_odds): log of continuation over end of the final context of every unfinished text that has an id.

    Texts with a final mark or without any word give no row.
    """
    win = model.windows
    words = win.select("w").distinct()
    tails = words.select("w", F.posexplode(F.expr(f"transform(sequence(1, least(length(w), {SUFFIX})), i -> substring(w, -i, i))")).alias("i", "s"))
    seen = tails.join(model.suffixes.hint("merge"), "s").groupBy("w").agg(F.array_sort(F.collect_list(F.struct("i", "a", "e"))).alias("v"))
    p0 = (model.ends + 1.0) / (model.places + 2.0)
    # a longer suffix leans on the shorter one; none is known beyond the first that never occurred
    p = F.aggregate("v", F.lit(p0), lambda p, x: (x["e"] + p) / (x["a"] + 1.0))
    first = words.join(seen.withColumn("p", p).select("w", "p").hint("merge"), "w", "left").select("w", F.least(F.coalesce("p", F.lit(p0)), F.lit(1 - 1e-9)).alias("p"))
    first = first.select("w", (F.log((1 - F.col("p")) / F.col("p")) - math.log((1 - p0) / p0)).alias("l0"))
    marks = win.select("id", F.explode("units").alias("u"))
    before = marks.join(_odds(model, marks.select("u").distinct()).hint("merge"), "u").groupBy("id").agg(F.sum("lr").alias("lr"))
    out = win.select("id", "w").join(first.hint("merge"), "w").join(before.hint("merge"), "id", "left")
    return out.select("id", (F.col("l0") + F.coalesce("lr", F.lit(0.0))).alias("log_odds"))


def thresholds(scored: DataFrame, group: str, steps: int = 20) -> DataFrame:
    """(group, limit): the log-odds over which an unfinished text counts as cut, log of (whole : cut) by expectation
    maximisation of the share of cut ones.

    ``scored``: group, log_odds. Works on a histogram of rounded log-odds, at most 601 bins a group, each group in a task
    of its own; groups of few texts lean on the share of all, whose bins are added up on the driver.
    """

    def em(x: np.ndarray, n: np.ndarray, prior: float, weight: float) -> float:
        share = prior
        for _ in range(steps):
            hit = float((n / (1 + np.exp(-(x + math.log(share / (1 - share)))))).sum())
            share = min(0.999, max(1e-4, (hit + weight * prior) / (n.sum() + weight)))
        return share

    h = cut_lineage(scored.groupBy(F.col(group).alias("g"), F.round(F.least(F.greatest("log_odds", F.lit(-30.0)), F.lit(30.0)), 1).alias("x")).agg(F.count(F.lit(1)).alias("n")))
    bins = h.groupBy("x").agg(F.sum("n").alias("n")).toPandas()  # at most 601 rows
    every = em(bins["x"].to_numpy(), bins["n"].to_numpy(), 0.3, 1.0) if len(bins) else 0.3

    def one(b: pd.DataFrame) -> pd.DataFrame:
        s = em(b["x"].to_numpy(), b["n"].to_numpy(), every, 50.0)
        return pd.DataFrame({"g": [b["g"].iloc[0]], "limit": [math.log((1 - s) / s)]})

    return h.groupBy("g").applyInPandas(one, "g string, limit double")


@dataclass
class Truncation:
    flags: DataFrame
    report: DataFrame


def detect(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> Truncation:
    """Texts that stop before their last word or sentence is finished, and the rate per source.

    Thresholds hold per language (spelling aside; null and blank are one group) of this column. ``flags``: id, log_odds
    (null if the text ends with a final mark), cut. A null or blank text, or one without a letter or digit, is not cut.
    Ids should be unique; rows with equal ids and texts get equal flags. The model is counted over all texts, whole.
    ``report``: source (spelling aside, null kept), texts, cut_texts, cut_rate. Empty tables give empty results.
    """
    src = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"), F.coalesce(F.nullif(plain(F.col(lang_col)), F.lit("")), F.lit("und")).alias("__g"), plain(F.col(source_col)).alias("__s"))
    src = src.withColumn("__k", F.xxhash64("__t", F.lit(10)))
    sc = cut_lineage(scores(fit(src, "__t", "__k")).withColumnRenamed("id", "__k"))
    rows = src.drop("__t").join(sc.hint("merge"), "__k", "left")
    rated = src.select("__k", "__g").join(sc.hint("merge"), "__k")
    rows = rows.join(thresholds(rated, "__g").select(F.col("g").alias("__lg"), F.col("limit").alias("__lim")), F.col("__g") == F.col("__lg"), "left")
    flags = rows.select(F.col("__id").alias(id_col), "log_odds", F.coalesce(F.col("log_odds") > F.col("__lim"), F.lit(False)).alias("cut"), F.col("__s").alias(source_col))
    report = flags.groupBy(source_col).agg(F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut_texts"), (F.count_if("cut") / F.count(F.lit(1))).alias("cut_rate"))
    return Truncation(flags.drop(source_col) if source_col != id_col else flags, report)
