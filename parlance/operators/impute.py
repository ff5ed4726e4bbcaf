"""Filling missing values by chained equations over distributed regressions (problem 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.prefix import hash_key
from parlance.runtime import cut_lineage, plain

#: The five ordered levels, spelling aside and with blank or underscore after very.
LEVELS = ["very low", "low", "medium", "high", "very high"]
#: Weight of the overall mean in a group's mean, and of the ridge.
SHRINK, RIDGE = 2.0, 1e-6


def level_code(c: Column, levels: list[str] = LEVELS) -> Column:
    """1-based rank of an ordered level, null if the text is none of them."""
    text = F.regexp_replace(plain(c), r"[\s_]+", " ")
    pos = F.array_position(F.array(*[F.lit(x) for x in levels]), text)
    return F.when(pos > 0, pos.cast("double"))


def finite(c: Column) -> Column:
    """A number, null for NaN and infinities."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _uniform(h: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in (0, 1) by mixing a row's hash, the same on every run."""
    x = h.astype("uint64") + np.uint64(sum((n + 1) * p for n, p in zip(salt, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))) & 0xFFFFFFFFFFFFFFFF)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype("float64") + 0.5) / 2.0**53


@dataclass
class _Step:
    """A fitted field: its column, the columns it is told by, and how."""

    field: int
    on: list[int]
    weights: np.ndarray
    offsets: np.ndarray
    spread: float | None
    scale: tuple[float, float]
    salt: int
    noise: bool

    def apply(self, x: np.ndarray, gaps: np.ndarray, h: np.ndarray) -> None:
        at = np.flatnonzero(gaps[:, self.field])
        told = x[np.ix_(at, self.on)] @ self.weights.T + self.offsets
        if self.spread is None:
            if self.noise:
                share = np.cumsum(np.exp(told - told.max(1, keepdims=True)), 1)
                level = (_uniform(h[at], self.salt, self.field)[:, None] * share[:, -1:] >= share[:, :-1]).sum(1)
            else:
                level = told.argmax(1)
            x[at, self.field] = (level + 1 - self.scale[0]) / self.scale[1]
        else:
            x[at, self.field] = told[:, 0]
            if self.noise:
                u, v = _uniform(h[at], self.salt, self.field), _uniform(h[at], self.salt, self.field, 1)
                x[at, self.field] += self.spread * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


@dataclass
class _Rows:
    """How a batch is read: numbers of value columns, level fields (column, mean, spread), steps to be taken first."""

    fields: int
    levels: list[tuple[int, float, float]]
    steps: list[_Step]

    def read(self, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = b.filter(like="__v").to_numpy("float64").copy()
        gaps = b.filter(like="__m").to_numpy(bool) if self.steps else np.zeros((len(b), self.fields), bool)
        h = b["__h"].to_numpy("int64") if self.steps else None
        for s in self.steps:
            s.apply(x, gaps, h)
        return x, gaps

    def terms(self, x: np.ndarray) -> np.ndarray:
        """A constant, all values, and for each level field a mark per level."""
        marks = [np.round(x[:, [i]] * sd + mean) == np.arange(1, len(LEVELS) + 1) for i, mean, sd in self.levels]
        return np.hstack([np.ones((len(x), 1)), x, *marks])


def _gram(df: DataFrame, how: _Rows, known: int | None = None) -> tuple[np.ndarray, int]:
    """Sums of products of all pairs of terms, and the number of rows: Arrow batches first, then a small sum.

    ``known``: only rows in which that field was not missing.
    """
    n = 1 + len([c for c in df.columns if c.startswith("__v")]) + len(LEVELS) * len(how.levels)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros((n, n)), 0
        for b in batches:
            x, gaps = how.read(b)
            if known is not None:
                x = x[~b[f"__m{known}"].to_numpy(bool)]
            t = how.terms(x)
            total += t.T @ t
            rows += len(t)
        if rows:
            yield pd.DataFrame({"i": np.arange(n * n + 1), "v": np.append(total.ravel(), rows)})

    got = {r["i"]: r["v"] for r in df.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    return np.array([got.get(i, 0.0) for i in range(n * n)]).reshape(n, n), int(got.get(n * n, 0))


def _take(df: DataFrame, how: _Rows) -> DataFrame:
    """The rows with the steps taken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, _ = how.read(b)
            yield b.assign(**{c: x[:, i] for i, c in enumerate(b.filter(like="__v").columns)})

    return df.mapInPandas(run, df.schema)


def _levels_of(gram: np.ndarray, terms: list[int], marks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of a linear discriminant: one class per level, a covariance within classes for all.

    Everything comes from sums of products; ``marks`` are the columns that hold 1 for a row of the class. Classes without
    rows are never chosen (offset minus infinity).
    """
    n = gram[marks, marks]
    total = n.sum()
    mean = gram[np.ix_(marks, terms)] / np.maximum(n, 1)[:, None]
    within = (gram[np.ix_(terms, terms)] - (mean * n[:, None]).T @ mean) / total + RIDGE * np.eye(len(terms))
    weights = np.linalg.solve(within, mean.T).T
    offsets = np.where(n > 0, np.log(np.maximum(n, 1) / total) - (weights * mean).sum(1) / 2, -np.inf)
    return weights, offsets


@dataclass
class Filling:
    rows: DataFrame
    cells: DataFrame
    models: list[dict]


def fill(df: DataFrame, id_col: str, levels: list[str], numbers: list[str], groups: list[str], iterations: int = 3, seed: int = 4, noise: bool = True, settled: float = 0.01) -> Filling:
    """Fill missing levels and numbers from records of the same groups.

    Every incomplete field is fitted in turn on all other fields, on the means of the field within each group and on the
    other fields' means within the last group (the row's own value left out), starting from the group means, until no
    coefficient changes by more than ``settled``, at most ``iterations`` times over. A number is regressed: its filling is
    the prediction plus a normal residual of the regression's spread. A level is classified by a linear discriminant over
    the five levels: its filling is drawn with their posterior. Both are drawn by a hash of id and field, so they are the
    same on every run; without ``noise`` they are the prediction and the likeliest level.

    Missing: null, NaN and infinite numbers; levels that are none of LEVELS. A field without any value stays missing.
    Null groups have the overall mean. ``rows``: the input's columns with levels and numbers in their filled form, and
    ``<field>_was_missing`` per field; other columns, whatever their name, are unchanged, but one with the name of a mark gives way to it. ``cells``: id, level_field,
    filled, for each missing cell of ``levels``, filled or not. ``models``: step, field and rows of each fit, with the
    coefficients and spread of a regression or the weights of a classifier. Equal ids get equal draws. An empty table
    gives empty results.

    The fits are sums of products of all rows: those of complete rows, which never change, are added up once, and each
    step adds those of the incomplete ones (p*p numbers on the driver). Groups are averaged with partial aggregation and
    joined back, so a group may hold any share of the rows.
    """
    fields = [*levels, *numbers]
    x, m = (lambda f: f"__x_{f}"), (lambda f: f"__m_{f}")
    src = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(id_col).alias("__id"),
        *[(level_code(F.col(f)) if f in levels else finite(F.col(f))).alias(x(f)) for f in fields],
        *[plain(F.col(g).cast("string")).alias(f"__g{i}") for i, g in enumerate(groups)],
    )
    mean = src.agg(*[F.avg(x(f)).alias(f) for f in fields], *[F.stddev_pop(x(f)).alias("sd_" + f) for f in fields]).first()
    mean, sd = {f: mean[f] for f in fields}, {f: mean["sd_" + f] or 1.0 for f in fields}
    used = [f for f in fields if mean[f] is not None]
    state = src.select("__id", *[f"__g{i}" for i in range(len(groups))], *[F.col(x(f)) for f in fields], *[F.col(x(f)).isNull().alias(m(f)) for f in fields], "__row")
    # numbers are standardised, so one ridge fits all
    for f in used:
        state = state.withColumn(x(f), (F.col(x(f)) - mean[f]) / sd[f])
    around: dict[str, list[str]] = {f: [] for f in used}
    for i in range(len(groups) if used else 0):
        sums = state.filter(F.col(f"__g{i}").isNotNull()).groupBy(F.col(f"__g{i}").alias("__k")).agg(*[F.sum(x(f)).alias(f"__s_{f}") for f in used], *[F.count(x(f)).alias(f"__n_{f}") for f in used])
        state = state.join(sums, F.col(f"__g{i}") == F.col("__k"), "left").drop("__k")
        for f in used:
            own, has = F.coalesce(F.col(x(f)), F.lit(0.0)), F.when(F.col(m(f)), 0).otherwise(1)
            name = f"__a{i}_{f}"
            state = state.withColumn(name, F.coalesce((F.col(f"__s_{f}") - own) / (F.col(f"__n_{f}") - has + SHRINK), F.lit(0.0))).drop(f"__s_{f}", f"__n_{f}")
            around[f].append(name)
    for f in used:
        start = sum((F.col(a) for a in around[f]), F.lit(0.0)) / max(1, len(around[f]))
        state = state.withColumn(x(f), F.coalesce(F.col(x(f)), start))
    gaps = F.array_contains(F.array(*[F.col(m(f)) for f in fields]), True)
    state = cut_lineage(state.withColumn("__gaps", gaps).withColumn("__key", F.monotonically_increasing_id()))
    columns = [*[x(f) for f in used], *[a for f in used for a in around[f]]]
    place = {c: i for i, c in enumerate(columns)}
    told = [f for f in levels if f in used]
    first = 1 + len(columns)
    read = lambda steps: _Rows(len(used), [(place[x(f)], mean[f], sd[f]) for f in told], steps)
    values = [F.col(c).cast("double").alias(f"__v{i:04d}") for i, c in enumerate(columns)]
    open_ = state.filter("__gaps").select("__key", hash_key(seed, F.col("__id").cast("string")).alias("__h"), *[F.col(m(f)).alias(f"__m{i}") for i, f in enumerate(used)], *values)
    open_ = cut_lineage(open_)
    whole, whole_n = _gram(state.filter("not __gaps").select(*values), read([])) if used else (np.zeros((1, 1)), 0)
    models: list[dict] = []
    before: dict[str, np.ndarray] = {}
    for step in range(iterations if used else 0):
        moved, steps = 0.0, []
        for i, f in enumerate(used):
            # the last group's means of the other fields tell what is usual for it (a high voice, a fast speaker)
            on = [place[c] for c in [*[x(o) for o in used if o != f], *around[f], *[around[o][-1] for o in used if o != f and groups]]]
            part, part_n = _gram(open_, read(steps), i)
            gram, seen = whole + part, whole_n + part_n
            if not seen:
                continue
            if f in levels:
                weights, offsets = _levels_of(gram, [c + 1 for c in on], [first + len(LEVELS) * told.index(f) + c for c in range(len(LEVELS))])
                spread, fitted = None, {"weights": np.column_stack([offsets, weights]).tolist()}
            else:
                at = [0, *[c + 1 for c in on]]
                a, b = gram[np.ix_(at, at)] + RIDGE * seen * np.eye(len(at)), gram[at, place[x(f)] + 1]
                beta = np.linalg.solve(a, b)
                spread = math.sqrt(max(0.0, (gram[place[x(f)] + 1, place[x(f)] + 1] - beta @ b) / seen))
                weights, offsets, fitted = beta[None, 1:], beta[:1], {"spread": spread * sd[f], "coefficients": beta.tolist()}
            steps.append(_Step(place[x(f)], on, weights, offsets, spread, (mean[f], sd[f]), step, noise))
            models.append({"field": f, "step": step, "rows": seen, **fitted})
            moved = max(moved, float(np.abs(weights - before.get(f, np.inf)).max() / max(1.0, np.abs(weights).max())))
            before[f] = weights
        open_ = cut_lineage(_take(open_, read(steps)))
        if moved <= settled:
            break
    open_ = open_.select("__key", *[F.col(f"__v{place[x(f)]:04d}").alias(x(f)) for f in used])
    value = {f: F.col(x(f)) * sd[f] + F.lit(mean[f]) if f in used else F.lit(None).cast("double") for f in fields}
    names = F.array(*[F.lit(v) for v in LEVELS])
    filled = {f: F.try_element_at(names, F.round(value[f]).cast("int")) if f in levels else value[f] for f in fields}
    marks = {f"{f}_was_missing" for f in fields}
    final = [*[filled[c].alias(c) if c in fields else F.col("__row").getField(c).alias(c) for c in df.columns if c not in marks], *[F.col(m(f)).alias(f"{f}_was_missing") for f in fields]]
    again = state.filter("__gaps").select("__key", "__id", "__row", *[m(f) for f in fields]).join(open_, "__key")
    out = state.filter("not __gaps").select(*final).unionByName(again.select(*final))
    cells = again.select("__id", F.explode(F.array(*[F.struct(F.lit(f).alias("level_field"), filled[f].alias("filled"), F.col(m(f)).alias("m")) for f in levels])).alias("c")).filter("c.m")
    return Filling(out, cells.select(F.col("__id").alias(id_col), "c.level_field", "c.filled"), models)
