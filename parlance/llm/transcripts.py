"""Problem 3: speech transcripts into ordered, clean turns of cast members."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.runtime import bounded_rows, cut_lineage, outer_trim

#: A cast is a bounded table.
MAX_CAST = 10_000
#: Bins that count the characters of a label.
BINS = 32
#: Hesitation sounds; a line of nothing else is left out.
_HESITATION = r"(?:u+h+m*|u+m+|e+r+m*|e+h+m*|a+h+|h+m+|m+h*m+|h+u+h+|m+|hem|ahem)"
#: Fillers that are dropped from spoken text where commas set them off.
_FILLER = r"(?:you know|i mean|like|sort of|kind of|so to speak)"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?"
_MARK = rf"(?:[\[(<{{]\s*(?:t\s*=\s*)?(?:{_CLOCK}|\d+(?:[.,]\d+)?)\s*s?\s*[\])>}}]|{_CLOCK}\s*(?:[-–—|]\s*|(?=\s)))"
_NOTE = r"\(\([^()]*\)\)|\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\}|<[^<>]*>|\*[^*\n]*\*|♪[^♪\n]*♪|[♪♫]+"


def _start_in_text(text: Column) -> Column:
    """Seconds stated by the first time mark of a text, else null."""
    mark = F.regexp_extract(text, rf"({_MARK})", 1)
    clock = F.regexp_extract(mark, rf"({_CLOCK})", 1)
    part = F.split(F.regexp_replace(clock, ",", "."), ":")
    seconds = F.aggregate(part, F.lit(0.0), lambda acc, x: acc * 60 + F.coalesce(x.try_cast("double"), F.lit(0.0)))
    plain_s = F.regexp_replace(F.regexp_extract(mark, r"(\d+(?:[.,]\d+)?)", 1), ",", ".").try_cast("double")
    return F.when(clock != "", seconds).otherwise(plain_s)


def _label_pattern(names: list[str]) -> str:
    """A leading speaker label: a cast name (any case, either order, with initial) and a colon."""
    return r"(?i)^\s*((?:speaker\s+)?(?:" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + r")(?:\s*\([^()]*\))?)\s*:\s*"


def norm_label(label: str) -> str:
    """Lower case, without notes in brackets, colons and the word speaker; "Last, First" turned round."""
    s = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", label).strip().strip(":").strip()
    s = re.sub(r"(?i)^speaker\b[\s:#-]*", "", s)
    if s.count(",") == 1:
        a, b = (x.strip() for x in s.split(","))
        if a and b:
            s = f"{b} {a}"
    return re.sub(r"[^\w.' -]+", " ", re.sub(r"\s+", " ", s)).strip().lower()


def _places(a: str) -> dict[str, int]:
    """The places of every character as bits."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    return at


def similarity(a: str, b: str, at: dict[str, int] | None = None) -> float:
    """1 - restricted Damerau-Levenshtein distance over the longer length; a column of the table is one integer.

    ``at``: the places of ``a``, if it is compared with many.
    """
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    at = _places(a) if at is None else at
    every, last = (1 << n) - 1, 1 << n - 1
    up, down, zero, before, d = every, 0, 0, 0, n
    for c in b:
        here = at.get(c, 0)
        swapped = ((~zero & here) << 1) & before
        zero = ((((here & up) + up) ^ up) | here | down | swapped) & every
        right, left = (down | ~(zero | up)) & every, zero & up
        d += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & every, left << 1 & every
        up, down, before = left | ~(zero | right) & every, right & zero, here
    return 1 - d / max(n, m)


class Near:
    """Labels that may be similar (0.7 or more) to a label, lengths within 3; none that is gets lost.

    A distance of d changes at most d characters of either label's bag, so labels are compared by counts in BINS first.
    """

    def __init__(self, labels: list[str]):
        self.rank = sorted(range(len(labels)), key=lambda i: len(labels[i]))
        self.lengths = [len(labels[i]) for i in self.rank]
        self.bags = np.stack([self._bag(labels[i]) for i in self.rank]) if labels else np.zeros((0, BINS), "int8")
        self.order, self.sizes = np.array(self.rank, "int64"), np.array(self.lengths, "int64")

    @staticmethod
    def _bag(label: str) -> np.ndarray:
        return np.minimum(np.bincount([ord(c) % BINS for c in label], minlength=BINS), 100).astype("int8")

    def before(self, label: str, end: int) -> list[int]:
        """Numbers below ``end`` of such labels."""
        n = len(label)
        lo, hi = bisect_left(self.lengths, n - 3), bisect_right(self.lengths, n + 3)
        sizes = self.sizes[lo:hi]
        apart = np.abs(self.bags[lo:hi] - self._bag(label)).sum(1, dtype="int32")
        ok = (apart + np.abs(sizes - n) <= 2 * (3 * np.maximum(sizes, n) // 10)) & (self.order[lo:hi] < end)
        return self.order[lo:hi][ok].tolist()


class Cast:
    """Exact and near look-up of labels among cast members (first names and full names)."""

    def __init__(self, members: list[tuple[str, str]]):
        self.exact: dict[str, set[str]] = {}
        for name, full in members:
            first, *rest = (full or name).lower().split()
            last = rest[-1] if rest else ""
            keys = {name.lower(), (full or name).lower(), last, f"{first[:1]}. {last}" if last else "", f"{first[:1]} {last}" if last else "", f"{first} {last[:1]}." if last else ""}
            for k in keys - {""}:
                self.exact.setdefault(k, set()).add(name)
        self.seen: dict[str, str | None] = {}

    def sure(self, label: str) -> str | None:
        got = self.exact.get(label)
        return next(iter(got)) if got and len(got) == 1 else None

    def near(self, label: str, least: float = 0.7) -> str | None:
        """The one member with the most similar key, if similar enough and not tied with another member's."""
        if label not in self.seen:
            best: dict[str, float] = {}
            for k, names in self.exact.items():
                if abs(len(k) - len(label)) <= 3 and (s := similarity(label, k)) >= least:
                    for n in names:
                        best[n] = max(best.get(n, 0), s)
            top = sorted(best.items(), key=lambda x: -x[1])[:2]
            got = top[0][0] if top and (len(top) == 1 or top[0][1] > top[1][1]) else None
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[label] = got
        return self.seen[label]


def cluster(labels: list[str], cast: Cast) -> dict[str, str | None]:
    """Canonical speakers of one transcript's labels (normalised) by union-find.

    Labels are joined if one is the other with an initial for the first name, or if they are similar; labels that mean
    two different members for certain are never joined. A cluster takes its certain member, else the nearest one. Any
    number of labels is clustered; each is compared with those that ``Near`` leaves.
    """
    todo = sorted(set(labels))
    root = {x: x for x in todo}
    sure = {x: cast.sure(x) for x in todo}

    def find(x: str) -> str:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(a: str, b: str) -> None:
        a, b = find(a), find(b)
        if a != b and not (sure[a] and sure[b] and sure[a] != sure[b]):
            keep, gone = (a, b) if sure[a] or not sure[b] else (b, a)
            root[gone] = keep

    by_member: dict[str, str] = {}
    for x in todo:
        if sure[x]:
            join(by_member.setdefault(sure[x], x), x)
    open_ = [x for x in todo if not sure[x]]
    initial: dict[tuple[str, str], str] = {}
    for x in todo:
        parts = x.replace(".", " ").split()
        if len(parts) >= 2:
            k = (parts[0][:1], parts[-1])
            join(initial.setdefault(k, x), x)
    # certain labels and the open ones so far
    certain = [x for x in todo if sure[x]]
    every = certain + open_
    near = Near(every)
    for i, x in enumerate(open_):
        at = _places(x)
        rivals = [(similarity(x, every[j], at), every[j]) for j in near.before(x, len(certain) + i)]
        best = max(rivals, default=(0.0, ""))
        if best[0] >= 0.7 and len({sure[find(y)] for s, y in rivals if s == best[0]} - {None}) <= 1:
            join(x, best[1])
    return {x: sure[find(x)] or cast.near(find(x)) or cast.near(x) for x in todo}


@dataclass
class Turns:
    turns: DataFrame
    lines: DataFrame


def rebuild(df: DataFrame, cast: DataFrame, line_id: str, dialog: str, speaker: str, start: str, end: str, text: str) -> Turns:
    """Clean, ordered speaker turns of transcripts.

    ``cast``: name, full_name (bounded by MAX_CAST rows). Redelivered lines (equal but for the id) count once, as the
    smallest id. Time marks, sound and stage notes, leading speaker labels and hesitation sounds are removed from the
    text; a line without a spoken word is left out, so is one with a null text. The speaker is that of the label, or if
    it is null or blank, of the label leading the text; a label that means no member keeps its normalised form, and a
    line without any label joins no other speaker (null). The start is the smaller of start and end (exchanged times);
    if it is missing (null or NaN), the time stated in the text, else the end. Lines without any time come last. Ties go
    by line id. Lines with a null dialogue form a dialogue of their own. An empty table gives no turns.

    A turn is a longest run of lines of one speaker: ``turns`` has dialogue, first_line_id, speaker, turn_no, lines,
    start, end and text. Labels are clustered per transcript (distinct labels only). Runs are found in slices of about equal
    numbers of lines, ranges in the order of lines, and joined across slices: a transcript that holds most lines, timed
    or not, is ordered by many tasks. The text of one turn is one value.
    """
    members = [(r[0], r[1] or r[0]) for r in bounded_rows(cast.select("name", "full_name").filter("name is not null"), MAX_CAST, "the cast")]
    names = sorted({x for n, f in members for x in (n, f, f.split()[-1], f"{f[:1]}. {f.split()[-1]}", f"{f.split()[-1]}, {f.split()[0]}")}) or ["\x00"]
    lead = _label_pattern(names)
    num = lambda c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double"))
    src = df.select(F.coalesce(F.col(dialog).cast("string"), F.lit("")).alias("d"), F.col(line_id).cast("long").alias("i"), F.col(speaker).cast("string").alias("sp"), num(start).alias("s"), num(end).alias("e"), F.col(text).cast("string").alias("x"))
    src = src.groupBy("d", "sp", "s", "e", "x").agg(F.min("i").alias("i")).filter("x is not null")
    # labels and time marks stand at the front in either order
    bare, said = F.col("x"), F.lit("")
    for _ in range(3):
        bare = F.regexp_replace(bare, rf"^\s*{_MARK}\s*", "")
        said = F.when(said != "", said).otherwise(F.regexp_extract(bare, lead, 1))
        bare = F.regexp_replace(bare, lead, "")
    src = src.withColumn("y", bare).withColumn("said", said)
    y = F.col("y")
    for _ in range(2):
        y = F.regexp_replace(y, _NOTE, " ")
    y = F.regexp_replace(y, rf"(?:^|\s){_CLOCK}(?=\s|$)", " ")
    words = F.regexp_replace(y, rf"(?i)(?<![\p{{L}}\p{{N}}'’]){_HESITATION}(?![\p{{L}}\p{{N}}'’])(?:\.\.\.|…|,)?", " ")
    src = src.withColumn("z", words).filter(F.col("z").rlike(r"[\p{L}\p{N}]"))
    tidy = F.regexp_replace("z", rf"(?i)(?:(?<=,)|^)\s*{_FILLER}\s*,", " ")
    tidy = F.regexp_replace(tidy, r"(?i)\b([\p{L}'’ ]+?)--\s*(\1)\b", "$2")
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(tidy, r"\s+", " "), r"\s+([,.!?;:])", "$1"), r"^[\s,;:–-]+|[\s|–—-]+$", "")
    src = src.withColumn("z", outer_trim(tidy))
    label = F.coalesce(F.nullif(outer_trim(F.col("sp")), F.lit("")), F.nullif(F.col("said"), F.lit("")))
    times = F.coalesce(F.least("s", "e"), F.lit(None).cast("double"))
    at = F.when(F.col("s").isNotNull() & F.col("e").isNotNull(), times).otherwise(F.coalesce("s", _start_in_text(F.col("x")), "e"))
    src = cut_lineage(src.select("d", "i", label.alias("lab"), at.alias("t"), F.greatest("s", "e").alias("t2"), "z", _norm(label).alias("n")))
    who = _speakers(src.select("d", "n").filter("n is not null").distinct(), members)
    src = src.join(who, ["d", "n"], "left").withColumn("w", F.coalesce("member", "n"))
    # slices of about equal size, whatever the dialogues and times are like: ranges of (dialogue, time, line)
    keys = [F.col("d"), F.col("t").isNull(), F.col("t"), F.col("i")]
    src = cut_lineage(src.repartitionByRange(*keys).withColumn("b", F.spark_partition_id()))
    order = [F.col("t").asc_nulls_last(), F.col("i")]
    w = Window.partitionBy("d", "b").orderBy(*order)
    ends = src.groupBy("d", "b").agg(F.max_by(F.struct("w"), F.struct(F.col("t").isNull(), "t", "i")).alias("z"))
    last = ends.select("d", "b", F.lag(F.col("z")).over(Window.partitionBy("d").orderBy("b")).alias("prev"))
    inner = src.join(last, ["d", "b"]).withColumn("p", F.coalesce(F.lag(F.struct("w")).over(w), F.col("prev")))
    new = F.col("p").isNull() | ~F.col("p.w").eqNullSafe(F.col("w")) | F.col("w").isNull()
    runs = inner.withColumn("new", new.cast("int")).withColumn("k", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = runs.groupBy("d", "b").agg(F.sum("new").alias("c"))
    before = per.select("d", "b", F.coalesce(F.sum("c").over(Window.partitionBy("d").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("c0"))
    lines = cut_lineage(runs.join(before, ["d", "b"]).select("d", "i", (F.col("k") + F.col("c0") - 1).alias("turn_no"), "w", "t", "t2", "z"))
    first = F.min_by("i", F.struct(F.col("t").isNull(), "t", "i"))
    said_all = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("t").isNull().alias("a"), "t", "i", "z"))), lambda r: r["z"]), " ")
    turns = lines.groupBy("d", "turn_no", "w").agg(first.alias("first_line_id"), F.count(F.lit(1)).alias("lines"), F.min("t").alias("start_sec"), F.max("t2").alias("end_sec"), said_all.alias("text"))
    turns = turns.select(F.col("d").alias(dialog), "turn_no", "first_line_id", F.col("w").alias("speaker"), "lines", "start_sec", "end_sec", "text")
    return Turns(turns, lines.select(F.col("d").alias(dialog), F.col("i").alias(line_id), "turn_no", F.col("w").alias("speaker"), F.col("t").alias("start_sec"), F.col("z").alias("text")))


def _norm(label: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: norm_label(x) or None if isinstance(x, str) else None)

    return run(label)


def _speakers(labels: DataFrame, members: list[tuple[str, str]]) -> DataFrame:
    """(d, n, member) by clustering the labels of each transcript; partitions are clustered by transcript."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cast = Cast(members)
        held: str | None = None
        group: list[str] = []

        def done() -> pd.DataFrame:
            found = cluster(group, cast)
            return pd.DataFrame({"d": held, "n": list(found), "member": list(found.values())})

        for b in batches:
            out = []
            for d, n in zip(b["d"], b["n"]):
                if d != held:
                    if group:
                        out.append(done())
                    held, group = d, []
                group.append(n)
            if out:
                yield pd.concat(out)
        if group:
            yield done()

    return labels.repartition("d").sortWithinPartitions("d").mapInPandas(run, "d string, n string, member string")
