"""Readers and writers."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.runtime import bounded_rows, checkpoint_dir

#: Rows that a single JSON document may have; larger results are written as lines.
MAX_DOCUMENT = 1_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: str, split: str | None = None) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return df if split is None else df.withColumn("split", F.lit(split))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).json(paths)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """One record a line, null fields kept, non-ASCII text as it is."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_index(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A document {key: {column: value}} as rows of key and columns."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.explode(F.from_json("value", f"map<string,struct<{value_schema}>>")).alias("key", "v")).select("key", "v.*")


def write_json_index(df: DataFrame, path: str, key: str) -> str:
    """The opposite, for a result of at most MAX_DOCUMENT rows (checked), through the cluster's file system."""
    rows = bounded_rows(df, MAX_DOCUMENT, "a JSON document")
    doc = {r[key]: {c: r[c] for c in df.columns if c != key} for r in rows}
    df.sparkSession.createDataFrame([(json.dumps(doc, ensure_ascii=False, indent=4),)], "value string").coalesce(1).write.option("lineSep", "\x00").text(path)
    return path


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation lines: file, line_no, turn_id, start, end, emotion_code; blank and % lines are dropped."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return parse_eval(t, F.col("value")).select("file", "turn_id", "start", "end", "emotion_code")


def parse_eval(df: DataFrame, line: Column) -> DataFrame:
    """``[start - end]``, the turn, the label of three letters and a bracket of three numbers, parted by blanks or tabs.

    A line is cut at its brackets and blanks and its parts are cast; one whose parts do not fit is dropped.
    """
    d = df.withColumn("__l", F.trim(line)).filter(F.col("__l").startswith("[") & F.col("__l").endswith("]"))
    times = F.split(F.substring_index(F.substring("__l", 2, 1 << 20), "]", 1), "-")
    vad = F.transform(F.split(F.substring_index(F.substring_index("__l", "[", -1), "]", 1), ","), lambda x: F.trim(x).try_cast("double"))
    d = d.withColumn("__t", F.transform(times, lambda x: F.trim(x).try_cast("double"))).withColumn("__m", F.filter(F.split(F.substring_index(F.substring_index(F.col("__l"), "[", 2), "]", -1), r"\s+"), lambda w: w != "")).withColumn("__v", vad)
    fits = (F.size("__t") == 2) & (F.size("__m") == 2) & (F.size("__v") == 3) & F.forall("__t", lambda x: x.isNotNull()) & F.forall("__v", lambda x: x.isNotNull())
    d = d.filter(fits & (F.length(F.get("__m", 1)) == 3) & (F.lower(F.get("__m", 1)) == F.get("__m", 1)))
    return d.withColumn("turn_id", F.get("__m", 0)).withColumn("start", F.get("__t", 0)).withColumn("end", F.get("__t", 1)).withColumn("emotion_code", F.get("__m", 1)).drop("__l", "__t", "__m", "__v")


def parse_transcript(df: DataFrame, line: Column, order: str) -> DataFrame:
    """turn_id -> text of transcript lines; the last of equal turn ids wins."""
    head = F.substring_index(line, "]:", 1)
    turn, times = F.trim(F.substring_index(head, "[", 1)), F.split(F.substring_index(head, "[", -1), "-")
    fits = line.contains("]:") & head.contains("[") & (turn != "") & ~turn.contains(" ") & (F.size(times) == 2) & F.forall(times, lambda x: x.try_cast("double").isNotNull())
    d = df.filter(fits).withColumn("turn_id", turn).withColumn("text", F.regexp_replace(F.substr(line, F.length(head) + 3), r"^\s+|\s+$", ""))
    return d.groupBy("turn_id").agg(F.max_by("text", order).alias("text"))


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, modificationTime of files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def largest_artifact(files: DataFrame, path: str, prefix: str) -> DataFrame:
    """The file of a prefix (any case) with the largest size: the whole rest of the name before its ending, behind the
    last ``size``, read as a number; anything else counts as 0. Ties go to the later name."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    rest = F.when(stem.contains("size"), F.substring_index(stem, "size", -1))
    size = F.coalesce(F.when(rest.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(rest).try_cast("long")), F.lit(0))
    return files.filter(F.lower(F.element_at(F.split(path, "/"), -1)).startswith(prefix.lower())).agg(F.max_by(path, F.struct(size, path)).alias("path"))


#: Folders of the splits, and other names of the splits.
SPLIT_FOLDER = "{}_audio_splits"
SPLIT_NAMES = {"train": ["train"], "dev": ["dev", "valid", "validation", "val"], "test": ["test", "testing"]}


def wav_path(dialog: Column, turn: Column, split: Column, root: str) -> Column:
    """root/audio/<split folder>/dia<d>_utt<u>.wav; unknown splits are in the dev folder."""
    s = F.lower(F.trim(split))
    folder = F.lit(SPLIT_FOLDER.format("dev"))
    for name, spelled in SPLIT_NAMES.items():
        folder = F.when(s.isin(spelled), SPLIT_FOLDER.format(name)).otherwise(folder)
    return F.concat_ws("/", F.lit(root), F.lit("audio"), folder, F.format_string("dia%s_utt%s.wav", dialog.cast("string"), turn.cast("string")))


def wav_path_session(session: Column, dialog: Column, turn: Column, root: str) -> Column:
    return F.concat_ws("/", F.lit(root), session, F.lit("sentences/wav"), dialog, F.concat(turn, F.lit(".wav")))


def artifact_name(**parts: str | int | bool | None) -> str:
    """A readable name that holds its attributes in the given order; None is left out."""
    return "_".join(f"{k}={v}" for k, v in parts.items() if v is not None)


def merge_hints(first: DataFrame, second: DataFrame, key: str, text: str, prefix: str) -> DataFrame:
    """(key, hint) of two sources of hints with a prefix before each: the first source wins where its text is not empty,
    else the second's text stands, empty or not. Null texts are absent; equal keys of one source give its largest text."""
    one = lambda df, name: df.filter(F.col(text).isNotNull()).groupBy(key).agg(F.max(text).alias(name))
    both = one(first.filter(F.length(text) > 0), "a").join(one(second, "b"), key, "full_outer")
    return both.select(key, F.concat(F.lit(prefix), F.coalesce("a", "b")).alias("hint"))


def write_json(df: DataFrame, folder: str, name: str, stamp: str | None = None) -> str:
    """One indented document of at most MAX_DOCUMENT rows (checked), <folder>/<name>_<time>; larger results are lines."""
    from datetime import datetime

    rows = [r.asDict(True) for r in bounded_rows(df, MAX_DOCUMENT, "a JSON document")]
    path = f"{folder}/{name}_{stamp or datetime.now().strftime('%Y%m%d_%H%M%S')}"
    df.sparkSession.createDataFrame([(json.dumps(rows, ensure_ascii=False, indent=4, default=str),)], "value string").coalesce(1).write.option("lineSep", "\x00").text(path)
    return path


def replace_by_id(old: DataFrame, new: DataFrame, key: str, path: str) -> str:
    """Write a collection in which rows of ``new`` stand in place of those of ``old`` with their key."""
    old.join(new.select(key).distinct(), key, "left_anti").unionByName(new).write.parquet(path)
    return path


def mp4_to_wav(jobs: DataFrame, program: Sequence[str] = ("ffmpeg",)) -> DataFrame:
    """(src, dst, rc) of converting each listed file to mono 16 kHz by a program; rc 127 where it is missing."""
    import pandas as pd

    def run(batches):
        import subprocess

        for b in batches:
            out = []
            for s, d in zip(b["src"], b["dst"]):
                try:
                    os.makedirs(os.path.dirname(d), exist_ok=True)
                    out.append(subprocess.run([*program, "-y", "-i", s, "-ac", "1", "-ar", "16000", d], capture_output=True).returncode)
                except OSError:
                    out.append(127)
            yield pd.DataFrame({"src": b["src"], "dst": b["dst"], "rc": out})

    return jobs.select("src", "dst").mapInPandas(run, "src string, dst string, rc int")
