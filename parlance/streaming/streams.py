"""Streaming forms: an extension; the reference has batch entry points only.

* turns with their history, by a state of the last k lines per dialogue (as a stream for any sink, or written as files),
* binning with thresholds fitted in batch (stream-static join),
* event counts in windows with a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.operators import binning


def read_stream(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema they have now."""
    static = spark.read.parquet(path)
    files = static.inputFiles()
    reader = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", files_a_trigger)
    if len(files) == 1 and files[0].rstrip("/").endswith("/" + path.rstrip("/").rsplit("/", 1)[-1]):
        # a single file: its folder is watched for this name
        folder, name = path.rstrip("/").rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def history_stream(turns: DataFrame, dialog: str, turn: str, line: Column, k: int) -> DataFrame:
    """(dialog, turn, history): each turn with up to k lines of the dialogue that arrived before it.

    The state of a dialogue is bounded by k lines. Turns of one trigger are ordered by turn number; a turn that arrives
    after a later one has the lines that were there. Empty lines count; null lines read as empty.
    """
    src = turns.select(F.col(dialog).cast("string").alias("dialog"), F.col(turn).cast("long").alias("turn"), F.coalesce(line, F.lit("")).alias("line"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list[str] = list(state.get[0]) if state.exists else []
        # plain lists: a dialogue has few turns, for which sorting and building frames costs more than the work
        rows = sorted(((t, x) for b in batches for t, x in zip(b["turn"].tolist(), b["line"].tolist())), key=_place)
        turns_, texts = [], []
        for t, x in rows:
            turns_.append(t)
            texts.append("\n".join([*held[-k:], x] if k else [x]).strip("\n"))
            held = [*held, x][-k:] if k else []
        state.update((held,))
        yield pd.DataFrame({"dialog": [key[0]] * len(rows), "turn": turns_, "history": texts}, copy=False)

    return src.groupBy("dialog").applyInPandasWithState(step, "dialog string, turn long, history string", "held array<string>", "append", GroupStateTimeout.NoTimeout)


def write_history(turns: DataFrame, dialog: str, turn: str, line: Column, k: int, path: str, checkpoint: str) -> str:
    """The rows of ``history_stream`` as a folder of Parquet files; every trigger is joins and windows, none calls Python.

    A trigger writes its rows to its own folder, and with the last row of a dialogue the up to k lines that later turns
    need: rows and state are committed together, and a trigger that runs again replaces its folder. A trigger looks up its
    dialogues among those of earlier triggers by name and reads the lines of these only, those of their latest trigger.
    """
    src = turns.select(F.col(dialog).cast("string").alias("dialog"), F.col(turn).cast("long").alias("turn"), F.coalesce(line, F.lit("")).alias("line"))
    spark = turns.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    own = Window.partitionBy("dialog").orderBy("place", F.asc_nulls_last("turn"), "line")

    def write(batch: DataFrame, no: int) -> None:
        rows = batch.withColumn("place", F.lit(k))
        if no:
            known = batch.sparkSession.read.schema("dialog string, held array<string>, last boolean, trigger long").parquet(path).filter(F.col("last") & (F.col("trigger") < no))
            names = batch.select(F.col("dialog").alias("name")).distinct()
            latest = known.join(names, F.col("dialog").eqNullSafe(F.col("name")), "left_semi").groupBy(F.col("dialog").alias("name")).agg(F.max("trigger").alias("at"))
            held = known.join(latest, F.col("dialog").eqNullSafe(F.col("name")) & (F.col("trigger") == F.col("at")))
            rows = rows.unionByName(held.select("dialog", F.lit(None).cast("long").alias("turn"), F.posexplode("held").alias("place", "line")))
        rows = rows.withColumn("lines", F.collect_list("line").over(own.rowsBetween(-k, 0))).withColumn("last", F.lead(F.lit(1)).over(own).isNull()).filter(F.col("place") == k)
        held = F.when(F.col("last"), F.slice("lines", F.greatest(F.size("lines") - k + 1, F.lit(1)), F.lit(k)))
        rows = rows.select("dialog", "turn", F.btrim(F.array_join("lines", "\n"), F.lit("\n")).alias("history"), held.alias("held"), "last")
        rows.write.mode("overwrite").parquet(f"{path}/trigger={no}")

    src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return path


def _place(row: tuple[float, str]) -> tuple[bool, float, str]:
    """By turn, those without one last, then by line."""
    turn, line = row
    return (True, 0, line) if turn != turn else (False, turn, line)


def bin_stream(stream: DataFrame, value: str, group: Column, cuts: DataFrame, names: list[str], out: str) -> DataFrame:
    """Levels by thresholds per group; ``cuts(grp, q)`` is a handful of rows fitted in batch, of known size."""
    j = stream.withColumn("__k", group).join(cuts, F.col("__k") == F.col("grp"), "left")
    return j.withColumn(out, binning.digitize(F.col(value), F.col("q"), names)).drop("__k", "grp", "q")


def window_counts(events: DataFrame, ts: str, kind: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts per kind in tumbling or sliding windows; rows later than the watermark are dropped by design."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w, kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key that end after ``gap`` of silence."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> str:
    """Process what is there and stop; the result is a folder of Parquet files, exactly once by the checkpoint."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return path
