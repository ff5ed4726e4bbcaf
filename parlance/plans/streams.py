"""Streaming queries: each runs its stream over the whole table once and returns what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import binning
from parlance.plans.base import query
from parlance.plans.relational import _BY, _pitch_cuts
from parlance.sources.io import scratch
from parlance.streaming import streams as S


@query("stream_window_counts")
def stream_window_counts(s, sf):
    """Closed windows only: the last ones wait for the watermark."""
    e = S.read_stream(s, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    p = S.run_once(S.window_counts(e, "ts", "event_type", "1 hour", "10 minutes"), scratch(s, "stream"), scratch(s, "stream-ck"))
    return s.read.schema("start timestamp, end timestamp, event_type string, n long").parquet(p)


@query("stream_bins", _BY + "SELECT row_id, CASE WHEN NOT isfinite(pitch_mean_hz) THEN NULL WHEN pitch_mean_hz < lo THEN 'low' WHEN pitch_mean_hz < hi THEN 'medium' WHEN pitch_mean_hz >= hi THEN 'high' END AS bin FROM utterance u JOIN q ON q.grp = CASE WHEN gender IN ('F', 'M') THEN gender ELSE 'ALL' END")
def stream_bins(s, sf):
    u = S.read_stream(s, f"{sf}/utterance.parquet")
    g = F.when(F.col("gender").isin("F", "M"), F.col("gender")).otherwise("ALL")
    b = S.bin_stream(u, "pitch_mean_hz", g, _pitch_cuts(s, sf), binning.NAMES[3], "bin").select("row_id", "bin")
    return s.read.schema("row_id long, bin string").parquet(S.run_once(b, scratch(s, "stream"), scratch(s, "stream-ck")))


@query("stream_history")
def stream_history(s, sf):
    t = S.read_stream(s, f"{sf}/utterance.parquet").filter("turn_idx is not null")
    p = S.write_history(t, "dialog_id", "turn_idx", F.concat_ws(": ", "speaker", "utterance"), 20, scratch(s, "stream"), scratch(s, "stream-ck"))
    return s.read.schema("dialog string, turn long, history string, trigger long").parquet(p).drop("trigger")
