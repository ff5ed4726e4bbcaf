"""Ordered-dialogue operators over the whole utterance table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions import labels as L
from parlance.functions import text as X
from parlance.operators import dialogue as D
from parlance.plans.base import T, query, turns
from parlance.runtime import read_table

def _line():
    return F.concat(F.col("speaker"), F.lit(": "), F.col("utterance"))


_NL = "chr(10)"


def _lines_sql(k: int, line: str = "speaker || ': ' || utterance", table: str = "t", order: str = "turn_idx") -> str:
    return f"array_to_string(list({line}) OVER (PARTITION BY dialog_id ORDER BY {order} ROWS BETWEEN {k} PRECEDING AND CURRENT ROW), {_NL})"


@query("win_factorize", "WITH f AS (SELECT split, dialog_id, min(row_id) first FROM utterance GROUP BY 1, 2), n AS (SELECT split, dialog_id, row_number() OVER (ORDER BY first) - 1 AS group_idx FROM f) SELECT row_id, group_idx FROM utterance JOIN n USING (split, dialog_id)")
def win_factorize(s, sf):
    return D.factorize(read_table(s, sf, "utterance").select("row_id", "split", "dialog_id"), ["split", "dialog_id"], F.col("row_id")).select("row_id", "group_idx")


@query("win_cumcount", "SELECT row_id, row_number() OVER (PARTITION BY split, dialog_id ORDER BY row_id) - 1 AS pos FROM utterance")
def win_cumcount(s, sf):
    return D.position(read_table(s, sf, "utterance"), ["split", "dialog_id"], ["row_id"]).select("row_id", "pos")


@query("win_turn_order", "SELECT line_id, row_number() OVER (PARTITION BY dialog_id ORDER BY CASE WHEN NOT isnan(start_sec) THEN start_sec END NULLS LAST, CASE WHEN NOT isnan(end_sec) THEN end_sec END NULLS LAST, line_id) - 1 AS pos FROM transcript_line")
def win_turn_order(s, sf):
    """All lines: a missing start (null or NaN) comes after every start, a missing end after every end, ties by line id."""
    t = read_table(s, sf, "transcript_line").select("line_id", "dialog_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("start_sec", "end_sec")])
    return D.position(t, ["dialog_id"], [F.col("start_sec").asc_nulls_last(), F.col("end_sec").asc_nulls_last(), "line_id"]).select("line_id", "pos")


_DENSE = "WITH d AS (SELECT DISTINCT coalesce(session, '') session, dialog_id FROM utterance), n AS (SELECT session, dialog_id, row_number() OVER (ORDER BY session, dialog_id) - 1 AS no FROM d) "


def _dialogs(s, sf):
    d = read_table(s, sf, "utterance").select(F.coalesce("session", F.lit("")).alias("session"), "dialog_id").distinct()
    return D.rank_distinct(d, [F.col("session"), F.col("dialog_id")], "no")


@query("win_dense_dialog", _DENSE + "SELECT session, dialog_id, no FROM n")
def win_dense_dialog(s, sf):
    return _dialogs(s, sf).select("session", "dialog_id", "no")


@query("join_dialog_index", _DENSE + "SELECT row_id, no FROM utterance u JOIN n ON n.dialog_id = u.dialog_id AND n.session = coalesce(u.session, '')")
def join_dialog_index(s, sf):
    u = read_table(s, sf, "utterance").select("row_id", F.coalesce("session", F.lit("")).alias("session"), "dialog_id")
    return u.join(_dialogs(s, sf), ["session", "dialog_id"]).select("row_id", "no")


_FIRST = "WITH d AS (SELECT DISTINCT session, dialog_id FROM utterance WHERE source = 'iemocap'), r AS (SELECT session, dialog_id, row_number() OVER (ORDER BY session, dialog_id) - 1 AS no FROM d WHERE session <> 'Session5') "


def _first_n(s, sf):
    d = read_table(s, sf, "utterance").filter(F.col("source") == "iemocap").select("session", "dialog_id").distinct()
    return d, D.rank_distinct(d.filter(F.col("session") != "Session5"), [F.col("session"), F.col("dialog_id")], "no")


@query("win_first_n_split", _FIRST + "SELECT session, dialog_id, CASE WHEN no < 108 THEN 'train' ELSE 'dev' END AS part FROM r")
def win_first_n_split(s, sf):
    return _first_n(s, sf)[1].select("session", "dialog_id", F.when(F.col("no") < 108, "train").otherwise("dev").alias("part"))


@query("join_split_assign", _FIRST + "SELECT d.session, d.dialog_id, CASE WHEN d.session = 'Session5' THEN 'test' WHEN r.no < 108 THEN 'train' ELSE 'dev' END AS part FROM d LEFT JOIN r ON r.session = d.session AND r.dialog_id = d.dialog_id")
def join_split_assign(s, sf):
    d, r = _first_n(s, sf)
    part = F.when(F.col("session") == "Session5", "test").when(F.col("no") < 108, "train").otherwise("dev")
    return d.join(r, ["session", "dialog_id"], "left").select("session", "dialog_id", part.alias("part"))


@query("win_ngroup", T + "SELECT row_id, dense_rank() OVER (PARTITION BY split, dialog_id ORDER BY speaker) - 1 AS speaker_no FROM t")
def win_ngroup(s, sf):
    return D.ngroup(turns(s, sf), ["split", "dialog_id"], "speaker", "speaker_no").select("row_id", "speaker_no")


_ALIAS = ", f AS (SELECT *, min(turn_idx) OVER (PARTITION BY dialog_id, speaker) f FROM t), n AS (SELECT *, dense_rank() OVER (PARTITION BY dialog_id ORDER BY f, speaker) - 1 AS no FROM f) "


@query("win_speaker_alias", T + _ALIAS + "SELECT row_id, 'Speaker_' || no AS digits, 'Speaker_' || chr((no + 65)::INT) AS letters FROM n")
def win_speaker_alias(s, sf):
    t = D.aliases(turns(s, sf), ["dialog_id"], "speaker", "turn_idx", out="digits")
    return D.aliases(t, ["dialog_id"], "speaker", "turn_idx", True, "letters").select("row_id", "digits", "letters")


@query("join_speaker_alias", T + _ALIAS + "SELECT DISTINCT dialog_id, speaker, 'Speaker_' || no AS alias FROM n")
def join_speaker_alias(s, sf):
    return D.cast_of(turns(s, sf), ["dialog_id"], "speaker", "turn_idx").select("dialog_id", F.inline("cast").alias("speaker", "alias"))


@query("win_history", T + "SELECT row_id, trim(" + _lines_sql(20) + f", {_NL}) AS history FROM t")
def win_history(s, sf):
    return turns(s, sf).select("row_id", D.history(["dialog_id"], "turn_idx", _line(), 20).alias("history"))


@query("win_history_k3", T + "SELECT row_id, trim(" + _lines_sql(3) + f", {_NL}) AS history FROM t")
def win_history_k3(s, sf):
    return turns(s, sf).select("row_id", D.history(["dialog_id"], "turn_idx", _line(), 3).alias("history"))


@query("agg_collect_lines", T + f"SELECT dialog_id, string_agg(speaker || ': ' || utterance, {_NL} ORDER BY turn_idx) AS lines FROM t GROUP BY dialog_id")
def agg_collect_lines(s, sf):
    g = turns(s, sf).groupBy("dialog_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", _line().alias("line")))).alias("a"))
    return g.select("dialog_id", F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("lines"))


#: Turns with a usable label, in their new positions, speakers by alias.
_KNOWN = T + ", k AS (SELECT *, row_number() OVER (PARTITION BY dialog_id ORDER BY turn_idx) - 1 AS pos FROM t WHERE label <> 'unknown'), f AS (SELECT *, min(pos) OVER (PARTITION BY dialog_id, speaker) f FROM k), n AS (SELECT *, 'Speaker_' || (dense_rank() OVER (PARTITION BY dialog_id ORDER BY f, speaker) - 1) AS alias FROM f) "
_IDS = "CASE label " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(L.MAPPED)) + " END"


def _known(s, sf):
    k = D.position(turns(s, sf).filter(F.col("label") != "unknown"), ["dialog_id"], ["turn_idx"])
    return D.aliases(k, ["dialog_id"], "speaker", "pos")


def _alias_line():
    return F.concat(F.col("alias"), F.lit(": "), F.col("utterance"))



@query("win_reposition", _KNOWN + "SELECT row_id, pos FROM k")
def win_reposition(s, sf):
    return _known(s, sf).select("row_id", "pos")


@query("win_flow_doc", _KNOWN + ", d AS (SELECT row_id, pos, " + _lines_sql(6, "alias || ': ' || utterance", "n", "pos") + " AS doc FROM n) SELECT row_id, doc FROM d WHERE pos + 1 > 3")
def win_flow_doc(s, sf):
    d = _known(s, sf).withColumn("doc", D.lines(["dialog_id"], "pos", _alias_line(), 6))
    return d.filter("pos + 1 > 3").select("row_id", "doc")


@query("win_hybrid_doc", _KNOWN + ", d AS (SELECT row_id, pos, " + _lines_sql(6, "alias || ': ' || utterance", "n", "pos") + " || chr(10) || chr(10) || 'The target utterance is: ' || alias || ': ' || utterance AS doc FROM n) SELECT row_id, doc FROM d WHERE pos + 1 > 3")
def win_hybrid_doc(s, sf):
    d = _known(s, sf).withColumn("doc", F.concat(D.lines(["dialog_id"], "pos", _alias_line(), 6), D.hybrid_tail(_alias_line())))
    return d.filter("pos + 1 > 3").select("row_id", "doc")


@query("win_emotion_flow", _KNOWN + f"SELECT row_id, '[' || array_to_string(list({_IDS}) OVER (PARTITION BY dialog_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), ', ') || ']' AS flow FROM k")
def win_emotion_flow(s, sf):
    flow = D.label_flow(["dialog_id"], "pos", L.label_id(F.col("label")), 7)
    return _known(s, sf).select("row_id", D.flow_text(flow).alias("flow"))


@query("win_query_doc", T + "SELECT row_id, utterance AS single, " + _lines_sql(4) + " AS flow, " + _lines_sql(4) + " || chr(10) || chr(10) || 'The target utterance is: ' || speaker || ': ' || utterance AS hybrid FROM t")
def win_query_doc(s, sf):
    """The same builders over raw, unfiltered turns."""
    flow = D.lines(["dialog_id"], "turn_idx", _line(), 4)
    return turns(s, sf).select("row_id", F.col("utterance").alias("single"), flow.alias("flow"), F.concat(flow, D.hybrid_tail(_line())).alias("hybrid"))


@query("win_demo_frame", T + "SELECT idx, " + _lines_sql(6, "speaker || ' : ' || utterance || ' :-> ' || label") + " AS demo FROM t")
def win_demo_frame(s, sf):
    line = F.concat(F.col("speaker"), F.lit(" : "), F.col("utterance"), F.lit(" :-> "), F.col("label"))
    return turns(s, sf).select("idx", D.lines(["dialog_id"], "turn_idx", line, 6).alias("demo"))


@query("join_demo_range", T + f"SELECT a.idx, string_agg(b.speaker || ' : ' || b.utterance, {_NL} ORDER BY b.turn_idx) AS demo FROM t a JOIN t b ON b.dialog_id = a.dialog_id AND b.turn_idx BETWEEN greatest(0, a.turn_idx + 1 - 7) AND a.turn_idx GROUP BY a.idx")
def join_demo_range(s, sf):
    """Range self-join as an equi-join: every turn offers itself to the seven targets it can belong to."""
    t = turns(s, sf).select("dialog_id", "turn_idx", "idx", F.concat(F.col("speaker"), F.lit(" : "), F.col("utterance")).alias("line"))
    offered = t.select("dialog_id", F.explode(F.sequence(F.col("turn_idx"), F.col("turn_idx") + 6)).alias("at"), F.col("turn_idx").alias("from"), "line")
    j = t.select("dialog_id", F.col("turn_idx").alias("at"), "idx").join(offered, ["dialog_id", "at"])
    g = j.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("from", "line"))).alias("a"))
    return g.select("idx", F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("demo"))


@query("win_batch_id", T + "SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // 16 AS batch FROM t")
def win_batch_id(s, sf):
    """Batches of a fixed size over the whole table, in the order of rows."""
    n = D.running(turns(s, sf).select("row_id"), [F.col("row_id")], {"n": F.lit(1)})
    return n.select("row_id", F.floor((F.col("n") - 1) / 16).cast("long").alias("batch"))


@query("win_running_accuracy", T + "SELECT row_id, round(avg((label = 'neutral')::INT::DOUBLE) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING), 6) AS so_far FROM t")
def win_running_accuracy(s, sf):
    """Over all rows so far, in the order of rows."""
    r = D.running(turns(s, sf).select("row_id", "label"), [F.col("row_id")], {"n": F.lit(1), "hits": (F.col("label") == "neutral").cast("int")})
    return r.select("row_id", F.round(F.col("hits") / F.col("n"), 6).alias("so_far"))


@query("win_last_wins", "SELECT dialog_id, turn_idx, arg_max(row_id, row_id) AS last_row FROM utterance WHERE turn_idx IS NOT NULL GROUP BY 1, 2")
def win_last_wins(s, sf):
    return read_table(s, sf, "utterance").filter("turn_idx is not null").groupBy("dialog_id", "turn_idx").agg(F.max_by("row_id", "row_id").alias("last_row"))


@query("win_frame_diff", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS step FROM events")
def win_frame_diff(s, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read_table(s, sf, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("step"))


_PEAK = """WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events),
l AS (SELECT *, lag(value) OVER w a, lead(value) OVER w b FROM o WINDOW w AS (PARTITION BY user_id ORDER BY n)),
p AS (SELECT user_id, n, value, lead(n) OVER (PARTITION BY user_id ORDER BY n) nx FROM l WHERE value > a AND value > b),
d AS (SELECT p.user_id, p.n, p.value - min(o.value) drop FROM p JOIN o ON o.user_id = p.user_id AND o.n > p.n AND o.n < p.nx GROUP BY p.user_id, p.n, p.value)
SELECT user_id, count(*) AS peaks FROM d WHERE drop > 2 GROUP BY user_id"""


@query("win_peak_dip", _PEAK)
def win_peak_dip(s, sf):
    """Peaks whose signal falls by more than 2 before the next peak: lead and a minimum per stretch between peaks."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read_table(s, sf, "events").select("user_id", "value", "ts", "event_id", F.lag("value").over(w).alias("a"), F.lead("value").over(w).alias("b"))
    e = e.withColumn("peak", F.coalesce((F.col("value") > F.col("a")) & (F.col("value") > F.col("b")), F.lit(False)))
    e = e.withColumn("no", F.sum(F.col("peak").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("no > 0")
    per = e.groupBy("user_id", "no").agg(F.max(F.when(F.col("peak"), F.col("value"))).alias("top"), F.min(F.when(~F.col("peak"), F.col("value"))).alias("dip"))
    last = Window.partitionBy("user_id").orderBy(F.desc("no"))
    return per.withColumn("r", F.row_number().over(last)).filter("r > 1 and top - dip > 2").groupBy("user_id").agg(F.count(F.lit(1)).alias("peaks"))


@query("str_anonymize")
def str_anonymize(s, sf):
    """Names in texts give way to aliases, in the order of first appearance; checked by hand-made cases."""
    t = turns(s, sf)
    c = D.cast_of(t, ["dialog_id"], "speaker", "turn_idx")
    return t.join(c, "dialog_id").select("row_id", X.anonymize(F.col("utterance"), F.col("cast")).alias("utterance"))
