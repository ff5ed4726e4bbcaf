"""Registered queries of the text operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import answers, conversations, encoding, endings, mixing, overlap, packing, sampling, tokens, transcripts
from parlance.runtime import bounded_rows, cut_lineage, plain, read_table

Query = Callable[[SparkSession, str], DataFrame]


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return answers.find(read_table(spark, sf, "parallel_character_extraction"), read_table(spark, sf, "speaker_chars"), "iden", "inputs", "ann_id", "output", docs, "text", "lang", "doc_id")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).filter("defect is not null").select("ann_id", "defect")


def p1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf)


def _repair(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.find(read_table(spark, sf, "meld_erc_init"), "row_id", "utterance").rows


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _repair(spark, sf).filter("garbled").select("row_id")


def p2_restored(spark: SparkSession, sf: str) -> DataFrame:
    return _repair(spark, sf)


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.rebuild(read_table(spark, sf, "transcript_line"), read_table(spark, sf, "cast_member"), "line_id", "dialog_id", "speaker", "start_sec", "end_sec", "utterance").turns


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("dialog_id", "first_line_id", "speaker")


def p3_turns(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf)


def _overlaps(spark: SparkSession, sf: str) -> overlap.Overlaps:
    return overlap.find(read_table(spark, sf, "utterance"), "row_id", "split", "utterance")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.row_pairs(_overlaps(spark, sf)).select("row_id_a", "row_id_b")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per split and source of the evaluation rows: rows, rows that overlap with train, exact ones, mean containment."""
    o = _overlaps(spark, sf)
    per = o.links.groupBy("e_id", "e_check").agg(F.min("distance").alias("nearest"), F.max("containment").alias("containment"))
    u = read_table(spark, sf, "utterance").select(F.col("row_id").alias("id"), plain(F.col("source")).alias("source"))
    rows = o.rows.filter(~F.col("is_train")).select("id", "split", F.col("text_id").alias("e_id"), F.col("check").alias("e_check")).join(u.hint("merge"), "id").join(per.hint("merge"), ["e_id", "e_check"], "left")
    return rows.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("long_rows"), F.count("nearest").alias("overlapping"), F.count_if(F.col("nearest") == 0).alias("exact"), F.round(F.avg("containment"), 6).alias("mean_containment"),
    )


def _conversations(spark: SparkSession, sf: str) -> conversations.Conversations:
    return conversations.rebuild(read_table(spark, sf, "utterance"), "dialog_id", "turn_idx", "speaker", "utterance", "row_id", "loaded_at")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _conversations(spark, sf).status.filter("defect is not null").select("dialog_id", "defect")


def p6_conversations(spark: SparkSession, sf: str) -> DataFrame:
    c = _conversations(spark, sf)
    sound = c.status.filter("defect is null").select("dialog_id", "alternates")
    return c.messages.join(sound, "dialog_id")


def _sample(spark: SparkSession, sf: str) -> sampling.Sample:
    u = read_table(spark, sf, "utterance").select("row_id", "dialog_id", "split", "source", "mapped_emotion", "utterance")
    return sampling.draw(u, read_table(spark, sf, "sample_target"), "row_id", "split", "mapped_emotion")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _sample(spark, sf).report.filter("short").select("split", "mapped_emotion")


def p7_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _sample(spark, sf).rows


def p7_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What the sample of each split holds: rows, and rows of a label that the split's sample should not hold (none)."""
    s = _sample(spark, sf)
    listed = read_table(spark, sf, "sample_target").select(plain(F.col("split")).alias("split"), plain(F.col("mapped_emotion")).alias("label"), F.lit(1).alias("listed"))
    rows = s.rows.select(plain(F.col("split")).alias("split"), plain(F.col("mapped_emotion")).alias("label"), "row_id").join(listed, ["split", "label"], "left")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("row_id").alias("different"), F.count_if(F.col("listed").isNull()).alias("unlisted"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return _sample(spark, sf).report.select("split", "mapped_emotion", "available", F.round("wanted", 6).alias("wanted"), "short")


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's tokens, counted once."""
    d = read_table(spark, sf, "documents")
    return cut_lineage(d.select("doc_id", "source", tokens.count_tokens(F.col("text")).alias("n_tokens")))


def _packing(spark: SparkSession, sf: str) -> packing.Packing:
    spec = bounded_rows(read_table(spark, sf, "container_spec"), 1, "the container specification")
    return packing.pack(_sizes(spark, sf), "doc_id", "n_tokens", spec[0]["capacity_tokens"])


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _packing(spark, sf).over_capacity.select("doc_id")


def p8_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _packing(spark, sf).pieces


def p8_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What the windows hold: documents with text, documents in one piece, cut ones; windows over capacity or with a gap
    or an overlap, pieces missing or out of place, and windows with room for another window's content (none of each)."""
    spec = bounded_rows(read_table(spark, sf, "container_spec"), 1, "the container specification")[0]["capacity_tokens"]
    p = _packing(spark, sf).pieces.filter("container is not null")
    docs = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), (F.max("piece") + 1).alias("last"), F.sum("length").alias("size"), F.max(F.col("start") + F.col("length")).alias("end"))
    boxes = p.groupBy("container").agg(F.sum("length").alias("fill"), F.max(F.col("offset") + F.col("length")).alias("top"), F.count_distinct("offset").alias("places"), F.count(F.lit(1)).alias("n"))
    d = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") == 1).alias("whole"), F.count_if(F.col("n") > 1).alias("cut"), F.count_if((F.col("n") != F.col("last")) | (F.col("size") != F.col("end"))).alias("torn"))
    b = boxes.agg(F.count_if((F.col("top") > spec) | (F.col("top") != F.col("fill")) | (F.col("places") != F.col("n"))).alias("bad_windows"), (F.count_if(F.col("fill") * 2 <= spec) > 1).alias("two_half_empty"))
    return d.crossJoin(b)  # one row each


def _mix(spark: SparkSession, sf: str) -> mixing.Mix:
    return mixing.mix(_sizes(spark, sf), read_table(spark, sf, "mix_target"), "doc_id", "source", "n_tokens")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report.filter("unreachable").select("source")


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).rows


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report


def p9_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: whether a document is used too often, unequally (by more than once), or of another source; and whether
    a source that can reach its share is short of it by more than a hundredth."""
    m = _mix(spark, sf)
    limits = read_table(spark, sf, "mix_target").select("source", "max_uses")
    uses = m.rows.groupBy(plain(F.col("source")).alias("k"), "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("use_no").alias("d"))
    per = uses.groupBy("k").agg(F.max("n").alias("most"), F.max(F.col("n") != F.col("d")).alias("twice"))
    r = m.report.select("source", "unreachable", (F.col("used_tokens") < F.col("budget_tokens") * 0.99).alias("short"))
    out = r.join(limits, "source").join(per, plain(F.col("source")) == F.col("k"), "left")
    return out.select("source", "unreachable", (F.coalesce("most", F.lit(0)) <= F.col("max_uses")).alias("within"), F.coalesce("twice", F.lit(False)).alias("twice"), "short")


def _cut(spark: SparkSession, sf: str) -> endings.Truncation:
    return endings.detect(read_table(spark, sf, "documents"), "doc_id", "text", "lang", "source")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _cut(spark, sf).flags.filter("cut").select("doc_id")


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return _cut(spark, sf).report


def queries() -> dict[str, Query]:
    found = [p1_found, p1_pairs, p2_found, p2_restored, p3_found, p3_turns, p5_found, p5_report, p6_found, p6_conversations, p7_found, p7_sample, p7_totals, p7_report, p8_found, p8_windows, p8_totals, p9_found, p9_mix, p9_totals, p9_report, p10_found, p10_rates]
    return {f.__name__: f for f in found}


_SAYS = r"regexp_matches(regexp_replace(coalesce(utterance, ''), '\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\}|<[^<>]*>', ' ', 'g'), '[\p{L}\p{N}]')"
_BLANK = r"E' \t\n\r'"
_SAMPLE_SQL = f"""
WITH u AS (SELECT trim(lower(split), {_BLANK}) s, trim(lower(mapped_emotion), {_BLANK}) l FROM utterance),
c AS (SELECT t.split, t.mapped_emotion, t.target_share, t.min_rows, t.sample_frac, count(u.s) n FROM sample_target t
      LEFT JOIN u ON u.s = lower(t.split) AND u.l = lower(t.mapped_emotion) GROUP BY ALL),
w AS (SELECT *, target_share * sample_frac * sum(n) OVER (PARTITION BY split) AS wanted FROM c)
"""


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express; the others are tested against brute force or held-out cases.

    Token counts have no SQL form; p8 and p9 state that no case lies near the limit, so characters stand for tokens.
    """
    return {
        "p6_found": f"""
WITH s AS (SELECT dialog_id d, turn_idx t, nullif(trim(lower(speaker), {_BLANK}), '') w, trim(lower(utterance), {_BLANK}) x, {_SAYS} says FROM utterance),
t AS (SELECT d, t, count(DISTINCT (coalesce(w, ''), coalesce(x, '~'))) n, bool_or(says AND w IS NULL) mute FROM s GROUP BY d, t),
c AS (SELECT d, bool_or(t IS NULL OR n > 1 OR mute) OR count(t) <> max(t) + 1 broken FROM t GROUP BY d),
v AS (SELECT d, bool_or(says) says, count(DISTINCT CASE WHEN says THEN w END) voices FROM s GROUP BY d)
SELECT d AS dialog_id, CASE WHEN NOT says THEN 'empty' WHEN broken THEN 'broken' ELSE 'no_reply' END AS defect
FROM c JOIN v USING (d) WHERE NOT says OR broken OR voices < 2""",
        "p6_conversations": f"""
WITH s AS (SELECT dialog_id d, turn_idx t, nullif(trim(speaker, {_BLANK}), '') who, lower(nullif(trim(speaker, {_BLANK}), '')) w, trim(lower(utterance), {_BLANK}) x, utterance, row_id, loaded_at, {_SAYS} says FROM utterance),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY d, t, w, x ORDER BY loaded_at, row_id) = 1),
t AS (SELECT d, t, count(*) n, bool_or(says AND w IS NULL) mute FROM m GROUP BY d, t),
c AS (SELECT d FROM t GROUP BY d HAVING NOT bool_or(t IS NULL OR n > 1 OR mute) AND count(t) = max(t) + 1),
v AS (SELECT d FROM s GROUP BY d HAVING bool_or(says) AND count(DISTINCT CASE WHEN says THEN w END) > 1),
a AS (SELECT x.d FROM m x JOIN m y ON y.d = x.d AND y.t = x.t - 1 AND y.w = x.w GROUP BY 1)
SELECT d AS dialog_id, t AS position, t AS turn_idx, who AS speaker, utterance, row_id, d NOT IN (SELECT d FROM a) AS alternates FROM m WHERE d IN (SELECT d FROM c) AND d IN (SELECT d FROM v)""",
        "p7_totals": _SAMPLE_SQL + "SELECT split, greatest(round(max(sample_frac) * sum(n)), sum(least(min_rows, n)))::BIGINT AS rows, greatest(round(max(sample_frac) * sum(n)), sum(least(min_rows, n)))::BIGINT AS different, 0::BIGINT AS unlisted FROM w GROUP BY split HAVING sum(n) > 0",
        "p8_totals": "WITH d AS (SELECT length(text) > 4.7 * capacity_tokens AS cut FROM documents, container_spec WHERE text <> '') SELECT count(*) AS documents, count_if(NOT cut) AS whole, count_if(cut) AS cut, 0::BIGINT AS torn, 0::BIGINT AS bad_windows, false AS two_half_empty FROM d",
        "p9_totals": f"""
WITH d AS (SELECT trim(lower(source), {_BLANK}) s, sum(length(text)) n FROM documents WHERE trim(source, {_BLANK}) <> '' GROUP BY 1)
SELECT m.source, m.target_weight * (SELECT sum(n) FROM d) > m.max_uses * coalesce(d.n, 0) AS unreachable, true AS within, false AS twice, false AS short FROM mix_target m LEFT JOIN d ON d.s = lower(m.source)""",
        "p7_found": _SAMPLE_SQL + "SELECT split, mapped_emotion FROM w WHERE n < wanted",
        "p7_report": _SAMPLE_SQL + "SELECT split, mapped_emotion, n AS available, round(wanted, 6) AS wanted, n < wanted AS short FROM w",
        "p8_found": "SELECT doc_id FROM documents, container_spec WHERE length(text) > 4.7 * capacity_tokens",
        "p9_found": f"""
WITH d AS (SELECT trim(lower(source), {_BLANK}) s, sum(length(text)) n FROM documents WHERE trim(source, {_BLANK}) <> '' GROUP BY 1)
SELECT m.source FROM mix_target m LEFT JOIN d ON d.s = lower(m.source)
WHERE m.target_weight * (SELECT sum(n) FROM d) > m.max_uses * coalesce(d.n, 0)""",
    }
