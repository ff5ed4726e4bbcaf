"""Projections, filters, joins, aggregations, sorts and set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions import labels as L
from parlance.operators import binning, metrics
from parlance.operators.impute import finite
from parlance.plans.base import SQL, T, query, turns
from parlance.runtime import bounded_rows, read_table
from parlance.sources.io import require_columns

# --- projections and predicates


@query("project_rename", "SELECT row_id AS id, speaker AS who, CAST(turn_idx AS VARCHAR) AS turn FROM utterance")
def project_rename(s, sf):
    return read_table(s, sf, "utterance").select(F.col("row_id").alias("id"), F.col("speaker").alias("who"), F.col("turn_idx").cast("string").alias("turn"))


@query("require_columns", "SELECT count(*) AS n FROM utterance")
def require_columns_(s, sf):
    return require_columns(read_table(s, sf, "utterance"), ["split", "dialog_id", "turn_idx", "speaker", "emotion", "utterance"]).agg(F.count(F.lit(1)).alias("n"))


@query("cast_coerce", "SELECT row_id, coalesce(TRY_CAST(turn_id AS BIGINT), -1) AS turn_no FROM utterance")
def cast_coerce(s, sf):
    return read_table(s, sf, "utterance").select("row_id", F.coalesce(F.col("turn_id").try_cast("bigint"), F.lit(-1)).alias("turn_no"))


@query("finite_only", "SELECT row_id, pitch_mean_hz FROM utterance WHERE isfinite(pitch_mean_hz)")
def finite_only(s, sf):
    return read_table(s, sf, "utterance").filter(finite(F.col("pitch_mean_hz")).isNotNull()).select("row_id", "pitch_mean_hz")


@query("lit_column", "SELECT row_id, 'utterance' AS origin, true AS kept FROM utterance")
def lit_column(s, sf):
    return read_table(s, sf, "utterance").select("row_id", F.lit("utterance").alias("origin"), F.lit(True).alias("kept"))


@query("filter_eq", "SELECT row_id FROM utterance WHERE split = 'train'")
def filter_eq(s, sf):
    return read_table(s, sf, "utterance").filter(F.col("split") == "train").select("row_id")


@query("filter_in", "SELECT row_id, split FROM utterance WHERE split IN ('dev', 'test')")
def filter_in(s, sf):
    return read_table(s, sf, "utterance").filter(F.col("split").isin("dev", "test")).select("row_id", "split")


@query("filter_ne_and", "SELECT row_id FROM utterance WHERE mapped_emotion IS DISTINCT FROM 'unknown' AND split = 'train'")
def filter_ne_and(s, sf):
    return read_table(s, sf, "utterance").filter(~F.col("mapped_emotion").eqNullSafe("unknown") & (F.col("split") == "train")).select("row_id")


@query("filter_flag_after_context", T + ", w AS (SELECT row_id, erc_target, count(*) OVER (PARTITION BY dialog_id ORDER BY turn_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS lines FROM t) SELECT row_id, lines FROM w WHERE erc_target")
def filter_flag_after_context(s, sf):
    """Non-target turns are context but not results: the window comes before the filter."""
    w = Window.partitionBy("dialog_id").orderBy("turn_idx").rowsBetween(-2, 0)
    return turns(s, sf).withColumn("lines", F.count(F.lit(1)).over(w)).filter("erc_target").select("row_id", "lines")


@query("filter_min_context", T + ", w AS (SELECT row_id, row_number() OVER (PARTITION BY dialog_id ORDER BY turn_idx) - 1 AS pos FROM t) SELECT row_id, pos FROM w WHERE pos + 1 > 3")
def filter_min_context(s, sf, m=7):
    pos = (F.row_number().over(Window.partitionBy("dialog_id").orderBy("turn_idx")) - 1).cast("long")
    return turns(s, sf).withColumn("pos", pos).filter(F.col("pos") + 1 > m // 2).select("row_id", "pos")


@query("filter_complete_case", "SELECT row_id FROM utterance WHERE speaker IS NOT NULL AND utterance IS NOT NULL AND intensity_level IS NOT NULL AND pitch_level IS NOT NULL AND rate_level IS NOT NULL")
def filter_complete_case(s, sf):
    return read_table(s, sf, "utterance").na.drop("any", subset=["speaker", "utterance", "intensity_level", "pitch_level", "rate_level"]).select("row_id")


@query("fill_default", "SELECT row_id, coalesce(intensity_level, 'medium') AS intensity_level, coalesce(pitch_level, 'medium') AS pitch_level, coalesce(rate_level, 'medium') AS rate_level FROM utterance")
def fill_default(s, sf):
    cols = ["intensity_level", "pitch_level", "rate_level"]
    return read_table(s, sf, "utterance").select("row_id", *cols).na.fill("medium", cols)


@query("filter_regex_line", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, line FROM l WHERE regexp_matches(line, '^[A-Z]+: ')")
def filter_regex_line(s, sf):
    d = read_table(s, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return d.filter(F.col("line").rlike("^[A-Z]+: "))


@query("filter_comment", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS lines FROM l WHERE trim(line) <> '' AND NOT starts_with(line, '%') AND NOT starts_with(line, '***') GROUP BY doc_id")
def filter_comment(s, sf):
    d = read_table(s, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return d.filter((F.trim("line") != "") & ~F.col("line").startswith("%") & ~F.col("line").startswith("***")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


@query("filter_nonempty", "SELECT ann_id FROM speaker_chars WHERE length(output) > 0")
def filter_nonempty(s, sf):
    return read_table(s, sf, "speaker_chars").filter(F.length("output") > 0).select("ann_id")


_KNOWN = ", ".join(f"'{x}'" for x in [*L.MAPPED, "unknown"])


@query("assert_domain", T + f"SELECT count(*) FILTER (WHERE label NOT IN ({_KNOWN})) AS outside, count(*) AS n FROM t")
def assert_domain(s, sf):
    return turns(s, sf).agg(F.count_if(~F.col("label").isin([*L.MAPPED, "unknown"])).alias("outside"), F.count(F.lit(1)).alias("n"))


@query("assert_contiguous", T + "SELECT dialog_id, max(turn_idx) + 1 - count(*) AS gaps FROM t GROUP BY dialog_id HAVING max(turn_idx) + 1 <> count(*)")
def assert_contiguous(s, sf):
    g = turns(s, sf).groupBy("dialog_id").agg((F.max("turn_idx") + 1 - F.count(F.lit(1))).alias("gaps"))
    return g.filter("gaps <> 0")


@query("assert_coverage", "SELECT (SELECT count(*) FROM parallel_character_extraction) AS prompts, count(DISTINCT iden) AS answered FROM speaker_chars")
def assert_coverage(s, sf):
    p = read_table(s, sf, "parallel_character_extraction").agg(F.count(F.lit(1)).alias("prompts"))
    return p.crossJoin(read_table(s, sf, "speaker_chars").agg(F.count_distinct("iden").alias("answered")))  # one row each


@query("drop_struct_field", "SELECT iden, inputs.history || '|' || inputs.utterance || '|' || inputs.speaker_id AS kept FROM parallel_character_extraction")
def drop_struct_field(s, sf):
    d = read_table(s, sf, "parallel_character_extraction").withColumn("inputs", F.col("inputs").dropFields("audio_features"))
    return d.select("iden", F.concat_ws("|", "inputs.history", "inputs.utterance", "inputs.speaker_id").alias("kept"))


@query("add_struct_field", f"SELECT iden, inputs.utterance AS utterance, '{', '.join(L.MELD)}' AS candidate_emotions FROM parallel_character_extraction")
def add_struct_field(s, sf):
    d = read_table(s, sf, "parallel_character_extraction").withColumn("input", F.col("inputs").withField("candidate_emotions", F.lit(", ".join(L.MELD))))
    return d.select("iden", "input.utterance", "input.candidate_emotions")


# --- joins


@query("join_transcript", "SELECT p.iden, coalesce(max(s.output), '') AS text FROM parallel_character_extraction p LEFT JOIN speaker_chars s USING (iden) GROUP BY p.iden")
def join_transcript(s, sf):
    """Left join with a default; last of several texts by order of the text itself."""
    a = read_table(s, sf, "speaker_chars").groupBy("iden").agg(F.max("output").alias("output"))
    return read_table(s, sf, "parallel_character_extraction").join(a, "iden", "left").select("iden", F.coalesce("output", F.lit("")).alias("text"))


@query("join_gender_dim", "SELECT u.row_id, coalesce(c.gender, 'U') AS g FROM utterance u LEFT JOIN cast_member c ON trim(u.speaker) = c.name")
def join_gender_dim(s, sf):
    """Names of the dimension are unique; it is small by nature, and Spark broadcasts it by its size."""
    c = read_table(s, sf, "cast_member").select("name", F.col("gender").alias("cg"))
    u = read_table(s, sf, "utterance").select("row_id", F.trim("speaker").alias("k"))
    return u.join(c, F.col("k") == F.col("name"), "left").select("row_id", F.coalesce("cg", F.lit("U")).alias("g"))


_MAP_SQL = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.RAW_TO_MAPPED.items()) + " END"
_CODE_SQL = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.CODES.items()) + " ELSE {c} END"


@query("join_label_map", "SELECT row_id, " + _MAP_SQL.format(c="emotion") + " AS mapped, " + _CODE_SQL.format(c="emotion_code") + " AS named FROM utterance")
def join_label_map(s, sf):
    code = F.col("emotion_code")
    return read_table(s, sf, "utterance").select("row_id", L.lookup(L.RAW_TO_MAPPED, F.col("emotion")).alias("mapped"), L.lookup(L.CODES, code, code).alias("named"))


@query("join_audio_left", "SELECT u.row_id, p.inputs.audio_features AS audio FROM utterance u LEFT JOIN parallel_character_extraction p ON u.idx = p.iden")
def join_audio_left(s, sf):
    p = read_table(s, sf, "parallel_character_extraction").select("iden", F.col("inputs.audio_features").alias("audio"))
    return read_table(s, sf, "utterance").select("row_id", "idx").join(p, F.col("idx") == F.col("iden"), "left").select("row_id", "audio")


@query("join_audio_strict", "SELECT s.ann_id, p.inputs.utterance AS utterance FROM speaker_chars s JOIN parallel_character_extraction p USING (iden)")
def join_audio_strict(s, sf):
    """Every left row must match; one without partner fails the query."""
    p = read_table(s, sf, "parallel_character_extraction").select("iden", F.col("inputs.utterance").alias("utterance"), F.lit(True).alias("hit"))
    j = read_table(s, sf, "speaker_chars").select("ann_id", "iden").join(p, "iden", "left")
    sure = F.when(F.col("hit"), F.col("utterance")).otherwise(F.raise_error(F.concat(F.lit("no partner for "), F.col("iden"))).cast("string"))
    return j.select("ann_id", sure.alias("utterance"))


@query("join_prefer_override", "SELECT c.c_custkey, coalesce(o.k, -c.c_custkey) AS chosen FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderkey) k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def join_prefer_override(s, sf):
    o = read_table(s, sf, "orders").filter(F.col("o_orderstatus") == "F").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    return read_table(s, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("k", -F.col("c_custkey")).alias("chosen"))


@query("join_semi_complete", "SELECT s.ann_id FROM speaker_chars s WHERE s.iden IN (SELECT idx FROM utterance WHERE idx IS NOT NULL AND speaker IS NOT NULL AND utterance IS NOT NULL AND pitch_level IS NOT NULL)")
def join_semi_complete(s, sf):
    ok = read_table(s, sf, "utterance").select("idx", "speaker", "utterance", "pitch_level").na.drop("any")
    return read_table(s, sf, "speaker_chars").join(ok, F.col("iden") == F.col("idx"), "left_semi").select("ann_id")


@query("join_anti_uncached", "SELECT p.iden FROM parallel_character_extraction p WHERE NOT EXISTS (SELECT 1 FROM speaker_chars s WHERE s.iden = p.iden)")
def join_anti_uncached(s, sf):
    return read_table(s, sf, "parallel_character_extraction").join(read_table(s, sf, "speaker_chars"), "iden", "left_anti").select("iden")


_TWO = "WITH a AS (SELECT iden, max(output) o FROM speaker_chars WHERE annotator = 'annotator-a' GROUP BY 1), b AS (SELECT iden, max(output) o FROM speaker_chars WHERE annotator = 'annotator-b' AND length(output) > 0 GROUP BY 1) "


@query("join_override_merge", _TWO + f"SELECT coalesce(a.iden, b.iden) AS iden, '{L.HINT_PREFIX['default']}' || coalesce(nullif(b.o, ''), a.o) AS hint FROM a FULL JOIN b ON a.iden = b.iden")
def join_override_merge(s, sf):
    """Union of two answers' maps; a non-empty value of the second one wins."""
    x = read_table(s, sf, "speaker_chars")
    a = x.filter(F.col("annotator") == "annotator-a").groupBy("iden").agg(F.max("output").alias("a"))
    b = x.filter((F.col("annotator") == "annotator-b") & (F.length("output") > 0)).groupBy("iden").agg(F.max("output").alias("b"))
    return a.join(b, "iden", "full_outer").select("iden", F.concat(F.lit(L.HINT_PREFIX["default"]), F.coalesce(F.nullif("b", F.lit("")), "a")).alias("hint"))


@query("join_cross_sweep", "SELECT r_name, lang FROM region, (SELECT DISTINCT trim(lower(lang)) lang FROM documents WHERE lang IS NOT NULL)")
def join_cross_sweep(s, sf):
    """Two short lists of settings; their product is the sweep."""
    langs = read_table(s, sf, "documents").filter("lang is not null").select(F.trim(F.lower("lang")).alias("lang")).distinct()
    few = s.createDataFrame([(r["lang"],) for r in bounded_rows(langs, 1_000, "the list of languages")], "lang string")
    return read_table(s, sf, "region").select("r_name").crossJoin(few)


@query("zip_columns", "SELECT iden, emo || '=' || split AS pair FROM parallel_character_extraction")
def zip_columns(s, sf):
    z = read_table(s, sf, "parallel_character_extraction").select("iden", F.struct("emo", "split").alias("z"))
    return z.select("iden", F.concat_ws("=", "z.emo", "z.split").alias("pair"))


# --- aggregations


@query("agg_quantile", "SELECT quantile_cont(v, 0.3) AS q30, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.7) AS q70 FROM (SELECT intensity_mean_db v FROM utterance WHERE split = 'train' AND isfinite(intensity_mean_db))")
def agg_quantile(s, sf):
    q = binning.quantiles(read_table(s, sf, "utterance").filter(F.col("split") == "train"), "intensity_mean_db", [0.3, 0.5, 0.7])
    return q.select(F.col("q")[0].alias("q30"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q70"))


_BY = "WITH v AS (SELECT gender g, pitch_mean_hz v FROM utterance WHERE split = 'train' AND isfinite(pitch_mean_hz)), q AS (SELECT g grp, quantile_cont(v, 0.3) lo, quantile_cont(v, 0.7) hi FROM v WHERE g IN ('F', 'M') GROUP BY 1 UNION ALL SELECT 'ALL', quantile_cont(v, 0.3), quantile_cont(v, 0.7) FROM v) "


def _pitch_cuts(s, sf):
    return binning.quantiles_by(read_table(s, sf, "utterance").filter(F.col("split") == "train"), "pitch_mean_hz", "gender", [0.3, 0.7], ["F", "M"])


@query("agg_quantile_by_group", _BY + "SELECT grp, lo, hi FROM q")
def agg_quantile_by_group(s, sf):
    return _pitch_cuts(s, sf).select("grp", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


@query("num_digitize", _BY + "SELECT row_id, CASE WHEN NOT isfinite(pitch_mean_hz) THEN NULL WHEN pitch_mean_hz < lo THEN 'low' WHEN pitch_mean_hz < hi THEN 'medium' WHEN pitch_mean_hz >= hi THEN 'high' END AS bin FROM utterance u JOIN q ON q.grp = CASE WHEN gender IN ('F', 'M') THEN gender ELSE 'ALL' END")
def num_digitize(s, sf):
    """Grouped cuts of the training rows, applied to all rows; the three threshold rows are known to be small, so the planner broadcasts them."""
    u = read_table(s, sf, "utterance").withColumn("k", F.when(F.col("gender").isin("F", "M"), F.col("gender")).otherwise("ALL"))
    j = u.join(_pitch_cuts(s, sf), F.col("k") == F.col("grp"))
    return j.select("row_id", binning.digitize(F.col("pitch_mean_hz"), F.col("q"), binning.NAMES[3]).alias("bin"))


@query("agg_value_counts", T + "SELECT label, count(*) AS n FROM t GROUP BY label")
def agg_value_counts(s, sf):
    return turns(s, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("agg_nunique", "SELECT count(DISTINCT dialog_id) AS dialogs, count(DISTINCT speaker) AS speakers FROM utterance")
def agg_nunique(s, sf):
    return read_table(s, sf, "utterance").agg(F.count_distinct("dialog_id").alias("dialogs"), F.count_distinct("speaker").alias("speakers"))


@query("agg_distinct", "SELECT emotion, min(row_id) AS first_row FROM utterance GROUP BY emotion")
def agg_distinct(s, sf):
    """Distinct values with the place of their first appearance."""
    return read_table(s, sf, "utterance").groupBy("emotion").agg(F.min("row_id").alias("first_row"))


@query("agg_dedup_pairs", "SELECT DISTINCT session, dialog_id FROM utterance WHERE source = 'iemocap'")
def agg_dedup_pairs(s, sf):
    return read_table(s, sf, "utterance").filter(F.col("source") == "iemocap").select("session", "dialog_id").dropDuplicates().orderBy("session", "dialog_id")


@query("agg_null_count_row", "SELECT row_id, (speaker IS NULL)::INT + (utterance IS NULL)::INT + (pitch_level IS NULL)::INT + (turn_idx IS NULL)::INT AS nulls FROM utterance")
def agg_null_count_row(s, sf):
    cols = ["speaker", "utterance", "pitch_level", "turn_idx"]
    return read_table(s, sf, "utterance").select("row_id", sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)).alias("nulls"))


@query("agg_split_sizes", "SELECT split, count(*) AS n FROM utterance GROUP BY split")
def agg_split_sizes(s, sf):
    return read_table(s, sf, "utterance").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("agg_argmax", "SELECT event_type, arg_max(event_id, ts) AS newest FROM (SELECT event_type, event_id, (epoch_us(ts)::HUGEINT * 1000000000 + event_id) ts FROM events) GROUP BY event_type")
def agg_argmax(s, sf):
    return read_table(s, sf, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))


_PRED = ", p AS (SELECT label y, CASE WHEN length(utterance) % 3 = 0 THEN 'neutral' ELSE label END p FROM t) "


def _predicted(s, sf):
    return turns(s, sf).select(F.col("label").alias("y"), F.when(F.length("utterance") % 3 == 0, "neutral").otherwise(F.col("label")).alias("p"))


@query("agg_accuracy", T + _PRED + "SELECT round(avg((y = p)::INT::DOUBLE), 4) AS accuracy FROM p")
def agg_accuracy(s, sf):
    return metrics.accuracy(_predicted(s, sf), "y", "p")


@query("agg_f1_weighted", T + _PRED + """, l AS (SELECT label, sum(sup) sup, sum(pre) pre, sum(hit) hit FROM (
 SELECT y label, 1 sup, 0 pre, (y = p)::INT hit FROM p UNION ALL SELECT p, 0, 1, 0 FROM p) GROUP BY label)
 SELECT round(sum(CASE WHEN sup + pre = 0 THEN 0 ELSE 2.0::DOUBLE * hit / (sup + pre) END * sup) / sum(sup), 4) AS f1_weighted FROM l""")
def agg_f1_weighted(s, sf):
    return metrics.f1_weighted(_predicted(s, sf), "y", "p")


@query("agg_confusion", T + _PRED + "SELECT y, p, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM p GROUP BY y, p")
def agg_confusion(s, sf):
    return metrics.confusion(_predicted(s, sf), "y", "p")


@query("agg_dataset_stats", T + "SELECT source, count(DISTINCT dialog_id) AS dialogs, count(*) AS utterances, count(DISTINCT label) AS classes, round(avg(len(list_filter(regexp_split_to_array(utterance, '\\s+'), lambda w: w <> ''))), 6) AS words, round(count(*)::DOUBLE / count(DISTINCT dialog_id), 6) AS turns FROM t GROUP BY source")
def agg_dataset_stats(s, sf):
    w = F.size(F.filter(F.split("utterance", r"\s+"), lambda x: x != ""))
    return turns(s, sf).groupBy("source").agg(
        F.count_distinct("dialog_id").alias("dialogs"), F.count(F.lit(1)).alias("utterances"), F.count_distinct("label").alias("classes"),
        F.round(F.avg(w), 6).alias("words"), F.round(F.count(F.lit(1)) / F.count_distinct("dialog_id"), 6).alias("turns"),
    )


@query("agg_frame_stats", "SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(max(value) - min(value), 6) AS spread, round(median(value), 6) AS mid, round(10 * log10(avg(pow(10, value / 1000))), 6) AS energy FROM events GROUP BY user_id")
def agg_frame_stats(s, sf):
    """Mean, population deviation, range, median and energy mean of a signal per key."""
    v = F.col("value")
    return read_table(s, sf, "events").groupBy("user_id").agg(
        F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("sd"), F.round(F.max(v) - F.min(v), 6).alias("spread"),
        F.round(F.median(v), 6).alias("mid"), F.round(10 * F.log10(F.avg(F.pow(F.lit(10.0), v / 1000))), 6).alias("energy"),
    )


_WORDS = ", w AS (SELECT row_id, list_filter(regexp_split_to_array(lower(utterance), '\\s+'), lambda x: x <> '') a, dialog_id, turn_idx FROM t), pr AS (SELECT x.row_id, x.a p, y.a r FROM w x JOIN w y ON y.dialog_id = x.dialog_id AND y.turn_idx = x.turn_idx - 1) "


def _consecutive(s, sf):
    t = turns(s, sf).select("row_id", "dialog_id", "turn_idx", F.filter(F.split(F.lower("utterance"), r"\s+"), lambda x: x != "").alias("p"))
    before = t.select("dialog_id", (F.col("turn_idx") + 1).alias("turn_idx"), F.col("p").alias("r"))
    return t.join(before, ["dialog_id", "turn_idx"])


def _grams_sql(n: int) -> str:
    g = " || ' ' || ".join(f"{{a}}[i{f' + {k}' if k else ''}]" for k in range(n))
    return f"list_transform(range(1, len({{a}}) - {n - 2}), lambda i: {g})" if n > 1 else "{a}"


def _hits_sql(n: int) -> str:
    return f"""g{n} AS (SELECT row_id, unnest({_grams_sql(n).format(a='p')}) g, 1 a, 0 b FROM pr UNION ALL SELECT row_id, unnest({_grams_sql(n).format(a='r')}), 0, 1 FROM pr),
 h{n} AS (SELECT row_id, sum(least(a, b)) h, sum(a) ta, sum(b) tb FROM (SELECT row_id, g, sum(a) a, sum(b) b FROM g{n} GROUP BY 1, 2) GROUP BY 1)"""


@query("agg_rouge", T + _WORDS + ", " + _hits_sql(1) + ", " + _hits_sql(2) + """ SELECT count(*) AS pairs,
 round(sum(coalesce(2.0::DOUBLE * h1.h / (h1.ta + h1.tb), 0)) / count(*), 6) AS rouge1, round(sum(coalesce(2.0::DOUBLE * h2.h / (h2.ta + h2.tb), 0)) / count(*), 6) AS rouge2
 FROM pr LEFT JOIN h1 USING (row_id) LEFT JOIN h2 USING (row_id)""")
def agg_rouge(s, sf):
    g = _consecutive(s, sf).select(metrics.shared_ngrams(F.col("p"), F.col("r"), 2).alias("g"))
    return g.agg(F.count(F.lit(1)).alias("pairs"), *[F.round(F.avg(metrics.f_measure(F.col("g")[n - 1])), 6).alias(f"rouge{n}") for n in (1, 2)])


@query("agg_rouge_l")
def agg_rouge_l(s, sf):
    return _consecutive(s, sf).agg(F.round(F.avg(metrics.rouge_l(F.col("p"), F.col("r"))), 6).alias("rouge_l"))


@query("agg_bleu", T + _WORDS + ", " + ", ".join(_hits_sql(n) for n in range(1, 5)) + ", l AS (SELECT sum(len(p)) lp, sum(len(r)) lr FROM pr), " + ", ".join(f"s{n} AS (SELECT ln(sum(h)::DOUBLE / sum(ta)) v FROM h{n})" for n in range(1, 5)) + " SELECT round(coalesce(CASE WHEN lp < lr THEN exp(1 - lr::DOUBLE / lp) ELSE 1 END * exp((s1.v + s2.v + s3.v + s4.v) / 4), 0), 6) AS bleu FROM l, s1, s2, s3, s4")
def agg_bleu(s, sf):
    return metrics.bleu(_consecutive(s, sf), "p", "r")


@query("agg_bertscore", """WITH t AS (SELECT vec_id // 6 g, vec_id % 6 < 3 pred, vec_id, embedding v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) n FROM embeddings),
 m AS (SELECT a.g, a.vec_id i, b.vec_id j, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (a.n * b.n) c FROM t a JOIN t b ON a.g = b.g AND a.pred AND NOT b.pred),
 p AS (SELECT g, avg(c) p FROM (SELECT g, i, max(c) c FROM m GROUP BY 1, 2) GROUP BY 1), r AS (SELECT g, avg(c) r FROM (SELECT g, j, max(c) c FROM m GROUP BY 1, 2) GROUP BY 1)
 SELECT count(*) AS pairs, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(2 * p * r / (p + r)), 6) AS f1 FROM p JOIN r USING (g)""")
def agg_bertscore(s, sf):
    """Mean precision, recall and F1 of the greedy match; six neighbouring vectors are three tokens of either text."""
    e = read_table(s, sf, "embeddings").select(F.floor(F.col("vec_id") / 6).alias("g"), (F.col("vec_id") % 6 < 3).alias("is_pred"), F.col("embedding").cast("array<double>").alias("v"))
    sides = e.groupBy("g").agg(F.collect_list(F.when(F.col("is_pred"), F.col("v"))).alias("p"), F.collect_list(F.when(~F.col("is_pred"), F.col("v"))).alias("r"))
    m = sides.filter("size(p) > 0 and size(r) > 0").select(metrics.bertscore(F.col("p"), F.col("r"), metrics.given).alias("m"))
    return m.agg(F.count(F.lit(1)).alias("pairs"), *[F.round(F.avg(f"m.{k}"), 6).alias(k) for k in ("precision", "recall", "f1")])


@query("agg_bertscore_match")
def agg_bertscore_match(s, sf):
    """Mean precision, recall and F1 of the greedy match over all pairs; the encoder is the deterministic stand-in."""
    m = _consecutive(s, sf).select(metrics.bertscore(F.col("p"), F.col("r")).alias("m"))
    return m.agg(F.count(F.lit(1)).alias("pairs"), *[F.round(F.avg(f"m.{k}"), 6).alias(k) for k in ("precision", "recall", "f1")])


@query("agg_group_iterate", "SELECT split, dialog_id, count(*) AS rows FROM utterance GROUP BY 1, 2")
def agg_group_iterate(s, sf):
    return read_table(s, sf, "utterance").groupBy("split", "dialog_id").agg(F.count(F.lit(1)).alias("rows"))


# --- sorts, limits, sets


@query("sort_stable_split", "SELECT row_id, CASE split WHEN 'train' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END AS split_no FROM utterance")
def sort_stable_split(s, sf):
    no = F.when(F.col("split") == "train", 0).when(F.col("split") == "dev", 1).otherwise(2)
    return read_table(s, sf, "utterance").select("row_id", no.alias("split_no")).orderBy("split_no", "row_id")


@query("sort_multi", "SELECT o_custkey, o_orderdate, o_orderkey FROM orders")
def sort_multi(s, sf):
    return read_table(s, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey").orderBy("o_custkey", "o_orderdate", "o_orderkey")


@query("sort_group_keys", "SELECT DISTINCT split, dialog_idx FROM utterance")
def sort_group_keys(s, sf):
    return read_table(s, sf, "utterance").select("split", "dialog_idx").distinct().orderBy("split", "dialog_idx")


@query("limit_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def limit_head(s, sf):
    """A top-k report with a unique tie-break."""
    return read_table(s, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("sort_paths", "SELECT DISTINCT iden FROM speaker_chars")
def sort_paths(s, sf):
    return read_table(s, sf, "speaker_chars").select("iden").distinct().orderBy("iden")


@query("set_union_all", "SELECT c_custkey AS k, c_nationkey AS n FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def set_union_all(s, sf):
    a = read_table(s, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    return a.unionByName(read_table(s, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n")))


@query("set_union_override", _TWO + "SELECT iden, arg_max(o, pr) AS o FROM (SELECT iden, o, 1 pr FROM a UNION ALL SELECT iden, o, 2 FROM b) GROUP BY iden")
def set_union_override(s, sf):
    x = read_table(s, sf, "speaker_chars")
    a = x.filter(F.col("annotator") == "annotator-a").groupBy("iden").agg(F.max("output").alias("o")).withColumn("pr", F.lit(1))
    b = x.filter((F.col("annotator") == "annotator-b") & (F.length("output") > 0)).groupBy("iden").agg(F.max("output").alias("o")).withColumn("pr", F.lit(2))
    return a.unionByName(b).groupBy("iden").agg(F.max_by("o", "pr").alias("o"))


@query("set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(s, sf):
    return read_table(s, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(read_table(s, sf, "orders").select("o_custkey"))


@query("set_distinct_paths", "SELECT DISTINCT source, kind FROM documents")
def set_distinct_paths(s, sf):
    return read_table(s, sf, "documents").select("source", "kind").distinct()


@query("set_union_labels", "SELECT emotion AS label FROM utterance UNION SELECT emo FROM parallel_character_extraction")
def set_union_labels(s, sf):
    return read_table(s, sf, "utterance").select(F.col("emotion").alias("label")).union(read_table(s, sf, "parallel_character_extraction").select("emo")).distinct()


assert SQL
