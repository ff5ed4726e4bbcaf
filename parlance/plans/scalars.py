"""Scalar functions, arrays, maps, structs, JSON, tokens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions import labels as L
from parlance.functions import text as X
from parlance.functions import vocabulary as V
from parlance.operators import dialogue as D
from parlance.operators import external
from parlance.operators.impute import finite
from parlance.plans.base import T, query, turns
from parlance.runtime import read_table
from parlance.sources import io

_U = "utterance"
_C1 = "translate(utterance, chr(146) || chr(151) || chr(133) || chr(145) || chr(147) || chr(148), chr(39) || '  ')"


@query("str_clean_codepoints", f"SELECT row_id, {_C1} AS clean FROM meld_erc_init")
def str_clean_codepoints(s, sf):
    return read_table(s, sf, "meld_erc_init").select("row_id", X.clean_controls(F.col("utterance")).alias("clean"))


@query("str_alias_fixed", "SELECT row_id, CASE speaker WHEN 'F' THEN 'Speaker_F' WHEN 'M' THEN 'Speaker_M' END AS hybrid, CASE speaker WHEN 'F' THEN 'Speaker_F' WHEN 'M' THEN 'Speaker_0' END AS flow, 'Speaker_' || speaker AS meta FROM utterance WHERE source = 'iemocap'")
def str_alias_fixed(s, sf):
    u = read_table(s, sf, _U).filter(F.col("source") == "iemocap")
    sp = F.col("speaker")
    return u.select("row_id", F.when(sp == "F", "Speaker_F").when(sp == "M", "Speaker_M").alias("hybrid"), F.when(sp == "F", "Speaker_F").when(sp == "M", "Speaker_0").alias("flow"), F.concat(F.lit("Speaker_"), sp).alias("meta"))


@query("str_audio_phrase", "SELECT row_id, coalesce(rate_level, 'medium') || ' speech rate, ' || coalesce(pitch_level, 'medium') || ' pitch, and ' || coalesce(intensity_level, 'medium') || ' intensity' AS phrase FROM utterance")
def str_audio_phrase(s, sf):
    u = read_table(s, sf, _U).na.fill("medium", ["rate_level", "pitch_level", "intensity_level"])
    return u.select("row_id", X.audio_phrase(F.col("rate_level"), F.col("pitch_level"), F.col("intensity_level")).alias("phrase"))


@query("str_idx_build", "SELECT row_id, CASE source WHEN 'meld' THEN 'm' ELSE 'i' END || '_' || dialog_idx || '_' || turn_idx AS idx FROM utterance WHERE turn_idx IS NOT NULL")
def str_idx_build(s, sf):
    u = read_table(s, sf, _U).filter("turn_idx is not null")
    return u.select("row_id", X.key(F.when(F.col("source") == "meld", "m").otherwise("i"), F.col("dialog_idx"), F.col("turn_idx")).alias("idx"))


@query("str_idx_split", "SELECT row_id, regexp_extract(idx, '^(.*)_[^_]*$', 1) AS dialog, TRY_CAST(split_part(idx, '_', 3) AS INT) AS turn, idx[1] AS corpus FROM utterance WHERE idx IS NOT NULL")
def str_idx_split(s, sf):
    u = read_table(s, sf, _U).filter("idx is not null")
    return u.select("row_id", X.key_dialog(F.col("idx")).alias("dialog"), X.key_turn(F.col("idx")).alias("turn"), F.substring("idx", 1, 1).alias("corpus"))


@query("str_join_lines", "SELECT iden, array_to_string(list_reverse(string_split(inputs.history, chr(10))), chr(10)) AS back FROM parallel_character_extraction")
def str_join_lines(s, sf):
    return read_table(s, sf, "parallel_character_extraction").select("iden", F.array_join(F.reverse(F.split("inputs.history", "\n")), "\n").alias("back"))


@query("str_strip_newline", "SELECT ann_id, trim(output, chr(10)) AS o FROM speaker_chars")
def str_strip_newline(s, sf):
    return read_table(s, sf, "speaker_chars").select("ann_id", X.strip_newlines(F.col("output")).alias("o"))


@query("str_strip", "SELECT row_id, regexp_replace(speaker, '^\\s+|\\s+$', '', 'g') AS s FROM utterance")
def str_strip(s, sf):
    return read_table(s, sf, _U).select("row_id", X.strip(F.col("speaker")).alias("s"))


@query("str_lower", "SELECT row_id, lower(mapped_emotion) AS s FROM utterance")
def str_lower(s, sf):
    return read_table(s, sf, _U).select("row_id", F.lower("mapped_emotion").alias("s"))


@query("str_upper", "SELECT row_id, upper(source) AS s FROM utterance")
def str_upper(s, sf):
    return read_table(s, sf, _U).select("row_id", F.upper("source").alias("s"))


@query("str_contains", "SELECT row_id FROM utterance WHERE contains(utterance, 'birdcage')")
def str_contains(s, sf):
    return read_table(s, sf, _U).filter(F.col("utterance").contains("birdcage")).select("row_id")


@query("str_index", "SELECT row_id, coalesce(instr(utterance, 'the '), -1)::INT AS at FROM utterance")
def str_index(s, sf):
    return read_table(s, sf, _U).select("row_id", F.coalesce(F.instr("utterance", "the "), F.lit(-1)).alias("at"))


@query("str_startswith", "SELECT row_id FROM utterance WHERE starts_with(utterance, 'Tell me')")
def str_startswith(s, sf):
    return read_table(s, sf, _U).filter(F.col("utterance").startswith("Tell me")).select("row_id")


@query("str_regex_groups", "SELECT row_id, regexp_extract(dialog_id, '^Ses(\\d\\d)([FM])_([a-z]+)(\\d+)$', 1) AS ses, regexp_extract(dialog_id, '^Ses(\\d\\d)([FM])_([a-z]+)(\\d+)$', 3) AS kind, regexp_extract(dialog_id, '^Ses(\\d\\d)([FM])_([a-z]+)(\\d+)$', 4) AS no FROM utterance")
def str_regex_groups(s, sf):
    p = r"^Ses(\d\d)([FM])_([a-z]+)(\d+)$"
    g = lambda i, n: F.regexp_extract("dialog_id", p, i).alias(n)
    return read_table(s, sf, _U).select("row_id", g(1, "ses"), g(3, "kind"), g(4, "no"))


@query("str_char_at", "SELECT row_id, CASE WHEN length(dialog_id) > 5 THEN dialog_id[6] ELSE '' END AS c FROM utterance")
def str_char_at(s, sf):
    return read_table(s, sf, _U).select("row_id", F.when(F.length("dialog_id") > 5, F.substring("dialog_id", 6, 1)).otherwise("").alias("c"))


@query("str_split_take", "SELECT row_id, array_to_string(list_slice(string_split(idx, '_'), 1, -2), '_') AS head FROM utterance WHERE idx IS NOT NULL")
def str_split_take(s, sf):
    p = F.split("idx", "_")
    return read_table(s, sf, _U).filter("idx is not null").select("row_id", F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), "_").alias("head"))


@query("str_dialog_type", "SELECT row_id, CASE WHEN contains(dialog_id, 'impro') THEN 'impro' WHEN contains(dialog_id, 'script') THEN 'script' ELSE '' END AS kind FROM utterance")
def str_dialog_type(s, sf):
    return read_table(s, sf, _U).select("row_id", X.dialog_type(F.col("dialog_id")).alias("kind"))


@query("str_turn_meta", "SELECT row_id, CASE WHEN contains(turn_id, '_') THEN split_part(turn_id, '_', -1)[1] ELSE '' END AS speaker_code, CASE WHEN contains(turn_id, '_') THEN regexp_extract(turn_id, '^(.*)_[^_]*$', 1) ELSE turn_id END AS dialog FROM utterance")
def str_turn_meta(s, sf):
    has, t = F.col("turn_id").contains("_"), F.col("turn_id")
    return read_table(s, sf, _U).select("row_id", F.when(has, F.substring(F.substring_index("turn_id", "_", -1), 1, 1)).otherwise("").alias("speaker_code"), F.when(has, X.key_dialog(t)).otherwise(t).alias("dialog"))


@query("str_session", "SELECT row_id, regexp_extract('/data/' || coalesce(session, 'none') || '/x.wav', '/(Session[^/]*)/', 1) AS ses FROM utterance")
def str_session(s, sf):
    p = F.concat(F.lit("/data/"), F.coalesce("session", F.lit("none")), F.lit("/x.wav"))
    return read_table(s, sf, _U).select("row_id", F.regexp_extract(p, "/(Session[^/]*)/", 1).alias("ses"))


@query("str_format_path", "SELECT row_id, 'dia' || dialog_idx || '_utt' || coalesce(turn_idx::VARCHAR, 'null') || '.wav' AS name FROM utterance")
def str_format_path(s, sf):
    return read_table(s, sf, _U).select("row_id", F.format_string("dia%s_utt%s.wav", F.col("dialog_idx").cast("string"), F.coalesce(F.col("turn_idx").cast("string"), F.lit("null"))).alias("name"))


@query("path_wav_meld", "SELECT row_id, '/wav/audio/' || CASE lower(trim(split)) WHEN 'train' THEN 'train' WHEN 'test' THEN 'test' WHEN 'testing' THEN 'test' ELSE 'dev' END || '_audio_splits/dia' || dialog_idx || '_utt' || turn_idx || '.wav' AS path FROM utterance WHERE source = 'meld' AND turn_idx IS NOT NULL")
def path_wav_meld(s, sf):
    u = read_table(s, sf, _U).filter("source = 'meld' and turn_idx is not null")
    return u.select("row_id", io.wav_path(F.col("dialog_idx"), F.col("turn_idx"), F.col("split"), "/wav").alias("path"))


@query("path_wav_iemocap", "SELECT row_id, concat_ws('/', '/wav', session, 'sentences/wav', dialog_id, turn_id || '.wav') AS path FROM utterance WHERE source = 'iemocap'")
def path_wav_iemocap(s, sf):
    u = read_table(s, sf, _U).filter("source = 'iemocap'")
    return u.select("row_id", io.wav_path_session(F.col("session"), F.col("dialog_id"), F.col("turn_id"), "/wav").alias("path"))


@query("str_candidates", f"SELECT row_id, CASE source WHEN 'meld' THEN '{', '.join(L.MELD)}' ELSE '{', '.join(L.IEMOCAP)}' END AS candidates FROM utterance")
def str_candidates(s, sf):
    return read_table(s, sf, _U).select("row_id", F.when(F.col("source") == "meld", ", ".join(L.MELD)).otherwise(", ".join(L.IEMOCAP)).alias("candidates"))


_ALT = "|".join(L.SHOWN)
_HITS = " + ".join(f"contains(lower(text), '{x}')::INT" for x in L.SHOWN)
_ONE = "CASE " + " ".join(f"WHEN contains(lower(text), '{x}') THEN '{x}'" for x in L.SHOWN) + " END"


@query("str_extract_first_label", f"SELECT doc_id, coalesce(nullif(regexp_extract(lower(text), '({_ALT})', 1), ''), 'NoValidEmotionFound') AS label FROM documents")
def str_extract_first_label(s, sf):
    return read_table(s, sf, "documents").select("doc_id", X.first_label(F.col("text"), L.SHOWN).alias("label"))


@query("str_extract_single_label", f"SELECT doc_id, CASE WHEN {_HITS} = 0 THEN 'NoValidEmotionFound' WHEN {_HITS} > 1 THEN 'MultipleValidEmotionsFound' ELSE {_ONE} END AS label FROM documents")
def str_extract_single_label(s, sf):
    return read_table(s, sf, "documents").select("doc_id", X.single_label(F.col("text"), L.SHOWN).alias("label"))


_IN = ", ".join(f"'{x}'" for x in L.MELD)


@query("str_default_invalid", T + f"SELECT row_id, CASE WHEN label IN ({_IN}) THEN label ELSE 'neutral' END AS label FROM t")
def str_default_invalid(s, sf):
    return turns(s, sf).select("row_id", F.when(F.col("label").isin(L.MELD), F.col("label")).otherwise("neutral").alias("label"))


@query("str_hint_prefix", "SELECT ann_id, CASE prompt_type WHEN 'reaction' THEN 'reaction of potential listeners: ' WHEN 'mental_state' THEN 'mental state or behavior: ' ELSE 'speaker''s intention or reason: ' END || output AS hint FROM speaker_chars")
def str_hint_prefix(s, sf):
    k = F.when(F.col("prompt_type") == "reaction", "default").when(F.col("prompt_type") == "mental_state", "alt1").otherwise("alt2")
    return read_table(s, sf, "speaker_chars").select("ann_id", F.concat(L.lookup(L.HINT_PREFIX, k), "output").alias("hint"))


@query("str_to_bool", "SELECT row_id, erc_target AS flag FROM utterance")
def str_to_bool(s, sf):
    return read_table(s, sf, _U).select("row_id", F.when(F.col("erc_target").isNotNull(), L.to_bool(F.when(F.col("erc_target"), "Yes").otherwise("off"))).alias("flag"))


@query("argmin_position", "SELECT doc_id, " + "coalesce(list_min([" + ", ".join(f"nullif(instr(lower(text), '{x}'), 0)" for x in L.SHOWN) + "]), -1)::INT AS at FROM documents")
def argmin_position(s, sf):
    at = F.array(*[F.nullif(F.instr(F.lower("text"), x), F.lit(0)) for x in L.SHOWN])
    return read_table(s, sf, "documents").select("doc_id", F.coalesce(F.array_min(F.array_compact(at)), F.lit(-1)).alias("at"))


# --- numbers and dates


@query("num_round", "SELECT event_id, round_even(value * 4, 0) AS even FROM events")
def num_round(s, sf):
    return read_table(s, sf, "events").select("event_id", F.bround(F.col("value") * 4, 0).alias("even"))


@query("num_clip", "SELECT event_id, least(greatest(value, 10), 50) AS v FROM events")
def num_clip(s, sf):
    return read_table(s, sf, "events").select("event_id", F.least(F.greatest("value", F.lit(10.0)), F.lit(50.0)).alias("v"))


@query("num_max0", "SELECT row_id, greatest(0, turn_idx + 1 - 7) AS first FROM utterance WHERE turn_idx IS NOT NULL")
def num_max0(s, sf):
    return read_table(s, sf, _U).filter("turn_idx is not null").select("row_id", F.greatest(F.lit(0).cast("long"), F.col("turn_idx") + 1 - 7).alias("first"))


@query("num_isfinite", "SELECT row_id, coalesce(isfinite(hnr_mean_db), false) AS ok FROM utterance")
def num_isfinite(s, sf):
    return read_table(s, sf, _U).select("row_id", finite(F.col("hnr_mean_db")).isNotNull().alias("ok"))


@query("num_ratio_guard", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_tax, 0), 6) AS ratio FROM lineitem")
def num_ratio_guard(s, sf):
    return read_table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.try_divide("l_extendedprice", "l_tax"), 6).alias("ratio"))


@query("date_now_format", "SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS stamp FROM events")
def date_now_format(s, sf):
    return read_table(s, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd_HH-mm-ss").alias("stamp"))


@query("date_elapsed", "SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) AS us FROM events GROUP BY user_id")
def date_elapsed(s, sf):
    return read_table(s, sf, "events").groupBy("user_id").agg((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))).alias("us"))


# --- arrays, maps, structs, JSON


@query("arr_slice", "SELECT vec_id, round(list_sum(list_slice(embedding, 1, 10)::DOUBLE[]), 6) AS head FROM embeddings")
def arr_slice(s, sf):
    return read_table(s, sf, "embeddings").select("vec_id", F.round(F.aggregate(F.slice("embedding", 1, 10), F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("head"))


@query("arr_filter", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::INT AS positive FROM embeddings")
def arr_filter(s, sf):
    return read_table(s, sf, "embeddings").select("vec_id", F.size(F.filter("embedding", lambda x: x > 0)).alias("positive"))


@query("arr_transform", "SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w: length(w)::VARCHAR), ',') AS sizes FROM documents")
def arr_transform(s, sf):
    return read_table(s, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", " "), lambda w: F.length(w).cast("string")), ",").alias("sizes"))


@query("arr_to_text", T + "SELECT dialog_id, '[' || string_agg(turn_idx::VARCHAR, ', ' ORDER BY turn_idx) || ']' AS turns FROM t GROUP BY dialog_id")
def arr_to_text(s, sf):
    g = turns(s, sf).groupBy("dialog_id").agg(F.array_sort(F.collect_list("turn_idx")).alias("a"))
    return g.select("dialog_id", F.concat(F.lit("["), F.array_join("a", ", "), F.lit("]")).alias("turns"))


_MAPPED = "CASE emotion " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.RAW_TO_MAPPED.items()) + " END"


@query("map_lookup", f"SELECT row_id, {_MAPPED} AS label FROM utterance")
def map_lookup(s, sf):
    return read_table(s, sf, _U).select("row_id", L.lookup(L.RAW_TO_MAPPED, F.col("emotion")).alias("label"))


@query("map_get_default", "SELECT row_id, CASE emotion_code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.CODES.items()) + " ELSE coalesce(emotion_code, 'none') END AS name FROM utterance")
def map_get_default(s, sf):
    c = F.col("emotion_code")
    return read_table(s, sf, _U).select("row_id", L.lookup(L.CODES, c, F.coalesce(c, F.lit("none"))).alias("name"))


@query("map_invert_enumerate", T + "SELECT row_id, CASE label " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(L.MAPPED)) + " ELSE -1 END AS no FROM t")
def map_invert_enumerate(s, sf):
    return turns(s, sf).select("row_id", F.coalesce(L.label_id(F.col("label")), F.lit(-1)).alias("no"))


@query("map_merge", "SELECT iden, coalesce(inputs.audio_features, 'none') || '/' || 'new' AS both FROM parallel_character_extraction")
def map_merge(s, sf):
    """The right map wins for equal keys, whatever the session's duplicate-key policy."""
    a = F.create_map(F.lit("audio"), F.coalesce("inputs.audio_features", F.lit("none")), F.lit("tag"), F.lit("old"))
    b = F.create_map(F.lit("tag"), F.lit("new"))
    merged = F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    return read_table(s, sf, "parallel_character_extraction").select("iden", F.concat_ws("/", merged["audio"], merged["tag"]).alias("both"))


@query("struct_build", "SELECT iden, inputs.speaker_id || '>' || emo AS pair FROM parallel_character_extraction")
def struct_build(s, sf):
    p = read_table(s, sf, "parallel_character_extraction").select("iden", F.struct(F.struct(F.col("inputs.speaker_id").alias("speaker")).alias("input"), F.col("emo").alias("target")).alias("r"))
    return p.select("iden", F.concat_ws(">", "r.input.speaker", "r.target").alias("pair"))


@query("json_write", "SELECT ann_id, output FROM speaker_chars")
def json_write(s, sf):
    """Through JSON text and back; null fields and non-ASCII text are kept."""
    j = F.to_json(F.struct("ann_id", "output"), {"ignoreNullFields": "false"})
    return read_table(s, sf, "speaker_chars").select(F.from_json(j, "ann_id long, output string").alias("r")).select("r.ann_id", "r.output")


@query("json_read", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def json_read(s, sf):
    return read_table(s, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# --- tokens


_TOK = "len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"


@query("tok_encode_mask", f"SELECT s.ann_id, least(64, {_TOK.format(c='p.inputs.history')} + {_TOK.format(c='s.output')} + 1)::INT AS ids, least({_TOK.format(c='p.inputs.history')}, 64)::INT AS masked, {_TOK.format(c='p.inputs.history')} + {_TOK.format(c='s.output')} < 64 AS ended FROM speaker_chars s JOIN parallel_character_extraction p USING (iden)")
def tok_encode_mask(s, sf, longest=64):
    """Prompt, answer and end, cut at the longest length; the prompt's part of the labels is masked. Words stand for tokens
    here, so that SQL can follow; ``tok_encode_vocabulary`` takes the vocabulary."""
    p = read_table(s, sf, "parallel_character_extraction").select("iden", external.token_ids(F.col("inputs.history")).alias("prompt"))
    j = read_table(s, sf, "speaker_chars").join(p, "iden").withColumn("full", F.concat("prompt", external.token_ids(F.col("output")), F.array(F.lit(-1))))
    m = j.select("ann_id", external.masked(F.col("prompt"), F.col("full"), longest).alias("m"))
    return m.select("ann_id", F.size("m.input_ids").alias("ids"), F.size(F.filter("m.labels", lambda x: x == -100)).alias("masked"), (F.element_at("m.input_ids", -1) == -1).alias("ended"))


def _encoded(s, sf):
    p = read_table(s, sf, "parallel_character_extraction").select("iden", V.encode(F.col("inputs.history")).alias("prompt"))
    j = read_table(s, sf, "speaker_chars").select("ann_id", "iden", "output", V.encode(F.col("output")).alias("answer")).join(p, "iden")
    return j.withColumn("full", F.concat("prompt", "answer", F.array(F.lit(V.end_id()))))


@query("tok_encode_vocabulary")
def tok_encode_vocabulary(s, sf, longest=512):
    """Token ids of prompt, answer and end by the vocabulary: ids, attention mask and labels."""
    return _encoded(s, sf).select("ann_id", external.masked(F.col("prompt"), F.col("full"), longest).alias("m")).select("ann_id", "m.*")


@query("tok_dynamic_pad", T + f", k AS (SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // 16 AS batch, {_TOK.format(c='utterance')} n FROM t) SELECT row_id, batch, (max(n) OVER (PARTITION BY batch) - n)::INT AS pads FROM k")
def tok_dynamic_pad(s, sf):
    """Padded to the longest text of a batch of 16."""
    t = D.running(turns(s, sf).select("row_id", external.token_ids(F.col("utterance")).alias("ids")), [F.col("row_id")], {"n": F.lit(1)})
    t = t.withColumn("batch", F.floor((F.col("n") - 1) / 16).cast("long"))
    width = F.max(F.size("ids")).over(Window.partitionBy("batch"))
    p = t.withColumn("w", width).withColumn("padded", external.padded(F.col("ids"), F.col("w"), -1, left=True))
    return p.select("row_id", "batch", F.size(F.filter("padded", lambda x: x == -1)).alias("pads"))


@query("tok_decode", "SELECT ann_id, regexp_replace(coalesce(s.output, ''), '^\\s+|\\s+$', '', 'g') AS text FROM speaker_chars s JOIN parallel_character_extraction p USING (iden)")
def tok_decode(s, sf):
    """The ids behind the prompt as text, without the end, stripped."""
    new = F.slice("full", F.size("prompt") + 1, F.greatest(F.size("full"), F.lit(1)))
    return _encoded(s, sf).select("ann_id", X.strip(V.decode(new)).alias("text"))


@query("external_generate", "SELECT iden, CASE WHEN regexp_matches(inputs.utterance, '\\S') THEN 1 ELSE 0 END AS answered FROM parallel_character_extraction")
def external_generate(s, sf):
    g = external.generate(F.col("inputs.utterance"), external.Echo())
    return read_table(s, sf, "parallel_character_extraction").select("iden", (F.length(g) > 0).cast("int").alias("answered"))
