"""Queries of prompt options, template families and data sets."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from parlance.functions import labels as L
from parlance.functions import text as X
from parlance.operators import dialogue as D
from parlance.operators import prompts as P
from parlance.operators import retrieval as R
from parlance.plans.base import T, query, turns
from parlance.plans.records import _KNN, PREFETCH
from parlance.runtime import cut_lineage, read_table
from parlance.sources import io

#: One set of options per branch: examples of single turns, brief windows, detailed ones, lines with valid labels only.
OPTIONS = {
    "single_n1": P.Options(top_n=1, kind="single", detailed=False, level=0), "single_n3": P.Options(top_n=3, kind="single", detailed=False, level=1),
    "flow_brief": P.Options(kind="flow", detailed=False, level=0), "hybrid_detailed": P.Options(), "hybrid_valid": P.Options(top_n=3, window=5, level=2),
    "flow_n1": P.Options(top_n=1, kind="flow", level=1), "short_history": P.Options(history=5, top_n=2, level=1),
}


def _labels(x: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in x)


def _example_sql(o: P.Options) -> str:
    if o.kind == "single":
        return "'< ' || utterance || ' : ' || label || ' >'"
    valid = f" FILTER (WHERE CASE source WHEN 'meld' THEN label IN ({_labels(L.MELD)}) ELSE label IN ({_labels(L.IEMOCAP)}) END)" if o.detailed and o.level == 2 else ""
    line = "speaker || ' : ' || utterance" + (" || ' :-> ' || label" if o.detailed else "")
    lines = f"coalesce(array_to_string(list({line}){valid} OVER (PARTITION BY dialog_id ORDER BY turn_idx ROWS BETWEEN {o.window - 1} PRECEDING AND CURRENT ROW), chr(10)), '')"
    return f"'<' || chr(10) || {lines} || chr(10) || '>'" if o.detailed else f"'< ' || {lines} || chr(10) || 'Last utterance label is: ' || label || ' >'"


def _sql(o: P.Options) -> str:
    pack = "string_agg(demo, chr(10) ORDER BY no)" if o.kind == "single" or o.top_n <= 1 else r"regexp_replace(string_agg('Demonstration ' || no || ':' || chr(10) || demo, chr(10) || chr(10) ORDER BY no), '^\s+|\s+$', '', 'g')"
    return (
        _KNN.format(cond="true").rstrip() + "," + T[4:].rstrip() + f""",
n AS (SELECT count(*) v FROM embeddings), x AS (SELECT t.*, row_id % v AS vec FROM t, n),
y AS (SELECT vec, idx, dialog_id, source, row_id demo_row FROM x WHERE split = 'train' AND label <> 'unknown'),
c AS (SELECT x.row_id, y.idx demo_idx, r.rank, y.demo_row, row_number() OVER (PARTITION BY x.row_id, y.dialog_id ORDER BY r.rank, y.demo_row) one FROM x JOIN r ON r.query_id = x.vec JOIN y ON y.vec = r.doc_id
 WHERE y.dialog_id <> x.dialog_id AND x.erc_target{' AND y.source = x.source' if o.level else ''}),
f AS (SELECT row_id, demo_idx, row_number() OVER (PARTITION BY row_id ORDER BY rank, demo_row) AS no FROM c WHERE one = 1 QUALIFY no <= {o.top_n}),
m AS (SELECT idx, {_example_sql(o)} AS demo FROM t),
g AS (SELECT row_id, {pack} AS demonstrations FROM f JOIN m ON m.idx = f.demo_idx GROUP BY row_id),
h AS (SELECT row_id, trim(array_to_string(list(speaker || ': ' || utterance) OVER (PARTITION BY dialog_id ORDER BY turn_idx ROWS BETWEEN {o.history} PRECEDING AND CURRENT ROW), chr(10)), chr(10)) AS history FROM t)
SELECT t.idx, t.split, t.label AS target, t.speaker AS speaker_id, t.utterance, history, coalesce(u.rate_level, 'medium') || ' speech rate, ' || coalesce(u.pitch_level, 'medium') || ' pitch, and ' || coalesce(u.intensity_level, 'medium') || ' intensity' AS audio_features, coalesce(demonstrations, '') AS demonstrations
FROM t JOIN h USING (row_id) JOIN utterance u ON u.row_id = t.row_id LEFT JOIN g ON g.row_id = t.row_id WHERE t.erc_target"""
    )


def _records(s, sf, o: P.Options):
    e = read_table(s, sf, "embeddings")
    v = e.count()
    t = cut_lineage(turns(s, sf).withColumn("target_key", F.pmod("row_id", F.lit(v))))
    cache = R.nearest(e, e, "vec_id", "embedding", PREFETCH).select(F.col("query_id").alias("target_key"), F.col("doc_id").alias("key"), "rank")
    shown = t.filter("split = 'train' and label <> 'unknown'").select(F.col("target_key").alias("key"), F.col("idx").alias("demo_idx"), F.col("dialog_id").alias("demo_dialog"), F.col("source").alias("demo_source"), F.col("row_id").alias("demo_row"))
    picked = P.examples(cache, t.filter("erc_target").select("row_id", "target_key", "dialog_id", "source"), shown, o)
    return P.records(t, read_table(s, sf, "utterance"), P.demonstrations(picked, t, o), o)


def _register(name: str, o: P.Options) -> None:
    @query(f"prompt_{name}", _sql(o))
    def run(s, sf):
        r = _records(s, sf, o)
        return r.select("idx", "split", "target", "input.speaker_id", "input.utterance", "input.history", "input.audio_features", "input.demonstrations")

    run.__doc__ = f"Prompt records with options {o.name}, level {o.level}, {o.history} turns of history."


for _name, _o in OPTIONS.items():
    _register(_name, _o)

#: Every template by name.
FAMILIES = {
    "full": P.recognition(), "no_examples": P.recognition(examples=False), "no_voice": P.recognition(voice=False), "neither": P.recognition(examples=False, voice=False),
    "older": P.recognition(strict=True), "older_no_examples": P.recognition(examples=False, strict=True), "tagged_hint": P.recognition("tagged", hint=True),
    **{f"{style}{'' if ex else '_no_examples'}": P.recognition(style, ex) for style in ("tagged", "headed", "ruled") for ex in (True, False)},
    **{f"ask_{k}": P.characteristics(k) for k in P.ASKED},
}
_SLOTS = {
    "history": "inputs.history", "utterance": "inputs.utterance", "speaker_id": "inputs.speaker_id", "audio_features": "coalesce(inputs.audio_features, '')",
    "demonstrations": "'(' || iden || ')'", "candidate_emotions": "'joyful, sad'", "hint": "coalesce(hint, '')",
}


def _template_sql(text: str) -> str:
    parts = re.split(r"\{(\w+)\}", text)
    return " || ".join(_SLOTS[p] if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if p)


@query(
    "prompt_families",
    "WITH a AS (SELECT iden, max(output) hint FROM speaker_chars GROUP BY 1), p AS (SELECT * FROM parallel_character_extraction LEFT JOIN a USING (iden)) "
    + " UNION ALL ".join(f"SELECT iden, '{k}' AS family, length({_template_sql(t)}) AS size, md5({_template_sql(t)}) AS text_md5 FROM p" for k, t in FAMILIES.items()),
)
def prompt_families(s, sf):
    """Every prompt in every family, told by size and checksum; hints are joined where a family shows them."""
    hints = read_table(s, sf, "speaker_chars").groupBy("iden").agg(F.max("output").alias("hint"))
    p = read_table(s, sf, "parallel_character_extraction").join(hints, "iden", "left")
    slots = {f: F.col(f"inputs.{f}") for f in ("history", "utterance", "speaker_id", "audio_features")}
    slots |= {"demonstrations": F.concat(F.lit("("), "iden", F.lit(")")), "candidate_emotions": F.lit("joyful, sad"), "hint": F.col("hint")}
    texts = F.array(*[F.struct(F.lit(k).alias("family"), X.template(t, **slots).alias("t")) for k, t in FAMILIES.items()])
    return p.select("iden", F.explode(texts).alias("x")).select("iden", "x.family", F.length("x.t").alias("size"), F.md5(F.col("x.t").cast("binary")).alias("text_md5"))


_RUNS = [(a, au, rag) for a in (None, "out/llama/checkpoint-9", "runs/Gemini-2/final", "x/claude", "GPT5-mini") for au in (True, False) for rag in (True, False)]


@query(
    "prompt_choice",
    "WITH r(adapter, use_audio, use_rag) AS (VALUES " + ", ".join(f"({'NULL' if a is None else repr(a)}, {str(au).lower()}, {str(rag).lower()})" for a, au, rag in _RUNS) + ") "
    "SELECT adapter, use_audio, use_rag, CASE WHEN lower(adapter) LIKE '%gemini%' THEN 'tagged' WHEN lower(adapter) LIKE '%claude%' THEN 'headed' WHEN lower(adapter) LIKE '%gpt5%' THEN 'ruled' WHEN use_audio AND use_rag THEN 'full' WHEN use_rag THEN 'no_voice' WHEN use_audio THEN 'no_examples' ELSE 'neither' END AS family FROM r",
)
def prompt_choice(s, sf):
    """Which family a run takes."""
    names = {t: k for k, t in reversed(FAMILIES.items())}
    return s.createDataFrame([(*r, names[P.choose(*r)]) for r in _RUNS], "adapter string, use_audio boolean, use_rag boolean, family string")


_WHOLE = ["gender", "emotion_code", "mapped_emotion", "pitch_level", "rate_level", "intensity_level"]


@query("set_characteristics", "SELECT ann_id, iden, output FROM speaker_chars WHERE iden IN (SELECT idx FROM utterance WHERE split IN ('train', 'dev') AND " + " AND ".join(f"{c} IS NOT NULL" for c in [*_WHOLE, "idx"]) + ")")
def set_characteristics(s, sf):
    """Answers about whole rows of train and dev, written as lines and read again."""
    u = read_table(s, sf, "utterance").filter(F.col("split").isin("train", "dev")).select("idx", *_WHOLE)
    got = P.characteristics_set(read_table(s, sf, "speaker_chars").select("ann_id", "iden", "output"), u, "idx", "iden", cover=False)
    return io.read_jsonl(s, io.write_jsonl(got, io.scratch(s, "characteristics")), "ann_id long, iden string, output string")


@query("set_recognition", "SELECT split, count(*) AS n, count(DISTINCT idx) AS targets FROM (" + _sql(P.Options()) + ") GROUP BY split")
def set_recognition(s, sf):
    """Records of all splits, written as lines by split and read again."""
    p = io.scratch(s, "recognition")
    _records(s, sf, P.Options()).write.partitionBy("split").option("ignoreNullFields", False).json(p)
    back = s.read.schema("idx string, input struct<history string, demonstrations string>, target string, split string").json(p)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("idx").alias("targets"))


@query("cache_similar")
def cache_similar(s, sf):
    """From dialogues to cached neighbours: stored windows, query windows, embedding, search, filters, cache.

    Stored: hybrid windows of labelled training turns, speakers by alias, unknown labels taken out before windowing.
    Asked: windows over all turns whose row id is divisible by 20. Of the first PREFETCH neighbours those of other
    dialogues whose label is one of the asking turn's corpus are kept, ten at most. The encoder is the stand-in.
    """
    folder = io.scratch(s, "turns")
    # turns are built once; texts and vectors then go through one exchange each
    turns(s, sf).select("row_id", "idx", "dialog_id", "turn_idx", "source", "split", "speaker", "label", "utterance").write.parquet(folder)
    t = s.read.parquet(folder)
    shown = t.filter("label <> 'unknown' and split = 'train'")
    known = D.aliases(D.position(shown, ["dialog_id"], ["turn_idx"]), ["dialog_id"], "speaker", "pos")
    line = F.concat("alias", F.lit(": "), "utterance")
    docs = known.select("row_id", F.concat(D.lines(["dialog_id"], "pos", line, 6), D.hybrid_tail(line)).alias("doc"))
    said = F.concat("speaker", F.lit(": "), "utterance")
    asked = t.select("row_id", F.concat(D.lines(["dialog_id"], "turn_idx", said, 6), D.hybrid_tail(said)).alias("doc")).filter("row_id % 20 = 0")
    near = R.nearest(*[x.select("row_id", R.hash_embedding(F.col("doc")).alias("v")) for x in (asked, docs)], "row_id", "v", PREFETCH).select("query_id", "doc_id", "rank")
    near = near.join(t.filter("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), "idx", F.col("dialog_id").alias("own"), "source"), "query_id")
    near = near.join(shown.select(F.col("row_id").alias("doc_id"), F.col("idx").alias("neighbour"), "dialog_id", "label"), "doc_id")
    valid = F.when(F.col("source") == "meld", F.col("label").isin(L.MELD)).otherwise(F.col("label").isin(L.IEMOCAP))
    top = R.prefetch_then_filter(near, "query_id", "rank", PREFETCH, valid & (F.col("own") != F.col("dialog_id")), 10)
    return top.select("idx", F.col("new_rank").cast("long").alias("rank"), "neighbour")
