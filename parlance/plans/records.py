"""Retrieval, demonstrations and prompt records."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as X
from parlance.operators import dialogue as D
from parlance.operators import retrieval as R
from parlance.plans.base import T, query, turns
from parlance.runtime import cut_lineage, read_table

#: Neighbours fetched before any filter, results kept, demonstration window, demonstrations, history turns.
PREFETCH, KEEP, WINDOW, DEMOS, HISTORY = 50, 10, 7, 2, 20

_KNN = """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE {cond}),
d AS (SELECT q.vec_id query_id, e.vec_id doc_id, e.label, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) dist FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), doc_id) AS rank FROM d QUALIFY rank <= 50)
"""
_SEARCH = _KNN.format(cond="vec_id % 20 = 0")
_LABELS = ", ".join(str(i) for i in (0, 2, 4, 6, 8))


def _ranked(s, sf):
    """The 50 nearest of every vector whose id is divisible by 20, with the neighbour's label."""
    e = read_table(s, sf, "embeddings")
    near = R.nearest(e.filter(F.col("vec_id") % 20 == 0), e, "vec_id", "embedding", PREFETCH)
    return near.join(e.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")


def _other_dialogue():
    return F.floor(F.col("doc_id") / 5) != F.floor(F.col("query_id") / 5)


@query("join_knn", _SEARCH + "SELECT query_id, doc_id, rank, round(dist, 6) AS distance FROM r")
def join_knn(s, sf):
    return _ranked(s, sf).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query("knn_recall", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def knn_recall(s, sf):
    """The index against the exact search: every vector whose id is divisible by 20, ten neighbours; enough is 0.9."""
    e = read_table(s, sf, "embeddings")
    asked = e.filter(F.col("vec_id") % 20 == 0)
    exact = R.nearest(asked, e, "vec_id", "embedding", 10).select("query_id", "doc_id")
    index = R.build_index(e, "vec_id", "embedding")
    found = R.nearest_indexed(asked, index, "vec_id", "embedding", 10, -(-len(index.centres) * 3 // 4)).select("query_id", "doc_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "doc_id"], "left").agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query("vec_distance", "WITH p AS (SELECT vec_id, embedding a, lead(embedding) OVER (ORDER BY vec_id) b FROM embeddings) SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS distance FROM p WHERE b IS NOT NULL")
def vec_distance(s, sf):
    """Distance to the vector of the next id, as an equi-join."""
    e = read_table(s, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(R.l2_squared(F.col("a"), F.col("b")), 6).alias("distance"))


@query("filter_same_dialogue", _SEARCH + "SELECT query_id, doc_id FROM r WHERE doc_id // 5 <> query_id // 5")
def filter_same_dialogue(s, sf):
    return _ranked(s, sf).filter(_other_dialogue()).select("query_id", "doc_id")


@query("filter_valid_label", _SEARCH + f"SELECT query_id, doc_id FROM r WHERE label IN ({_LABELS})")
def filter_valid_label(s, sf):
    return _ranked(s, sf).filter(F.col("label").isin(0, 2, 4, 6, 8)).select("query_id", "doc_id")


@query("topk_prefilter", _SEARCH + f", f AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS new_rank FROM r WHERE label IN ({_LABELS}) AND doc_id // 5 <> query_id // 5) SELECT query_id, doc_id, new_rank FROM f WHERE new_rank <= 10")
def topk_prefilter(s, sf):
    keep = F.col("label").isin(0, 2, 4, 6, 8) & _other_dialogue()
    return R.prefetch_then_filter(_ranked(s, sf), "query_id", "rank", PREFETCH, keep, KEEP).select("query_id", "doc_id", F.col("new_rank").cast("long").alias("new_rank"))


_FIRST = ", o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id // 5 ORDER BY rank) one FROM r), f AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS new_rank FROM o WHERE one = 1) "


def _first(s, sf, n):
    r = _ranked(s, sf).withColumn("dialogue", F.floor(F.col("doc_id") / 5))
    return R.first_per_group(r, "query_id", "dialogue", "rank", n).select("query_id", "doc_id", F.col("new_rank").cast("long").alias("new_rank"))


@query("win_first_per_group_topn", _SEARCH + _FIRST + "SELECT query_id, doc_id, new_rank FROM f WHERE new_rank <= 2")
def win_first_per_group_topn(s, sf):
    return _first(s, sf, 2)


@query("topk_distinct_group", _SEARCH + _FIRST + "SELECT query_id, doc_id, new_rank FROM f WHERE new_rank <= 5")
def topk_distinct_group(s, sf):
    return _first(s, sf, 5)


@query("join_cache_lookup", _SEARCH + "SELECT e.vec_id, string_agg(r.doc_id::VARCHAR, ',' ORDER BY r.rank) AS neighbours FROM embeddings e JOIN r ON r.query_id = e.vec_id WHERE r.rank <= 10 GROUP BY e.vec_id")
def join_cache_lookup(s, sf):
    cache = _ranked(s, sf).filter("rank <= 10").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("a"))
    e = read_table(s, sf, "embeddings").select("vec_id")
    return e.join(cache, F.col("vec_id") == F.col("query_id")).select("vec_id", F.array_join(F.transform("a", lambda x: x["doc_id"].cast("string")), ",").alias("neighbours"))


@query("vec_embed")
def vec_embed(s, sf):
    """Texts through an embedding model in Arrow batches; here the deterministic stand-in."""
    return turns(s, sf).select("idx", R.hash_embedding(F.col("utterance")).alias("embedding"))


# --- demonstrations and prompts

_FRAME = "list({line}) OVER (PARTITION BY dialog_id ORDER BY turn_idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
_PLAIN = f"array_to_string({_FRAME.format(line=chr(39).join(['speaker || ', ' : ', ' || utterance']))}, chr(10))"
_DETAIL = f"array_to_string({_FRAME.format(line=chr(39).join(['speaker || ', ' : ', ' || utterance || ', ' :-> ', ' || label']))}, chr(10))"


def _plain_demo():
    return F.concat(F.lit("< "), D.lines(["dialog_id"], "turn_idx", F.concat("speaker", F.lit(" : "), "utterance"), WINDOW - 1), F.lit("\nLast utterance label is: "), F.col("label"), F.lit(" >"))


def _detailed_demo():
    line = F.concat("speaker", F.lit(" : "), "utterance", F.lit(" :-> "), "label")
    return F.concat(F.lit("<\n"), D.lines(["dialog_id"], "turn_idx", line, WINDOW - 1), F.lit("\n>"))


@query("str_demo_single", T + "SELECT idx, '< ' || utterance || ' : ' || label || ' >' AS demo FROM t")
def str_demo_single(s, sf):
    return turns(s, sf).select("idx", F.concat(F.lit("< "), "utterance", F.lit(" : "), "label", F.lit(" >")).alias("demo"))


@query("str_demo_flow", T + f"SELECT idx, '< ' || {_PLAIN} || chr(10) || 'Last utterance label is: ' || label || ' >' AS brief, '<' || chr(10) || {_DETAIL} || chr(10) || '>' AS detailed FROM t")
def str_demo_flow(s, sf):
    return turns(s, sf).select("idx", _plain_demo().alias("brief"), _detailed_demo().alias("detailed"))


@query("str_demo_pack", T + r", g AS (SELECT dialog_id, list(utterance ORDER BY turn_idx) a FROM t GROUP BY dialog_id) SELECT dialog_id, CASE WHEN len(a) <= 1 THEN array_to_string(a, chr(10)) ELSE regexp_replace(array_to_string(list_transform(a, lambda x, i: 'Demonstration ' || i || ':' || chr(10) || x), chr(10) || chr(10)), '^\s+|\s+$', '', 'g') END AS packed FROM g")
def str_demo_pack(s, sf):
    """All turns of a dialogue, numbered in their order; the turn of a dialogue of one has no number."""
    g = turns(s, sf).groupBy("dialog_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", "utterance"))).alias("a"))
    return g.select("dialog_id", X.pack(F.transform("a", lambda x: x["utterance"]), F.size("a")).alias("packed"))


TEMPLATE = "Examples:\n{demonstrations}\n\nConversation:\n{history}\n\nSpeaker {speaker_id} says: {utterance}\nVoice: {audio_features}\nAnswer with one of: {candidate_emotions}\n"


@query("str_template", "SELECT iden, 'Conversation:' || chr(10) || inputs.history || chr(10) || 'Who: ' || inputs.speaker_id || chr(10) || 'Voice: ' || coalesce(inputs.audio_features, '') AS prompt FROM parallel_character_extraction")
def str_template(s, sf):
    p = read_table(s, sf, "parallel_character_extraction")
    text = "Conversation:\n{history}\nWho: {speaker_id}\nVoice: {audio_features}"
    return p.select("iden", X.template(text, **{f: F.col(f"inputs.{f}") for f in ("history", "speaker_id", "audio_features", "utterance")}).alias("prompt"))


_PROMPT = _KNN.format(cond="true").rstrip() + "," + T[4:].rstrip() + """,
n AS (SELECT count(*) v FROM embeddings), x AS (SELECT t.*, row_id % v AS vec FROM t, n),
y AS (SELECT vec, idx, dialog_id, row_id demo_row FROM x WHERE split = 'train' AND label <> 'unknown'),
c AS (SELECT x.row_id, y.idx demo_idx, y.dialog_id, r.rank, y.demo_row, row_number() OVER (PARTITION BY x.row_id, y.dialog_id ORDER BY r.rank, y.demo_row) one FROM x JOIN r ON r.query_id = x.vec JOIN y ON y.vec = r.doc_id WHERE y.dialog_id <> x.dialog_id AND x.erc_target),
f AS (SELECT row_id, demo_idx, row_number() OVER (PARTITION BY row_id ORDER BY rank, demo_row) AS no FROM c WHERE one = 1 QUALIFY no <= 2),
m AS (SELECT idx, '<' || chr(10) || """ + _DETAIL + """ || chr(10) || '>' AS demo FROM t),
g AS (SELECT f.row_id, string_agg('Demonstration ' || no || ':' || chr(10) || demo, chr(10) || chr(10) ORDER BY no) AS demos FROM f JOIN m ON m.idx = f.demo_idx GROUP BY f.row_id),
h AS (SELECT row_id, trim(array_to_string(list(speaker || ': ' || utterance) OVER (PARTITION BY dialog_id ORDER BY turn_idx ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), chr(10)), chr(10)) AS history FROM t)
SELECT t.idx, t.split, t.label AS target, 'Examples:' || chr(10) || coalesce(demos, '') || chr(10) || chr(10) || 'Conversation:' || chr(10) || history || chr(10) || chr(10) || 'Speaker ' || t.speaker || ' says: ' || t.utterance
 || chr(10) || 'Voice: ' || coalesce(u.rate_level, 'medium') || ' speech rate, ' || coalesce(u.pitch_level, 'medium') || ' pitch, and ' || coalesce(u.intensity_level, 'medium') || ' intensity'
 || chr(10) || 'Answer with one of: joyful, sad, neutral, angry, excited, surprised, frustrated, fearful, disgusted' || chr(10) AS prompt
FROM t JOIN h USING (row_id) JOIN utterance u ON u.row_id = t.row_id LEFT JOIN g ON g.row_id = t.row_id WHERE t.erc_target"""


@query("prompt_records", _PROMPT)
def prompt_records(s, sf):
    """The flagship: history, voice, and demonstrations of the nearest labelled turns of other dialogues.

    Turns share the vectors of the embedding table (row id modulo their number); all labelled training turns of a vector
    are candidates, the smallest row id first. Neighbours are searched once per vector, not per turn, and joined; one
    example a dialogue, two in all.
    """
    from parlance.functions.labels import SHOWN

    e = read_table(s, sf, "embeddings")
    v = e.count()
    t = cut_lineage(turns(s, sf).withColumn("vec", F.pmod("row_id", F.lit(v))))
    shown = t.filter("split = 'train' and label <> 'unknown'").select(F.col("vec").alias("doc_id"), F.col("idx").alias("demo_idx"), F.col("dialog_id").alias("demo_dialog"), F.col("row_id").alias("demo_row"))
    # a target's own dialogue can take one place at most: the first DEMOS + 1 dialogues of a vector, and of a query, are enough
    shown = R.first_per_group(shown, "doc_id", "demo_dialog", "demo_row", DEMOS + 1).drop("new_rank")
    near = R.nearest(e, e, "vec_id", "embedding", PREFETCH).join(shown, "doc_id").select(F.col("query_id").alias("vec"), "demo_idx", "demo_dialog", F.struct("rank", "demo_row").alias("rank"))
    near = R.first_per_group(near, "vec", "demo_dialog", "rank", DEMOS + 1).drop("new_rank")
    targets = t.filter("erc_target").select("row_id", "vec", "dialog_id")
    cand = targets.join(near, "vec").filter(F.col("demo_dialog") != F.col("dialog_id"))
    top = R.first_per_group(cand, "row_id", "demo_dialog", "rank", DEMOS).select("row_id", "demo_idx", F.col("new_rank").alias("no"))
    demos = t.select(F.col("idx").alias("demo_idx"), _detailed_demo().alias("demo"))
    packed = top.join(demos, "demo_idx").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("no", "demo"))).alias("a"))
    block = F.transform("a", lambda x: F.concat(F.lit("Demonstration "), x["no"].cast("string"), F.lit(":\n"), x["demo"]))
    packed = packed.select("row_id", F.array_join(block, "\n\n").alias("demos"))
    line = F.concat("speaker", F.lit(": "), "utterance")
    ctx = t.withColumn("history", D.history(["dialog_id"], "turn_idx", line, HISTORY)).filter("erc_target")
    levels = read_table(s, sf, "utterance").select("row_id", "rate_level", "pitch_level", "intensity_level").na.fill("medium")
    full = ctx.join(levels, "row_id").join(packed, "row_id", "left")
    prompt = X.template(
        TEMPLATE, demonstrations=F.col("demos"), history=F.col("history"), speaker_id=F.col("speaker"), utterance=F.col("utterance"),
        audio_features=X.audio_phrase(F.col("rate_level"), F.col("pitch_level"), F.col("intensity_level")), candidate_emotions=F.lit(", ".join(SHOWN)),
    )
    return full.select("idx", "split", F.col("label").alias("target"), prompt.alias("prompt"))
