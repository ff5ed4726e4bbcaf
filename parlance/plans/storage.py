"""Sources and sinks: tables are written in the format and read again, whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import external, retrieval
from parlance.plans.base import query
from parlance.runtime import read_table
from parlance.sources import io

_SPK = "ann_id long, iden string, output string, prompt_type string"
_ANSWERS = "SELECT ann_id, iden, output, prompt_type FROM speaker_chars"


def _answers(s, sf):
    return read_table(s, sf, "speaker_chars").select("ann_id", "iden", "output", "prompt_type")


@query("scan_csv_split", "SELECT o_orderkey, o_orderpriority, 'train' AS split FROM orders")
def scan_csv_split(s, sf):
    p = io.write_csv(read_table(s, sf, "orders").select("o_orderkey", "o_orderpriority"), io.scratch(s, "csv"))
    return io.read_csv(s, p, "o_orderkey long, o_orderpriority string", "train")


@query("scan_benchmark", "SELECT row_id, split, true AS erc_target FROM utterance WHERE source = 'meld' AND split IN ('train', 'dev')")
def scan_benchmark(s, sf):
    u = read_table(s, sf, "utterance").filter((F.col("source") == "meld") & F.col("split").isin("train", "dev"))
    return u.select("row_id", "split").withColumn("erc_target", F.lit(True))


@query("scan_both", "SELECT row_id, source, CASE WHEN source = 'iemocap' THEN erc_target END AS erc_target FROM utterance WHERE split = 'test'")
def scan_both(s, sf):
    """Both corpora under one schema; the first has no target flag."""
    u = read_table(s, sf, "utterance").filter(F.col("split") == "test")
    a = u.filter(F.col("source") == "meld").select("row_id", "source")
    b = u.filter(F.col("source") == "iemocap").select("row_id", "source", "erc_target")
    return b.unionByName(a, allowMissingColumns=True)


_EVAL_SQL = "SELECT line_id, 'neu' AS emotion_code, start_sec AS start, end_sec AS \"end\" FROM transcript_line WHERE isfinite(start_sec) AND isfinite(end_sec)"


@query("scan_eval_text", _EVAL_SQL)
def scan_eval_text(s, sf):
    """Evaluation lines with comments and blank lines between them."""
    t = read_table(s, sf, "transcript_line").filter("not isnan(start_sec) and not isnan(end_sec)")
    line = F.concat(F.lit("["), F.col("start_sec").cast("string"), F.lit(" - "), F.col("end_sec").cast("string"), F.lit("]\tL"), F.col("line_id").cast("string"), F.lit("\tneu\t[2.5, 2.5, 2.5]"))
    p = io.scratch(s, "eval")
    t.select(F.explode(F.array(line, F.lit(""), F.lit("% a comment"))).alias("value")).write.text(p)
    return io.read_eval(s, p).select(F.substring("turn_id", 2, 20).cast("long").alias("line_id"), "emotion_code", "start", "end")


@query("scan_transcript_text", "SELECT 'L' || line_id AS turn_id, regexp_replace(utterance, '^\\s+|\\s+$', '', 'g') AS text FROM transcript_line WHERE isfinite(start_sec) AND isfinite(end_sec) AND utterance IS NOT NULL AND NOT contains(utterance, chr(10))")
def scan_transcript_text(s, sf):
    """Equal turn ids: the last line wins."""
    t = read_table(s, sf, "transcript_line").filter("not isnan(start_sec) and not isnan(end_sec) and utterance is not null").filter(~F.col("utterance").contains("\n"))
    head = F.concat(F.lit("L"), F.col("line_id").cast("string"), F.lit(" ["), F.col("start_sec").cast("string"), F.lit("-"), F.col("end_sec").cast("string"), F.lit("]: "))
    two = t.select(F.explode(F.array(F.struct(F.lit(0).alias("n"), F.concat(head, F.lit("an older text")).alias("value")), F.struct(F.lit(1).alias("n"), F.concat(head, "utterance").alias("value")))).alias("x")).select("x.*")
    return io.parse_transcript(two, F.col("value"), "n")


@query("scan_dir_pairs", "SELECT dialog_id, count(*) AS lines FROM transcript_line GROUP BY dialog_id")
def scan_dir_pairs(s, sf):
    """Files of two folders paired by the part of the path that names the dialogue."""
    t = read_table(s, sf, "transcript_line").select("line_id", "dialog_id")
    a, b = io.scratch(s, "pairs-a"), io.scratch(s, "pairs-b")
    t.select("dialog_id", F.col("line_id").cast("string").alias("value")).repartition("dialog_id").write.partitionBy("dialog_id").text(a)
    t.groupBy("dialog_id").agg(F.lit("x").alias("value")).repartition("dialog_id").write.partitionBy("dialog_id").text(b)
    stem = F.regexp_extract(F.col("_metadata.file_path"), "dialog_id=([^/]*)/", 1)
    left = s.read.option("recursiveFileLookup", True).text(a).select(stem.alias("dialog_id")).groupBy("dialog_id").agg(F.count(F.lit(1)).alias("lines"))
    return left.join(s.read.option("recursiveFileLookup", True).text(b).select(stem.alias("dialog_id")), "dialog_id").select("dialog_id", "lines")


def _files(s, rows, name, folder):
    """One text file a row below ``folder``; the column ``name`` is the file's path there."""
    made = io.scratch(s, folder)

    def write(batches):
        import os

        import pandas as pd

        for b in batches:
            for x, t in zip(b["name"], b["value"]):
                os.makedirs(os.path.dirname(f"{root}/{x}"), exist_ok=True)
                with open(f"{root}/{x}", "wb") as f:
                    f.write(bytes(t))
            yield pd.DataFrame({"name": b["name"]})

    root = made.removeprefix("file:")
    rows.select(F.col(name).alias("name"), F.col("value").cast("binary").alias("value")).mapInPandas(write, "name string").count()
    return made


@query("scan_wav", "SELECT n_nationkey, n_nationkey::DOUBLE AS seconds, 8000.0::DOUBLE AS rate_hz FROM nation")
def scan_wav(s, sf):
    """Audio files are read as binary files and measured in batches; files of known length are made first."""
    head = (b"RIFF" + bytes(20) + (8000).to_bytes(4, "little") * 2 + bytes(12)).hex()
    content = F.unhex(F.concat(F.lit(head), F.repeat(F.lit("00"), F.col("n_nationkey") * 8000)))
    p = _files(s, read_table(s, sf, "nation").select(F.concat(F.lit("a/"), F.col("n_nationkey").cast("string"), F.lit(".wav")).alias("name"), content.alias("value")), "name", "wav")
    files = s.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(p).select("path", "content")
    key = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("int")
    return external.features(files, external.WaveLength()).select(key.alias("n_nationkey"), "seconds", "rate_hz")


_JOBS = "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'final_videos_testdia' ELSE 'dia' END || n_nationkey || '.mp4' AS chosen FROM nation"


@query("scan_mp4_jobs", _JOBS)
def scan_mp4_jobs(s, sf):
    """A listing of a folder; the prefixed file of a stem is taken where there is one."""
    n = read_table(s, sf, "nation").select("n_nationkey", F.concat(F.lit("dia"), F.col("n_nationkey").cast("string"), F.lit(".mp4")).alias("name"))
    both = n.select("name").unionByName(n.filter("n_nationkey % 3 = 0").select(F.concat(F.lit("final_videos_test"), "name").alias("name")))
    p = _files(s, both.withColumn("value", F.lit("x")), "name", "mp4")
    found = io.listing(s, p, "*.mp4").select(F.element_at(F.split("path", "/"), -1).alias("name"))
    stem = F.regexp_replace("name", "^final_videos_test", "")
    one = found.groupBy(stem.alias("stem")).agg(F.max_by("name", F.length("name")).alias("chosen"))
    return one.select(F.regexp_extract("stem", r"(\d+)", 1).cast("int").alias("n_nationkey"), "chosen")


@query("sink_wav", "SELECT n_nationkey, n_nationkey % 2 = 0 AS done FROM nation")
def sink_wav(s, sf):
    """Jobs go through a converter outside; a file is done if its return code is 0. The converter here fails on odd ones."""
    jobs = read_table(s, sf, "nation").select("n_nationkey", F.format_string("in/%d.mp4", "n_nationkey").alias("src"))
    dst = F.concat(F.lit(io.scratch(s, "wav-out").removeprefix("file:") + "/"), F.regexp_replace(F.element_at(F.split("src", "/"), -1), "mp4$", "wav"))
    stub = ["sh", "-c", 'case "$3" in *[02468].mp4) exit 0;; *) exit 3;; esac', "stub"]
    done = io.mp4_to_wav(jobs.select("src", dst.alias("dst")), stub)
    return jobs.join(done, "src").select("n_nationkey", (F.col("rc") == 0).alias("done"))


@query("scan_jsonl", _ANSWERS)
def scan_jsonl(s, sf):
    return io.read_jsonl(s, io.write_jsonl(_answers(s, sf), io.scratch(s, "jsonl")), _SPK)


@query("sink_jsonl", _ANSWERS)
def sink_jsonl(s, sf):
    return io.read_jsonl(s, io.write_jsonl(_answers(s, sf), io.scratch(s, "jsonl")), _SPK)


@query("scan_jsonl_multi", "SELECT prompt_type, count(*) AS n FROM speaker_chars GROUP BY 1")
def scan_jsonl_multi(s, sf):
    """Several folders in one scan."""
    a = _answers(s, sf)
    paths = [io.write_jsonl(a.filter(F.col("prompt_type") == k), io.scratch(s, k)) for k in ("reaction", "intention", "mental_state")]
    return io.read_jsonl(s, paths, _SPK).groupBy("prompt_type").agg(F.count(F.lit(1)).alias("n"))


@query("scan_json_doc", "SELECT r_regionkey, r_name FROM region")
def scan_json_doc(s, sf):
    p = io.scratch(s, "doc")
    rows = read_table(s, sf, "region").agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("value"))  # five rows
    rows.write.text(p)
    return io.read_json_document(s, p, "r_regionkey int, r_name string")


@query("scan_json_index", "SELECT n_name, n_nationkey FROM nation")
def scan_json_index(s, sf):
    p = io.write_json_index(read_table(s, sf, "nation").select("n_name", "n_nationkey"), io.scratch(s, "index"), "n_name")
    return io.read_json_index(s, p, "n_nationkey int").select(F.col("key").alias("n_name"), "n_nationkey")


@query("sink_json", "SELECT n_name, n_nationkey FROM nation")
def sink_json(s, sf):
    """An indented document with the time in its name, for bounded results (larger ones are written as lines)."""
    p = io.write_json(read_table(s, sf, "nation").select("n_name", "n_nationkey"), io.scratch(s, "json"), "nations")
    return io.read_json_document(s, p, "n_name string, n_nationkey int")


@query("scan_largest_artifact", "SELECT 'meld_size' || max(n_nationkey) || '.json' AS name FROM nation")
def scan_largest_artifact(s, sf):
    """A listing of a folder; names whose size is no number count as 0, other prefixes do not count."""
    n = read_table(s, sf, "nation").select(F.explode(F.array(*[F.format_string(f, "n_nationkey") for f in ("MELD_size%d.json", "MELD_size9%d_x.json", "IEMOCAP_size9%d.json", "MELD.size/%d.txt")])).alias("name"))
    p = _files(s, n.withColumn("value", F.lit("{}")), "name", "artifacts")
    return io.largest_artifact(io.listing(s, p, "*.json"), "path", "meld").select(F.lower(F.element_at(F.split("path", "/"), -1)).alias("name"))


_PREFIX = "reaction of potential listeners: "


@query("scan_hints", f"""WITH a AS (SELECT iden, max(output) o FROM speaker_chars WHERE annotator = 'annotator-b' AND length(output) > 0 GROUP BY 1), b AS (SELECT iden, max(output) o FROM speaker_chars WHERE annotator = 'annotator-c' AND output IS NOT NULL GROUP BY 1)
 SELECT iden, '{_PREFIX}' || coalesce(a.o, b.o) AS hint FROM a FULL JOIN b USING (iden)""")
def scan_hints(s, sf):
    """Hints of two models: the first wins where it says something."""
    x = read_table(s, sf, "speaker_chars")
    return io.merge_hints(x.filter(F.col("annotator") == "annotator-b"), x.filter(F.col("annotator") == "annotator-c"), "iden", "output", _PREFIX)


@query("vector_open", "SELECT count(*) AS vectors FROM embeddings")
def vector_open(s, sf):
    """A vector collection is a table; an empty one is an error."""
    e = read_table(s, sf, "embeddings")
    if e.isEmpty():
        raise ValueError("the collection is empty")
    return e.agg(F.count(F.lit(1)).alias("vectors"))


@query("vector_exists", "SELECT DISTINCT label, true AS here, false AS elsewhere FROM embeddings")
def vector_exists(s, sf):
    """Collections are folders of a store; each label has one here, and none under another name."""
    p = io.scratch(s, "store")
    read_table(s, sf, "embeddings").select("vec_id", "label").write.partitionBy("label").parquet(p)
    there = io.listing(s, p, "*.parquet").select(F.regexp_extract("path", r"/label=([^/]+)/", 1).alias("n")).distinct()
    labels = read_table(s, sf, "embeddings").select("label").distinct()
    named = labels.join(there, F.col("label").cast("string") == F.col("n"), "left").select("label", F.col("n").isNotNull().alias("here"))
    other = there.select(F.col("n").alias("m"))
    return named.join(other, F.concat(F.lit("other-"), F.col("label").cast("string")) == F.col("m"), "left").select("label", "here", F.col("m").isNotNull().alias("elsewhere"))


@query("sink_csv", "SELECT doc_id, text FROM documents WHERE text <> ''")
def sink_csv(s, sf):
    """Quotes, commas and line ends in texts survive."""
    p = io.write_csv(read_table(s, sf, "documents").select("doc_id", "text").filter("text <> ''"), io.scratch(s, "csv"))
    return s.read.schema("doc_id long, text string").option("header", True).option("escape", '"').option("multiLine", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(p)


@query("sink_parquet", "SELECT doc_id, text, epoch_us(captured_at) AS at_us FROM documents")
def sink_parquet(s, sf):
    p = io.scratch(s, "parquet")
    read_table(s, sf, "documents").select("doc_id", "text", "captured_at").write.parquet(p)
    return s.read.parquet(p).select("doc_id", "text", F.unix_micros("captured_at").alias("at_us"))


@query("sink_vectors", "SELECT doc_id, 64 AS dims, doc_id % 10 = 0 AS fresh FROM documents")
def sink_vectors(s, sf):
    """Embed in Arrow batches; vectors added again replace those of their ids (clear, then add)."""
    d = read_table(s, sf, "documents").select("doc_id", retrieval.hash_embedding(F.col("text")).alias("embedding"))
    old, p = io.scratch(s, "vectors"), io.scratch(s, "vectors")
    d.withColumn("fresh", F.lit(False)).write.parquet(old)
    io.replace_by_id(s.read.parquet(old), d.filter("doc_id % 10 = 0").withColumn("fresh", F.lit(True)), "doc_id", p)
    return s.read.parquet(p).select("doc_id", F.size("embedding").alias("dims"), "fresh")


@query("sink_cache", "WITH d AS (SELECT a.vec_id query_id, b.vec_id doc_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) x FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) SELECT query_id AS idx, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9), doc_id) - 1 AS rank, doc_id AS neighbour FROM d QUALIFY rank < 10")
def sink_cache(s, sf):
    """The neighbours of every asked vector as rows (idx, rank, neighbour) of a table partitioned by collection; vectors
    that are in the cache are not searched again."""
    e = read_table(s, sf, "embeddings")
    asked, p = e.filter("vec_id % 20 = 0"), io.scratch(s, "cache")
    for part in (asked.filter("vec_id % 40 = 0"), asked):
        retrieval.extend_cache(s, p, "flow_7", part, e, "vec_id", "embedding", 10)
    return s.read.parquet(p).filter(F.col("collection") == "flow_7").select("idx", "rank", "neighbour")


@query("sink_skip_if_exists", "SELECT count(*) AS n FROM region")
def sink_skip_if_exists(s, sf):
    p = io.scratch(s, "skip")
    r = read_table(s, sf, "region")
    r.write.parquet(p)
    r.unionByName(r).write.mode("ignore").parquet(p)
    return s.read.parquet(p).agg(F.count(F.lit(1)).alias("n"))


@query("sink_error_if_exists", "SELECT r_regionkey, 1 AS copies FROM region")
def sink_error_if_exists(s, sf):
    """The second write is refused, and what was there stays as it was."""
    from pyspark.errors import AnalysisException

    p = io.scratch(s, "error")
    r = read_table(s, sf, "region").select("r_regionkey")
    r.write.parquet(p)
    try:
        r.write.mode("errorifexists").parquet(p)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
    else:
        raise AssertionError("a folder that exists was written again")
    return s.read.parquet(p).groupBy("r_regionkey").agg(F.count(F.lit(1)).cast("int").alias("copies"))


@query("scan_checkpoints", "SELECT 'run-' || n_regionkey AS run, 'checkpoint-' || max(n_nationkey) AS newest FROM nation GROUP BY n_regionkey")
def scan_checkpoints(s, sf):
    """Folders of checkpoints found in a listing, the last of each run by its number."""
    n = read_table(s, sf, "nation").select(F.format_string("run-%d/checkpoint-%d/adapter.bin", "n_regionkey", "n_nationkey").alias("name"), F.lit("x").alias("value"))
    more = n.withColumn("name", F.regexp_replace("name", "checkpoint-", "final_model-"))
    found = io.listing(s, _files(s, n.unionByName(more), "name", "runs")).select(F.regexp_extract("path", "/(run-[^/]+)/", 1).alias("run"), F.regexp_extract("path", "/(checkpoint-[^/]+)/[^/]+$", 1).alias("c")).filter("c <> ''")
    return found.groupBy("run").agg(F.max_by("c", F.regexp_extract("c", r"(\d+)$", 1).cast("int")).alias("newest"))


@query("artifact_path", "SELECT 'db=flow_window=7_k=' || r_regionkey AS name FROM region")
def artifact_path(s, sf):
    r = read_table(s, sf, "region")
    return r.select(F.concat(F.lit(io.artifact_name(db="flow", window=7, model=None) + "_k="), F.col("r_regionkey").cast("string")).alias("name"))
