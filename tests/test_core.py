"""Core operators on hand-made cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import labels as L
from parlance.functions import text as X
from parlance.operators import binning, dialogue, external, impute, metrics, retrieval
from parlance.operators.prefix import hash_key, rank_in_group, take_smallest
from parlance.sources import io

TURNS = [
    ("d", 0, "Ann", "Hi Bob", "joyful"),
    ("d", 1, "Bob", "hello ann", "neutral"),
    ("d", 2, "Ann", "Bob, bob's here?", "surprised"),
    ("d", 3, "Cy", "ok", "unknown"),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(TURNS, "dialog string, turn int, speaker string, utterance string, label string")


def test_take_smallest_equals_sorting(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", i, rng.randrange(1, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id long, size long").withColumn("k", hash_key(3, F.col("id")))
    budget = spark.createDataFrame([("hot", 1000), ("g1", 7), ("g2", 10**9), ("g3", 0)], "g string, __budget long")
    got = {r["id"] for r in take_smallest(df, "g", "k", "id", "size", budget).collect()}
    want = set()
    for g, b in (("hot", 1000), ("g1", 7), ("g2", 10**9), ("g3", 0)):
        total = 0
        for r in sorted((r for r in df.collect() if r["g"] == g), key=lambda r: (r["k"], r["id"])):
            total += r["size"]
            if total > b:
                break
            want.add(r["id"])
    assert got == want


def test_rank_in_group_is_dense(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, "a").otherwise("b")).withColumn("k", hash_key(1, F.col("id")))
    r = rank_in_group(df, "g", "k", "id", "r").groupBy("g").agg(F.sort_array(F.collect_list("r")).alias("r")).collect()
    assert {x["g"]: list(x["r"]) == list(range(len(x["r"]))) for x in r} == {"a": True, "b": True}


def test_alias_anonymise_history_flow(turns):
    a = dialogue.aliases(turns, ["dialog"], "speaker", "turn")
    assert [r[0] for r in a.orderBy("turn").select("alias").collect()] == ["Speaker_0", "Speaker_1", "Speaker_0", "Speaker_2"]
    b = dialogue.aliases(turns, ["dialog"], "speaker", "turn", letters=True)
    assert b.orderBy("turn").select("alias").collect()[3][0] == "Speaker_C"
    c = dialogue.cast_of(turns, ["dialog"], "speaker", "turn")
    t = turns.join(c, "dialog").orderBy("turn").select(X.anonymize(F.col("utterance"), F.col("cast"))).collect()
    assert t[2][0] == "Speaker_1, Speaker_1's here?"
    line = F.concat("speaker", F.lit(": "), "utterance")
    h = turns.select("turn", dialogue.history(["dialog"], "turn", line, 1).alias("h")).orderBy("turn").collect()
    assert h[2]["h"] == "Bob: hello ann\nAnn: Bob, bob's here?"
    known = dialogue.position(turns.filter("label <> 'unknown'"), ["dialog"], ["turn"])
    flow = known.select("pos", dialogue.flow_text(dialogue.label_flow(["dialog"], "pos", L.label_id(F.col("label")), 3)).alias("f")).filter("pos + 1 > 1").orderBy("pos").collect()
    assert [r["f"] for r in flow] == ["[5, 6]", "[5, 6, 8]"]


def test_nested_names_follow_the_order(spark):
    df = spark.createDataFrame([("d", 0, "Joey", "x"), ("d", 1, "Joey's Hand Twin", "Joey's Hand Twin waves")], "d string, t int, s string, u string")
    c = dialogue.cast_of(df, ["d"], "s", "t")
    got = df.join(c, "d").filter("t = 1").select(X.anonymize(F.col("u"), F.col("cast"))).first()[0]
    assert got == "Speaker_0's Hand Twin waves"


def test_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 12)], "v double")
    q = binning.quantiles(df, "v", [0.3, 0.7]).first()["q"]
    assert list(q) == [4.0, 8.0]
    x = spark.createDataFrame([(3.99,), (4.0,), (7.99,), (8.0,), (float("nan"),), (None,)], "v double")
    got = [r[0] for r in x.select(binning.digitize(F.col("v"), F.array(F.lit(4.0), F.lit(8.0)), binning.NAMES[3])).collect()]
    assert got == ["low", "medium", "medium", "high", None, None]
    assert binning.cuts(3, "iemocap") == [0.25, 0.75] and binning.cuts(2) == [0.5]


def test_first_per_group_and_prefetch(spark):
    ranked = ["m_1_0", "i_4_2", "m_2_5", "m_2_1", "m_3_0", "i_5_1"]
    df = spark.createDataFrame([("q", i, x) for i, x in enumerate(ranked)], "q string, r int, idx string").withColumn("g", X.key_dialog(F.col("idx")))
    top = lambda d, n: [r["idx"] for r in retrieval.first_per_group(d, "q", "g", "r", n).orderBy("new_rank").collect()]
    assert top(df, 2) == ["m_1_0", "i_4_2"] and top(df, 3) == ["m_1_0", "i_4_2", "m_2_5"]
    assert top(df.filter("idx like 'm%' and g <> 'm_1'"), 2) == ["m_2_5", "m_3_0"]
    bad = spark.createDataFrame([("q", 1, "bad"), ("q", 2, "bad"), ("q", 3, "ok"), ("q", 4, "ok")], "q string, r int, l string")
    assert retrieval.prefetch_then_filter(bad, "q", "r", 3, F.col("l") == "ok", 2).count() == 1


def test_history_step_costs_less_than_sorting_a_frame(spark, monkeypatch):
    import time
    from types import SimpleNamespace

    import pandas as pd
    from pyspark.sql import DataFrame

    from parlance.streaming import streams

    got = {}
    df = spark.createDataFrame([("d", 1, "x")], "d string, t long, x string")
    monkeypatch.setattr("pyspark.sql.group.GroupedData.applyInPandasWithState", lambda self, f, *a: got.setdefault("step", f))
    assert isinstance(df, DataFrame) and streams.history_stream(df, "d", "t", F.col("x"), 2)
    held = []
    state = SimpleNamespace(exists=False, get=(["old"],), update=held.append)
    frames = [pd.DataFrame({"turn": [3, 1], "line": ["c", "a"]}), pd.DataFrame({"turn": [1, None], "line": ["", "z"]})]
    (out,) = got["step"](("d",), iter(frames), state)
    assert out["history"].tolist() == ["", "a", "a\nc", "a\nc\nz"] and held == [(["c", "z"],)]
    b = pd.DataFrame({"turn": list(range(10))[::-1], "line": ["some words"] * 10})
    began = time.process_time()
    for _ in range(300):
        list(got["step"](("d",), iter([b]), state))
    step = time.process_time() - began
    began = time.process_time()
    for _ in range(300):
        pd.concat([b]).sort_values(["turn", "line"], kind="stable")
    assert step < time.process_time() - began


def test_history_is_written_without_python(spark, tmp_path, monkeypatch):
    import os

    from parlance.plans.streams import stream_history
    from parlance.streaming import streams

    says = [
        [("d", 2, "A", "two"), ("d", 1, "A", "\n"), ("e", 1, "B", "x"), (None, 3, "C", "n")],
        [("e", 0, "B", "late"), ("f", 5, "B", None), ("e", 7, "B", "y"), ("e", 7, "B", "w")],
        [("d", 3, "A", "three\n"), ("e", 8, "B", "z"), (None, 4, None, "m"), ("d", 4, "A", "\n\r")],
        [("g", None, "A", "no place"), ("e", 9, "B", "end")],
    ]
    for i, rows in enumerate(says):
        spark.createDataFrame(rows, "dialog_id string, turn_idx long, speaker string, utterance string").coalesce(1).write.parquet(str(tmp_path / f"made{i}"))
        (part,) = (tmp_path / f"made{i}").glob("part-*")
        (tmp_path / "utterance.parquet").mkdir(exist_ok=True)
        part.rename(to := tmp_path / f"utterance.parquet/part-{i}.parquet")
        os.utime(to, (1e9 + i, 1e9 + i))

    def read():
        return streams.read_stream(spark, str(tmp_path / "utterance.parquet"))

    line = F.concat_ws(": ", "speaker", "utterance")
    order = lambda df: sorted(map(repr, map(tuple, df.collect())))
    for k in (0, 1, 3):
        want = streams.run_once(streams.history_stream(read(), "dialog_id", "turn_idx", line, k), str(tmp_path / f"a{k}"), str(tmp_path / f"b{k}"))
        got = streams.write_history(read(), "dialog_id", "turn_idx", line, k, str(tmp_path / f"c{k}"), str(tmp_path / f"d{k}"))
        assert order(spark.read.parquet(got).select("dialog", "turn", "history")) == order(spark.read.parquet(want))
    monkeypatch.setattr("pyspark.sql.group.GroupedData.applyInPandasWithState", None)
    rows = {(r["dialog"], r["turn"]): r["history"] for r in stream_history(spark, str(tmp_path)).collect() if r["turn"] != 7}
    assert len(rows) == 11 and rows["d", 3] == "A: \n\nA: two\nA: three" and rows["e", 8] == "B: x\nB: late\nB: w\nB: y\nB: z"


def test_nearest_writes_vectors_once(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorSummary("driver").totalShuffleWrite()
    got = {r["query_id"]: r["doc_id"] for r in retrieval.nearest(df.filter("id % 5 = 0"), df, "id", "v", 2, block=50).filter("rank = 2").collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert store.executorSummary("driver").totalShuffleWrite() - before < v.nbytes
    far = ((v[::5, None, :] - v[None]) ** 2).sum(2)
    assert got == {5 * i: int(x[1]) for i, x in enumerate(np.argsort(far, axis=1))}


def _pairs(v, asked, block):
    """Blocks of documents with all blocks of queries, packed."""
    import zlib

    import numpy as np
    import pandas as pd

    def blocks(rows, no, ids, vs):
        return [{no: n, ids: rows[s : s + block].astype("int64").tobytes(), vs: zlib.compress(v[rows[s : s + block]].tobytes(), 1)} for n, s in enumerate(range(0, len(rows), block))]

    d, q = blocks(np.arange(len(v)), "no", "ids", "vs"), blocks(asked, "q_no", "q_ids", "q_vs")
    return [pd.DataFrame([x | y for y in q]) for x in d]


@pytest.mark.parametrize("kind", ["even", "copies", "long", "tiny", "huge", "nan", "few", "same", "counts"])
def test_walk_equals_brute_force(kind):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    v = rng.normal(size=(3 if kind == "few" else 1203, 16)) + 0.5
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "copies":
        v = v[rng.integers(0, 40, len(v))]
    elif kind == "long":
        v = v * np.exp(rng.normal(size=(len(v), 1)) * 3)
    elif kind in ("tiny", "huge"):
        v = v * (1e-3 if kind == "tiny" else 1e70)
    elif kind == "nan":
        v[::50, 3] = np.nan
    elif kind == "same":
        v[:] = v[0]
    elif kind == "counts":
        v = rng.integers(-2, 3, v.shape).astype("float64")
    asked = np.arange(0, len(v), 7)
    out = pd.concat(retrieval._walk(5)(_pairs(v, asked, 101)))
    got = {i: g["doc_id"].tolist() for i, g in out.groupby("query_id")}
    for i in asked:
        d = ((v - v[i]) ** 2).sum(1).round(9)
        assert got[i] == sorted(range(len(v)), key=lambda j: (np.isnan(d[j]), d[j] if d[j] == d[j] else 0, j))[:5]


def test_walk_costs_less_than_products():
    import time

    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.normal(size=(81_920, 64)) + 0.75
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    pairs = _pairs(v, np.arange(1024), 4096)
    began = time.process_time()
    list(retrieval._walk(10)(pairs))
    walk = time.process_time() - began
    began = time.process_time()
    for s in range(0, len(v), 4096):
        for q in range(0, 1024, 256):
            x, y = v[q : q + 256], v[s : s + 4096]
            dist = (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None, :]
            np.nonzero(~(dist > 0.1))
    plain = time.process_time() - began
    assert walk < plain


def test_nearest_equals_brute_force_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).round(3)
    v[7] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(999, None)], "id long, v array<double>")
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in retrieval.nearest(df.filter("id % 20 = 0"), df, "id", "v", 5, block=50).collect()}
    for q in range(0, 300, 20):
        d = ((v - v[q]) ** 2).sum(1).round(9)
        assert [got[(q, k + 1)] for k in range(5)] == sorted(range(300), key=lambda i: (d[i], i))[:5]


def test_labels_in_text(spark):
    df = spark.createDataFrame([("I think SAD, not joyful",), ("happy",), ("so angry",)], "t string")
    first = [r[0] for r in df.select(X.first_label(F.col("t"), L.SHOWN)).collect()]
    one = [r[0] for r in df.select(X.single_label(F.col("t"), L.SHOWN)).collect()]
    assert first == ["sad", "NoValidEmotionFound", "angry"]
    assert one == ["MultipleValidEmotionsFound", "NoValidEmotionFound", "angry"]


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")], "y string, p string")
    assert metrics.accuracy(df, "y", "p").first()[0] == 0.5
    assert metrics.f1_weighted(df, "y", "p").first()[0] == 0.5
    assert metrics.lcs_f("a b c d".split(), "a c d x".split()) == pytest.approx(0.75)
    assert metrics.lcs_f([], ["a"]) == 0.0


def test_mask_and_padding(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 3, 9, 0])], "p array<int>, f array<int>")
    m = df.select(external.masked(F.col("p"), F.col("f"), 4).alias("m"), external.masked(F.col("p"), F.col("f"), 2).alias("n")).first()
    assert list(m["m"]["input_ids"]) == [1, 2, 3, 9] and list(m["m"]["labels"]) == [-100, -100, -100, 9] and list(m["n"]["labels"]) == [-100, -100]
    assert list(df.select(external.padded(F.col("p"), F.lit(5), 0, True)).first()[0]) == [0, 0, 1, 2, 3]


def test_factorize_and_positions(spark):
    df = spark.createDataFrame([(0, "train|5"), (1, "train|2"), (2, "train|5"), (3, "dev|5")], "row long, k string")
    f = dialogue.factorize(df, ["k"], F.col("row"))
    assert [r["group_idx"] for r in f.orderBy("row").collect()] == [0, 1, 0, 2]
    assert [r["pos"] for r in dialogue.position(df, ["k"], ["row"]).orderBy("row").collect()] == [0, 0, 1, 0]


def test_text_functions(spark):
    df = spark.createDataFrame([("a\x92b\x91\x93\x94\x97\x85c", "\n x \n")], "t string, s string")
    assert df.select(X.clean_controls(F.col("t"))).first()[0] == "a'b  c"
    assert df.select(X.strip_newlines(F.col("s"))).first()[0] == " x "
    got = df.select(X.template("<{a}|{b}>", a=F.lit("{b}"), b=F.lit(None).cast("string"))).first()[0]
    assert got == "<{b}|>"
    with pytest.raises(KeyError):
        X.template("{missing}")


def test_sources(spark, tmp_path):
    t = spark.createDataFrame([("[6.29 - 8.23]\tSes01F_impro01_F000\tneu\t[2.5, 2.5, 2.5]",), ("% c",), ("",)], "value string")
    r = io.parse_eval(t, F.col("value")).first()
    assert (r["turn_id"], r["start"], r["emotion_code"]) == ("Ses01F_impro01_F000", 6.29, "neu")
    df = spark.createDataFrame([(1, 'a "q", b\nc'), (2, None)], "id int, s string")
    p = io.write_csv(df, str(tmp_path / "c"))
    assert sorted(io.read_csv(spark, p, "id int, s string").collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        io.require_columns(df, ["id", "nope"])


def _levels(spark, rows):
    return spark.createDataFrame(rows, "id long, d string, sp string, lev string, num double, filled string").withColumn("__id", F.lit("y")).withColumn("lev_was_missing", F.lit(1))


def test_imputation_masks_and_edges(spark):
    rows = [(i, "d1" if i % 2 else None, f"s{i % 3}", ["low", "High ", "very_high", None, "n/a", ""][i % 6], [1.0, float("nan"), None, 5.0, float("inf"), 2.0][i % 6], "x") for i in range(60)]
    r = impute.fill(_levels(spark, rows), "id", ["lev"], ["num"], ["d", "sp"])
    cells = {x["id"]: x["filled"] for x in r.cells.collect()}
    assert set(cells) == {i for i in range(60) if i % 6 in (3, 4, 5)}
    assert all(v in impute.LEVELS for v in cells.values())
    out = r.rows.collect()
    assert len(out) == 60 and all(x["filled"] == "x" and x["__id"] == "y" and math.isfinite(x["num"]) for x in out)
    assert {x["lev"] for x in out if not x["lev_was_missing"]} == {"low", "high", "very high"}


def test_imputation_without_any_value_or_row(spark):
    r = impute.fill(_levels(spark, [(1, "d", None, None, None, None)]), "id", ["lev"], ["num"], ["d", "sp"])
    assert [tuple(x) for x in r.cells.collect()] == [(1, "lev", None)]
    assert impute.fill(_levels(spark, []), "id", ["lev"], ["num"], ["d"]).rows.count() == 0


def test_imputation_held_out(spark):
    rng = random.Random(2)
    rows, truth = [], {}
    for i in range(2000):
        x = rng.gauss(0, 1)
        lev = ["low", "medium", "high"][(x > -0.5) + (x > 0.5)]
        hidden = i % 5 == 0
        if hidden:
            truth[i] = lev
        rows.append((i, f"d{i % 50}", f"s{i % 7}", None if hidden else lev, x, None))
    r = impute.fill(_levels(spark, rows), "id", ["lev"], ["num"], ["d", "sp"], noise=False)
    hits = sum(truth[x["id"]] == x["filled"] for x in r.cells.collect())
    assert hits / len(truth) > 0.75


def test_quantiles_per_group_with_ties(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [("a" if i % 3 else "b", float(rng.integers(0, 9)) if i % 2 else 4.0) for i in range(501)] + [("a", None), ("b", float("nan")), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["grp"]: list(r["q"]) for r in binning.quantiles_by(df, "v", "g", [0.1, 0.5, 0.93], ["a", "b", "none"]).collect()}
    ok = [(g, v) for g, v in rows if v is not None and v == v]
    want = {k: np.quantile([v for g, v in ok if k in ("ALL", g)], [0.1, 0.5, 0.93]).tolist() for k in ("a", "b", "ALL")}
    assert {k: got[k] for k in want} == {k: pytest.approx(v) for k, v in want.items()} and got["none"] == got["ALL"]
    assert binning.quantiles(df.limit(0), "v", [0.5]).first()["q"] is None


def test_running_sums_over_a_whole_table(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("v")).repartition(5)
    got = {r["id"]: (r["n"], r["s"]) for r in dialogue.running(df, [F.col("id")], {"n": F.lit(1), "s": F.col("v")}).collect()}
    assert all(got[i] == (i + 1, sum(j % 7 for j in range(i + 1))) for i in (0, 1, 499, 999))


def test_index_finds_most_and_all_with_every_cell(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 8)) + rng.integers(0, 5, (400, 1)) * 4
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(999, None)], "id long, v array<double>")
    exact = {(r["query_id"], r["doc_id"]) for r in retrieval.nearest(df, df, "id", "v", 5).collect()}
    index = retrieval.build_index(df, "id", "v", cells=10)
    assert index.docs.count() == 400
    some = {(r["query_id"], r["doc_id"]) for r in retrieval.nearest_indexed(df, index, "id", "v", 5, 4, block=30).collect()}
    every = {(r["query_id"], r["doc_id"]) for r in retrieval.nearest_indexed(df, index, "id", "v", 5, 10, block=30).collect()}
    assert every == exact and len(some & exact) >= 0.9 * len(exact)


def test_hints_listings_and_lines(spark):
    a = spark.createDataFrame([("x", "a"), ("y", ""), ("z", None)], "k string, t string")
    b = spark.createDataFrame([("x", "b"), ("y", "c"), ("w", "")], "k string, t string")
    assert {r["k"]: r["hint"] for r in io.merge_hints(a, b, "k", "t", "p: ").collect()} == {"x": "p: a", "y": "p: c", "w": "p: "}
    files = spark.createDataFrame([("/d/MELD_size9.json",), ("/d/meld_size12_x.json",), ("/d/MELD.json",), ("/d/iemocap_size99.json",)], "path string")
    assert io.largest_artifact(files, "path", "meld").first()[0] == "/d/MELD_size9.json"
    bad = ["[1 - x]\tT1\tneu\t[1, 2, 3]", "[1 - 2]\tT1\tNEU\t[1, 2, 3]", "[1 - 2]\tT1\tneu\t[1, 2]", "[1 - 2] T1 x neu [1, 2, 3]", "plain", None]
    t = spark.createDataFrame([(x,) for x in [*bad, " [1 - 2.5] T1 neu [1, 2.5, -3] "]], "value string")
    assert [tuple(r)[1:] for r in io.parse_eval(t, F.col("value")).collect()] == [("T1", 1.0, 2.5, "neu")]
    lines = spark.createDataFrame([(0, "T1 [1.0-2.0]: old"), (1, "T1 [1.0-2.0]:  say [it]: now "), (2, "T2 [a-b]: no"), (3, "none"), (4, None)], "n int, value string")
    assert [tuple(r) for r in io.parse_transcript(lines, F.col("value"), "n").collect()] == [("T1", "say [it]: now")]


def test_overlap_counts_are_clipped(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "b"]), ([], ["a"]), (None, ["a"])], "p array<string>, r array<string>")
    got = [[tuple(x) for x in r[0]] for r in df.select(metrics.shared_ngrams(F.col("p"), F.col("r"), 2)).collect()]
    assert got == [[(2, 3, 3), (1, 2, 2)], [(0, 0, 1), (0, 0, 0)], [(0, 0, 1), (0, 0, 0)]]


def test_characteristics_need_whole_rows(spark):
    from parlance.operators import prompts

    rows = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, v int")
    answers = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "iden string, o string")
    assert prompts.characteristics_set(answers, rows, "k", "iden", cover=False).count() == 2
    with pytest.raises(ValueError):
        prompts.characteristics_set(answers, rows, "k", "iden")
    assert "{demonstrations}" not in prompts.recognition(examples=False) and prompts.choose(None, True, False) == prompts.recognition(examples=False)
    assert prompts.Options(kind="flow", detailed=True).name == "flowV2_n2_m7"
