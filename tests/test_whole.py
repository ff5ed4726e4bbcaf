"""Queries do the whole job: every candidate, every line, every demonstration."""

import glob
import os

import numpy as np
import pytest
import test_contract
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parlance.functions import text as X
from parlance.operators import metrics
from parlance.plans import relational


@pytest.fixture(scope="module")
def few_vectors(spark, sf, tmp_path_factory):
    """The tables with 30 vectors, on which several turns fall each."""
    out = tmp_path_factory.mktemp("few")
    for p in glob.glob(f"{sf}/*.parquet"):
        if os.path.basename(p) != "embeddings.parquet":
            os.symlink(p, out / os.path.basename(p))
    spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id < 30").toPandas().to_parquet(out / "embeddings.parquet")
    return str(out)


def test_every_labelled_training_turn_can_be_shown(spark, few_vectors):
    for name in ("prompt_records", "prompt_hybrid_detailed", "prompt_hybrid_valid", "prompt_single_n3"):
        test_contract.test_against_sql(spark, few_vectors, name)


def test_greedy_match(spark, sf):
    at = {"a": [2.0, 0.0], "b": [0.0, 1.0], "c": [3.0, 4.0], "0": [0.0, 0.0]}
    df = spark.createDataFrame([(1, ["a", "c"], ["b", "c", "a"]), (2, ["a"], ["b"]), (3, [], ["a"]), (4, None, ["a"]), (5, ["c"], ["a", "0"])], "i int, p array<string>, r array<string>")
    got = {r["i"]: tuple(r["m"]) for r in df.select("i", metrics.bertscore(F.col("p"), F.col("r"), lambda ws: np.array([at[w] for w in ws])).alias("m")).collect()}
    assert got[1] == pytest.approx((1.0, 2.8 / 3, 5.6 / 5.8)) and got[5] == pytest.approx((0.6, 0.3, 0.4))
    assert got[2] == got[3] == got[4] == (0.0, 0.0, 0.0)
    # the query: a loop over all pairs, token by token
    pairs = [(list(r["p"]), list(r["r"])) for r in relational._consecutive(spark, sf).select("p", "r").collect()]
    cos = lambda x, y: float(metrics.word_vectors([x])[0] @ metrics.word_vectors([y])[0])
    want = [(sum(max(cos(x, y) for y in r) for x in p) / len(p), sum(max(cos(x, y) for x in p) for y in r) / len(r)) if p and r else (0.0, 0.0) for p, r in pairs]
    row = entry.queries()["agg_bertscore_match"](spark, sf).first()
    assert row["pairs"] == len(pairs) > 100
    assert row["precision"] == pytest.approx(sum(p for p, _ in want) / len(want), abs=2e-6)
    assert row["recall"] == pytest.approx(sum(r for _, r in want) / len(want), abs=2e-6)
    assert row["f1"] == pytest.approx(sum(2 * p * r / (p + r) if p + r else 0 for p, r in want) / len(want), abs=2e-6)


def test_every_line_has_a_position(spark, sf, tmp_path):
    test_contract.test_against_sql(spark, sf, "win_turn_order")
    nan = float("nan")
    rows = [(1, "d", None, 1.0), (2, "d", nan, 0.5), (3, "d", 5.0, nan), (4, "d", 5.0, 6.0), (5, "d", 5.0, None), (6, "d", None, None), (7, "e", nan, nan), (8, None, 1.0, 2.0)]
    spark.createDataFrame(rows, "line_id long, dialog_id string, start_sec double, end_sec double").write.parquet(str(tmp_path / "transcript_line.parquet"))
    got = entry.queries()["win_turn_order"](spark, str(tmp_path)).collect()
    assert {r["line_id"]: r["pos"] for r in got} == {4: 0, 3: 1, 5: 2, 2: 3, 1: 4, 6: 5, 7: 0, 8: 0}


def test_all_demonstrations_are_packed(spark, sf):
    df = spark.createDataFrame([(1, ["x "]), (2, ["x "]), (3, ["a", "b", "c", "d", "e \n"]), (4, [])], "i int, a array<string>")
    got = {r["i"]: r for r in df.select("i", X.pack(F.col("a"), F.lit(1)).alias("one"), X.pack(F.col("a"), F.lit(5)).alias("many")).collect()}
    assert got[1]["one"] == "x " and got[2]["many"] == "Demonstration 1:\nx" and got[4]["many"] == ""
    assert got[3]["many"] == "\n\n".join(f"Demonstration {i}:\n{x}" for i, x in enumerate("abcde", 1))
    test_contract.test_against_sql(spark, sf, "str_demo_pack")
    turns = relational.turns(spark, sf).groupBy("dialog_id").count().collect()
    packed = {r["dialog_id"]: r["packed"] for r in entry.queries()["str_demo_pack"](spark, sf).collect()}
    assert all((f"Demonstration {r['count']}:" in packed[r["dialog_id"]]) == (r["count"] > 1) for r in turns) and max(r["count"] for r in turns) > 3
