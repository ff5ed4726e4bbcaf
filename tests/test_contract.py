"""The driver's contract: names, flagship, and queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SOME = ["win_history", "win_flow_doc", "agg_f1_weighted", "num_digitize", "topk_prefilter", "sink_csv", "p4_found", "agg_rouge", "join_demo_range"]


def test_names_agree():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


def test_flagship(spark):
    rows = entry.entry(spark).limit(3).collect()
    assert rows and all("Conversation:" in r["prompt"] for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = entry.queries()[name](spark, sf)
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    a = sorted(str([norm(r[c]) for c in cols]) for r in got.collect())
    order = [want.columns.index(c) for c in cols]
    b = sorted(str([norm(r[i]) for i in order]) for r in want.fetchall())
    assert a == b
