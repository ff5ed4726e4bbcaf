"""The registered text queries on the smallest tables, against SQL where it exists."""

import glob
import os

import duckdb
import pytest

from parlance.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = Q.queries()[name](spark, sf)
    want = con.sql(Q.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    assert sorted(str([r[c] for c in cols]) for r in got.collect()) == sorted(str([r[i] for i in order]) for r in want.fetchall())


COLUMNS = {"p1_found": ["ann_id", "defect"], "p2_found": ["row_id"], "p3_found": ["dialog_id", "first_line_id", "speaker"], "p5_found": ["row_id_a", "row_id_b"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    df = Q.queries()[name](spark, sf)
    assert df.columns == COLUMNS[name] and df.count() > 0
