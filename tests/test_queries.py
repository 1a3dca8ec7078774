"""Every registered query of the reference's operators runs, and equals its DuckDB SQL where it has one."""

import os

import duckdb
import pandas as pd
import pytest

from trackloom.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(x: pd.DataFrame) -> pd.DataFrame:
    x = x[sorted(x.columns)].copy()
    for c in x.columns:
        x[c] = x[c].map(lambda v: None if v is None else str(v)) if x[c].dtype == object else x[c]
        if isinstance(x[c].dtype, pd.Int32Dtype | pd.Int64Dtype):
            x[c] = x[c].astype("float64")  # as Spark gives integers with nulls
    return x.sort_values(list(x.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(canonical(got), canonical(want), check_dtype=False, rtol=1e-9)


def test_report_rows_rounds_as_its_sql(spark, duck, tmp_path):
    """257 words of 400 syllables, 64.25 %, and 63 of 112, 56.25 %: halves that printf rounds to the even digit."""
    talks = [(1, 114, 143), (2, 2, 7), (4, 7, 0), (None, 14, 49)]
    rows = [(k, turn, "user", " ".join([w] * n)) for k, *counts in talks for turn, (w, n) in enumerate(zip(["ba", "bado"], counts, strict=True)) if n]
    spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duck.cursor()
    con.sql(f"CREATE TEMP VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()["report_rows"]).fetchall()
    got = [tuple(r) for r in catalogue.queries()["report_rows"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(row and row.endswith(" 64.2%") for _, row in got)


def test_names_are_distinct_and_entry_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.entry(spark).take(1)) == 1


def test_matching_blocks_of_all_pairs(spark, duck):
    """Every item against every document in plain Python: those that share any five words in a row."""
    from difflib import SequenceMatcher

    def runs(text):
        w = (text or "").split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    items, docs = duck.sql("SELECT item_id, text FROM benchmark").fetchall(), duck.sql("SELECT doc_id, text FROM documents").fetchall()
    of_docs = [(k, t, runs(t)) for k, t in docs]
    want = set()
    for item, a in items:
        mine = runs(a)
        for doc, b, theirs in of_docs:
            if mine & theirs:
                want |= {(item, doc, *m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()}
    got = [tuple(r) for r in catalogue.queries()["matching_blocks"](spark, DATA).select("item_id", "doc_id", "a", "b", "size").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
