"""The queries of the subpackage against DuckDB, and the pipeline against its operators' rules."""

from collections import Counter

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from trackloom.llm import decontamination, neardup, queries

DATA = "/root/testdata/sf0.001"


def same(x, y):
    if pd.isna(x) or pd.isna(y):
        return bool(pd.isna(x) and pd.isna(y))
    return bool(x == y) or isinstance(x, float) and abs(x - y) <= 1e-9 * max(1, abs(y))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = [c for c in ("doc_id", "page_id") if c in want.columns]
    for c in want.columns:
        a, b = got.sort_values(order)[c].tolist(), want.sort_values(order)[c].tolist()
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), c


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA).toPandas()
    whole = docs.toPandas().set_index("doc_id")
    assert list(out.columns) == [*docs.columns, "shard"] and len(out) and out["shard"].between(0, 39).all()
    assert (out.text.values == whole.text.loc[out.doc_id].values).all()
    # what is left is clean: no near-duplicates among distinct rows, no benchmark passage, no more than two copies
    assert max(Counter(out.doc_id).values()) <= 2
    left = spark.createDataFrame(out.drop_duplicates("doc_id")[["doc_id", "text"]])
    assert all(r.kept for r in neardup.near_duplicates(left).collect())
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert not any(r.contaminated for r in decontamination.hits(left, items).collect())
    # a group of copies takes one shard, or, if it is larger than total / 40, the fewest pieces that are not
    size = out.text.fillna("").map(lambda t: len(t.encode()) + 16)
    total = int(size.sum())
    for text, part in out.assign(size=size).groupby("text"):
        pieces = max(1, -(-int(part["size"].sum()) * 40 // total)) if part["size"].sum() > max(1, total // 40) else 1
        assert part["shard"].nunique() <= pieces, text
        assert pieces > 1 or part["shard"].nunique() == 1
    # good documents without any near copy or passage stay, apart from what the mixture doesn't draw
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    first = corpus_pipeline.STAGES[0][1](spark, docs, DATA).toPandas()
    good = set(labels[labels.quality == 1].doc_id)
    assert len(good - set(first.doc_id)) <= 0.03 * len(good)
