"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from trackloom.llm import decontamination, html_text, importance, lm_scoring, media, mixing, neardup, sharding, toxicity, warc

DOCS = "doc_id long, text string, source string, k string, key string, u int, shard int, _k string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the old red barn", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \t\n", "b"),
    (5, LONG, "b"),
    (6, LONG + " tail", "c"),
    (7, "Word", "c"),
    (7, "Word", "c"),
    (None, "a text without an id", None),
    (8, "Straße café ÉTÉ naïve \U0001f600 text", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, "z") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (None, 1, 1), (5, None, None), (7, 1, 0), (7, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "brown fox jumps over the lazy dog and runs away from"), (2, None), (3, "..."), (None, "Word"), (4, "word")]
    return spark.createDataFrame(rows, "item_id long, text string")


def pages_of(docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "k", "key", "shard")


OPERATORS = {
    "importance": lambda d, lab, it: importance.resample(d, lab),
    "html": lambda d, lab, it: html_text.extract(pages_of(d)),
    "toxicity": lambda d, lab, it: toxicity.score(d, lab),
    "sharding": lambda d, lab, it: sharding.shard_documents(d, n_shards=4),
    "neardup": lambda d, lab, it: neardup.near_duplicates(d),
    "mixing": lambda d, lab, it: mixing.copies(d),
    "media": lambda d, lab, it: media.load(media.store(d)),
    "warc": lambda d, lab, it: warc.round_trip(pages_of(d)),
    "decontamination": lambda d, lab, it: decontamination.hits(d, it),
    "lm": lambda d, lab, it: lm_scoring.score(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(docs, labels, items, name):
    rows = OPERATORS[name](docs, labels, items).collect()
    ids = sorted((r[0] is None, r[0] or 0) for r in rows)
    assert ids == sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, labels, items, name):
    none = docs.limit(0)
    assert OPERATORS[name](none, labels.limit(0), items.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["importance", "toxicity", "decontamination"])
def test_empty_side_tables(docs, labels, items, name):
    assert OPERATORS[name](docs, labels.limit(0), items.limit(0)).count() == len(ROWS)


CLASHES = ["_id", "_k", "k", "key", "n", "_n", "size", "rows", "copy", "other", "gone", "_contaminated", "packed", "p_key", "p_size", "piece", "bytes", "root", "place", "a.b", "shard"]

STAGES = {
    "keep_good": lambda d, lab, it: importance.keep_good(d, lab),
    "keep_one": lambda d, lab, it: neardup.keep_one(d),
    "drop_contaminated": lambda d, lab, it: decontamination.drop_contaminated(d, it),
    "emit": lambda d, lab, it: mixing.emit(d),
    "shard_rows": lambda d, lab, it: sharding.shard_rows(d, n_shards=3),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_clashing_columns(spark, docs, labels, items, name):
    """Values, not only names: each clashing column holds its own name."""
    wide = docs.select("doc_id", "text", "source", *[F.lit(f"mine {c}").alias(c) for c in CLASHES])
    plain = docs.select("doc_id", "text", "source")
    out = STAGES[name](wide, labels, items)
    assert out.columns == wide.columns
    rows = out.collect()
    for c in CLASHES:
        if (name, c) != ("shard_rows", "shard"):
            assert {r[c] for r in rows} == {f"mine {c}"}, c
    small = STAGES[name](plain, labels, items).collect()
    key = lambda r: (str(r.doc_id), str(r.text), str(r.source))
    assert sorted(map(key, rows)) == sorted(map(key, small))
    assert STAGES[name](wide.limit(0), labels, items).count() == 0
    if name == "shard_rows":
        assert {r.shard for r in rows} <= {0, 1, 2} and all(isinstance(r.shard, int) for r in rows)


@pytest.mark.parametrize("what", ["rows", "no documents", "no side tables"])
def test_pipeline_over_edge_tables(spark, docs, labels, items, tmp_path, what):
    import corpus_pipeline

    wide = docs.select("doc_id", "text", "source", *[F.lit(f"mine {c}").alias(c) for c in CLASHES])
    tables = {"documents": wide, "labels": labels, "benchmark": items}
    for name, frame in tables.items():
        empty = what == "no documents" and name == "documents" or what == "no side tables" and name != "documents"
        (frame.limit(0) if empty else frame).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*[c for c in wide.columns if c != "shard"], "shard"]
    rows = out.collect()
    assert (what == "no documents") == (not rows) or len(rows) < len(ROWS) * 2
    seen = {(r.doc_id, r.text) for r in rows}
    assert seen <= {(a, b) for a, b, _ in ROWS} and all(0 <= r.shard < 40 for r in rows)
    assert not any(r.text == ROWS[0][1] for r in rows) or what == "no side tables"
    assert all(r[c] == f"mine {c}" for r in rows for c in CLASHES if c != "shard")


def test_mixed_rows_are_those_drawn(docs):
    """copies() and emit() agree also where rows share an id, a source and a size."""
    want = {}
    for r in mixing.copies(docs).collect():
        want[r.doc_id, r["size"]] = want.get((r.doc_id, r["size"]), 0) + r.n_copies
    got = {}
    for r in mixing.emit(docs).select("doc_id", mixing.word_count(F.col("text")).alias("size")).collect():
        got[r.doc_id, r["size"]] = got.get((r.doc_id, r["size"]), 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_one_id_with_different_texts(spark, items):
    docs = spark.createDataFrame([(1, "a b c d e f", "s"), (1, "brown fox jumps over the lazy dog and runs away from", "s"), (1, None, "s")], "doc_id long, text string, source string")
    assert sorted(r.n_hit for r in decontamination.hits(docs, items).collect()) == [0, 0, 11]
    assert sorted(r.n_words for r in decontamination.hits(docs, items).collect()) == [0, 6, 11]
    assert lm_scoring.score(docs).count() == sharding.shard_documents(docs, n_shards=2).count() == 3
    assert {r.component_id for r in neardup.near_duplicates(docs).collect()} == {1}


def test_text_ids_of_any_characters(spark):
    names = ["-", "", "a b", "line\r\nbreak", "é%20", None]
    pages = spark.createDataFrame([(k, "u", "<p>same</p>") for k in names] + [("z", "u", "<p>own</p>")], "page_id string, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert set(got) == {*names, "z"} and got[""].record_type == got["z"].record_type == "response"
    assert all(got[k].record_type == "revisit" and got[k].refers_to == "" for k in names if k != "")


def test_gumbel_ties_are_all_kept(spark, labels):
    docs = spark.createDataFrame([(7, "same words here")] * 6, "doc_id long, text string")
    assert {r.kept for r in importance.resample(docs, labels, share=0.5).collect()} == {True}


def test_keep_one_leaves_one_of_repeated_rows(docs):
    kept = sorted(str(r.doc_id) for r in neardup.keep_one(docs).collect())
    assert kept.count("7") == 1 and "6" not in kept and {"2", "3", "4", "None"} <= set(kept)


def test_decontamination_counts(docs, items):
    got = {r.doc_id: r for r in decontamination.hits(docs, items).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].contaminated) == (11, 1, True)
    assert (got[7].n_words, got[7].n_hit, got[7].n_items) == (1, 1, 1)
    assert (got[2].n_words, got[2].contaminated) == (0, False)
    assert got[8].n_words == 6


def test_warc_of_equal_pages(docs):
    got = {r.page_id: r for r in warc.round_trip(pages_of(docs)).collect()}
    assert (got[2].record_type, got[3].record_type, got[3].refers_to) == ("response", "revisit", 2)
    assert got[5].payload_bytes == len(LONG) and got[7].record_type == "response"
    assert got[2].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_media_of_empty_text(docs):
    got = {r.doc_id: r for r in media.load(media.store(docs)).collect()}
    assert (got[2].n_bytes, got[2].payload_bytes) == (0, 64) and got[2].media_sha256 == got[3].media_sha256
