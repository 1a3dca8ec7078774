"""Streaming gates against their batch forms, and the file sources."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import folds, gating
from trackloom.sources import documents
from trackloom.streaming import stateful


def frames_in_batches(spark, folder, parts=4, n=40):
    x = np.random.default_rng(1).random(n * parts)
    for k in range(parts):
        rows = [(t, int(f), float(x[f])) for t in ("a", "b") for f in range(k * n, (k + 1) * n)]
        spark.createDataFrame(rows, "track string, f int, x double").coalesce(1).write.parquet(f"{folder}/p{k}")
    batch = spark.read.parquet(*[f"{folder}/p{k}" for k in range(parts)])
    stream = spark.readStream.schema("track string, f int, x double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    return batch, stream


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_stateful_gates(spark, tmp_path):
    batch, stream = frames_in_batches(spark, tmp_path)
    got = {(r.track, r.f): r.active for r in run(stateful.hysteresis_gate(stream, "track", "x", 0.7, 0.3), "gate").collect()}
    want = {(r.track, r.f): r.active for r in gating.hysteresis(batch, ["track"], "x", 0.7, 0.3).collect()}
    assert got == want
    got = {(r.track, r.f): r.y for r in run(stateful.follower(stream, "track", "x"), "follow").collect()}
    want = {(r.track, r.f): r.y for r in folds.follower(batch, ["track"]).collect()}
    assert got == pytest.approx(want)


def test_windows_and_sessions(spark, tmp_path):
    rows = [("a", s, 1.0) for s in (0, 10, 70, 500, 2000)]
    x = spark.createDataFrame(rows, "k string, s int, v double").select("k", F.timestamp_seconds("s").alias("ts"), "v")
    x.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(x.schema).parquet(f"{tmp_path}/e")
    sums = run(stateful.windowed_sums(stream, ["k"], "ts", "v", "1 minute", "10 seconds"), "sums")
    assert sorted(r.n for r in sums.collect()) == [1, 1, 2]  # the last window is still open
    closed = run(stateful.sessions(stream, ["k"], "ts", "100 seconds", "10 seconds"), "closed")
    assert sorted(r.n for r in closed.collect()) == [1, 3]


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one two \n\n \nthree\n", encoding="utf-8")
    got = [(r.i, r.text) for r in documents.read_lines(spark, str(tmp_path / "a.txt")).orderBy("i").collect()]
    assert got == [(0, "one two"), (1, "three")]


@pytest.mark.parametrize("syl", [[[0, 0.5], [0.5, 1]], [{"start": 0, "end": 0.5}, {"start": 0.5, "end": 1}]])
def test_documents_round_trip(spark, tmp_path, syl):
    doc = {"lines": [{"i": 0, "text": "ab", "start": 0.0, "end": 1.0, "words": [{"w": "ab", "start": 0.0, "end": 1.0, "conf": 0.5, "syl": syl}]}], "source": "x"}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    d = documents.read_documents(spark, str(tmp_path / "d.json"))
    assert [(s.start, s.end) for s in d.first().lines[0].words[0].syl] == [(0, 0.5), (0.5, 1)]
    documents.write_documents(d.drop("file"), str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out")).first().value
    assert "notes" not in text and json.loads(text)["source"] == "x"


def test_samples(spark, tmp_path):
    np.array([0, 1, 0.5, 0.5], "<f4").tofile(tmp_path / "a.f32")
    assert [r.x for r in documents.read_samples(spark, str(tmp_path / "a.f32")).orderBy("i").collect()] == [0.5, 0.5]


def test_grid_override():
    g = documents.GridSpec(120.0, 0.5, 0.1)
    assert g.override(bpm=60).period == 1 and g.override(bpm=60, period=0.25).bpm == 240 and g.override(phase=0.3).period == 0.5


def test_features_are_read_by_name(spark, tmp_path):
    x = spark.createDataFrame([(t, k, k / 10, 1.0) for t in ("low", "high", "vocal") for k in range(4)], "track string, f int, x double, y double")
    documents.write_features(x, str(tmp_path / "f"))
    got = documents.read_features(spark, str(tmp_path / "f"), ["low", "vocal"], ["f", "x"])
    assert got.columns == ["track", "f", "x"] and sorted({r.track for r in got.collect()}) == ["low", "vocal"] and got.count() == 8
    assert "PartitionFilters: [isnotnull(track" in (plan := got._jdf.queryExecution().executedPlan().toString()) or "PartitionFilters: [track" in plan


def test_readings_and_maps(spark, tmp_path):
    (tmp_path / "r.txt").write_text("ka  ki\n\n ku \n")
    assert [(r.i, r.tokens) for r in documents.reading_lines(spark, str(tmp_path / "r.txt")).orderBy("i").collect()] == [(0, ["ka", "ki"]), (1, ["ku"])]
    wanted = spark.createDataFrame([(0, "a b", ["a", "b"], ["ka", "ki"]), (1, "c", ["c"], ["ku"])], "i int, text string, words array<string>, tokens array<string>")
    lines = [{"i": 0, "text": "a b", "words": [{"w": "a", "syl": ["ka", "ki"]}, {"w": "b", "syl": []}]}, {"i": 1, "text": "c", "words": [{"w": "c", "syl": ["ku"]}]}]
    (tmp_path / "m.json").write_text(json.dumps({"lines": lines}))
    assert [r.tokens for r in documents.load_map(spark, str(tmp_path / "m.json"), wanted).orderBy("i").collect()] == [["ka", "ki"], ["ku"]]
    assert documents.load_map(spark, None, wanted).count() == 2
    lines[1]["words"][0]["syl"] = ["ke"]
    (tmp_path / "n.json").write_text(json.dumps({"lines": lines}))
    with pytest.raises(ValueError, match="line 1: tokens"):
        documents.load_map(spark, str(tmp_path / "n.json"), wanted)
