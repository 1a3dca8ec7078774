"""Hand-worked cases of the operators and properties that must hold for any input."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackloom.functions import text as tx
from trackloom.functions import timeline as tl
from trackloom.functions.units import units_column, unsettled_runs
from trackloom.operators import apportion, folds, frames, gating, intervals, layout, sequences


def track(spark, values):
    return spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(values)], "track string, f int, x double")


def column(df, order, name):
    return [r[name] for r in df.orderBy(order).collect()]


def test_frame_rms(spark):
    x = frames.frame_rms(track(spark, [1, 2, 3, 4]), ["track"], "f", "x", 4, 2)
    assert column(x, "f", "rms") == pytest.approx([1.118034, 2.738613], abs=1e-6)


def test_norm01(spark):
    y = column(frames.norm01(track(spark, range(10)), ["track"]), "f", "y")
    assert y[5] == pytest.approx(0.561167, abs=1e-6) and y[9] == 1


def test_follower(spark):
    y = column(folds.follower(track(spark, [0, 1, 1, 0, 0, 0.5]), ["track"]), "f", "y")
    assert y == pytest.approx([0, 0.632121, 0.864665, 0.773736, 0.692369, 0.67214], abs=1e-5)


@pytest.mark.parametrize(("fps", "want"), [(10.0, [(0.1, 0.4, 0.153333, 0.2)]), (25.0, [(0.04, 0.28, 0.145, 0.2)])])
def test_phrase_runs(spark, fps, want):
    x = track(spark, [0, 0.2, 0.15, 0.11, 0.09, 0.12, 0.2, 0])
    got = [(r.start, r.end, r["mean"], r.peak) for r in gating.phrase_runs(x, ["track"], fps=fps).collect()]
    assert len(got) == 1 and got[0] == pytest.approx(want[0], abs=1e-6)


def test_min_gap(spark):
    assert column(intervals.min_gap(track(spark, [0, 0.1, 0.2, 2]), ["track"], "f", "x", 0.25), "f", "repaired") == pytest.approx([0, 0.25, 0.5, 2])


def test_nearest_takes_the_earlier_of_equals(spark):
    p = spark.createDataFrame([("a", 1, 1.25, 0.0, 5.0)], "track string, id int, t double, lo double, hi double")
    m = spark.createDataFrame([("a", 1.0), ("a", 1.5)], "track string, m double")
    r = intervals.nearest(p, m, ["track"], "id", 0.5).first()
    assert (r.mark, r.found) == (1.0, True)


def test_coverage(spark):
    s = spark.createDataFrame([("a", 1, 1.0, 3.0), ("a", 2, 3.0, 3.0)], "track string, id int, s double, e double")
    r = spark.createDataFrame([("a", 0.0, 1.5), ("a", 2.0, 2.5), ("a", 2.9, 9.0)], "track string, rs double, re double")
    assert column(intervals.coverage(s, r, ["track"], "id", 1.0), "id", "coverage") == pytest.approx([0.55, 0])


def test_confidence(spark):
    x = spark.createDataFrame([(0.8, 0.55), (0.0, 1.0)], "p double, c double").select(tl.confidence(F.col("p"), F.col("c")).alias("v"))
    assert sorted(r.v for r in x.collect()) == [0.5, 0.62]


@pytest.mark.parametrize(("weights", "total", "want"), [([2, 1, 1], 5, [2, 2, 1]), ([2, 2], 1, [1, 0]), ([0, 0, 0], 4, [2, 1, 1]), ([3, 1], 0, [0, 0])])
def test_largest_remainder(spark, weights, total, want):
    x = apportion.largest_remainder(track(spark, weights), ["track"], "f", "x", F.lit(total))
    assert column(x, "f", "n") == want


@pytest.mark.parametrize(
    ("s", "e", "n", "phase", "period", "want", "resid"),
    [
        (0.0, 1.0, 3, 0.0, 0.5, [(0, 0.25), (0.25, 0.75), (0.75, 1)], 0.083333),
        (10.0, 10.5, 2, 0.1, 0.4, [(10, 10.3), (10.3, 10.5)], 0.05),
        (0.0, 0.05, 3, 0.0, 0.5, [(0, 0.02), (0.02, 0.04), (0.04, 0.05)], None),
        (0.0, 1.0, 1, 0.0, 0.5, [(0, 1)], 0),
    ],
)
def test_split_on_grid(spark, s, e, n, phase, period, want, resid):
    x = spark.createDataFrame([(s, e, n)], "s double, e double, n int")
    x = x.withColumn("y", tl.split_on_grid(F.col("s"), F.col("e"), F.col("n"), F.lit(phase), F.lit(period)))
    r = x.withColumn("d", tl.residual(F.col("y"), F.col("s"), F.col("e"))).first()
    assert [(v.start, v.end) for v in r.y] == [pytest.approx(w) for w in want]
    if resid is not None:
        assert r.d == pytest.approx(resid, abs=1e-6)


def test_progress(spark):
    x = spark.sql("SELECT 0D s, 1D e, array(named_struct('start', 0D, 'end', .25D), named_struct('start', .25D, 'end', .75D), named_struct('start', .75D, 'end', 1D)) y")
    assert x.select(tl.word_progress(F.col("s"), F.col("e"), F.col("y"), F.lit(0.5)).alias("p")).first().p == pytest.approx(0.5)
    y = "cast(null as array<struct<start:double,end:double>>)"
    w = spark.sql(f"SELECT array(named_struct('w', 'ab', 'start', 0D, 'end', 1D, 'syl', {y}), named_struct('w', 'cde', 'start', 1D, 'end', 2D, 'syl', {y})) ws")
    assert w.select(tl.line_progress(F.col("ws"), F.lit(1.5)).alias("c")).first().c == pytest.approx(4.5)


def test_fill_in_line(spark):
    rows = [("a", 0, "xxxx", 10.0, 11.0), ("a", 1, "xxxx", None, None), ("a", 2, "xxxx", None, None), ("a", 3, "xxxx", 14.0, 15.0), ("b", 0, "y", None, None)]
    x = spark.createDataFrame(rows, "line string, wi int, w string, start double, end double")
    got = {(r.line, r.wi): (r.start, r.end) for r in layout.fill_in_line(x, ["line"], "wi", F.length("w")).collect()}
    assert got["a", 1] == (12.0, 13.0) and got["a", 2] == (13.0, 14.0) and got["b", 0] == (None, None)


def test_clusters(spark):
    x = spark.createDataFrame([("a", 0.0, 0.5, 1.0), ("a", 1.0, 1.5, 1.0), ("a", 3.0, 3.4, 1.0)], "k string, start double, end double, prob double")
    assert [(r.start, r.end, r.n) for r in layout.clusters(x, ["k"]).orderBy("start").collect()] == [(0, 1.5, 2), (3, 3.4, 1)]


WORDS = dict(zip("table maple smile sunrise coffee tree the rhythm quay make before".split(), [2, 2, 2, 2, 2, 1, 1, 1, 1, 1, 2], strict=True))


def test_latin_syllables(spark):
    x = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", tx.latin_syllables(F.col("w")).alias("n"))
    assert {r.w: r.n for r in x.collect()} == WORDS


def test_scripts(spark):
    x = spark.createDataFrame([("食べ物を",), ("ラーメ",), ("カッパ",), ("Ｃａｔ",), ("",)], "w string")
    got = x.select("w", tx.script_chunks(F.col("w")).alias("c"), tx.mora_weight(F.col("w")).alias("m"), tx.fold(F.col("w")).alias("f")).collect()
    assert [(r.c, r.m) for r in got][:4] == [(2, 6.0), (3, 3.0), (1, 2.5), (1, 1.0)]
    assert got[3].f == "cat" and got[4].c == 0


def units(spark, token, ja=frozenset(), zh=frozenset()):
    t = F.col("t")
    r = spark.createDataFrame([(token,)], "t string").select(units_column(t, ja, zh).alias("u"), unsettled_runs(t, ja, zh).alias("open")).first()
    return r.u, r.open


@pytest.mark.parametrize(
    ("token", "want"),
    [
        ("ファンタジア", [("ファ", 1), ("ン", 1), ("タ", 1), ("ジ", 1), ("ア", 1)]),
        ("さぁ", [("さぁ", 2)]),
        ("時々に", [("時々", 2), ("に", 1)]),
        ("(abc)", [("(abc)", 1)]),
        ("...", [("...", 0)]),
        ("", []),
        # the edges of the classes: the middle dot, voicing and iteration marks, accents and curly apostrophes are marks
        ("ア・イ", [("ア・", 1), ("イ", 1)]),
        ("ー゛ヽa", [("ー゛ヽ", 1), ("a", 1)]),
        ("don't", [("don't", 1)]),
        ("don’t", [("don’", 1), ("t", 1)]),
        ("café", [("café", 1)]),
        ("ヺゖ", [("ヺ", 1), ("ゖ", 1)]),
        ("!ャぁ", [("!ャぁ", 2)]),
        ("カ!ャ", [("カ!", 1), ("ャ", 1)]),
        ("ティトゥァー", [("ティ", 1), ("トゥァ", 2), ("ー", 1)]),
        ("きょう12", [("きょ", 1), ("う12", 1)]),
        ("line\n", [("line\n", 1)]),
    ],
)
def test_token_units(spark, token, want):
    found, unsettled = units(spark, token)
    assert [(u.u, u.morae) for u in found] == want and not unsettled
    assert "".join(u.u for u in found) == token


def test_unsettled_ideographs(spark):
    assert units(spark, "私")[1] == ["私"] and units(spark, "私")[0][0].lang == "zh"
    found, unsettled = units(spark, "私", ja=frozenset(["私"]))
    assert (found[0].morae, found[0].lo, found[0].hi, found[0].tentative) == (2, 1, 3, True) and not unsettled
    found, unsettled = units(spark, "我想!我の", zh=frozenset(["我想"]))
    assert [(u.u, u.morae, u.lang) for u in found] == [("我", 1, "zh"), ("想!", 1, "zh"), ("我", 2, "ja"), ("の", 1, "ja")] and not unsettled
    assert units(spark, "\uf900々私", zh=frozenset(["我想"]))[1] == ["私"]


def test_align():
    assert sequences.align(3, np.array([1, 0.1, 0.9, 0.8]))[:2] == ([0, 1, 3], {"match": 3, "hold": 0, "skip": 1})
    slots, counts, cost = sequences.align(3, np.array([1, 0.8]))
    assert slots == [0, None, 1] and counts["hold"] == 1 and cost == pytest.approx(0.95)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.lists(st.integers(0, 100), min_size=1, max_size=7))
def test_align_costs_what_the_full_table_says(slots, strengths):
    s = np.array(strengths) / 100
    dp = np.full((slots + 1, len(s) + 1), 1e9)
    dp[0, 0] = 0
    for i in range(1, slots + 1):
        for j in range(1, len(s) + 1):
            dp[i, j] = min(dp[i - 1, j - 1] + 0.25 * (1 - s[j - 1]), dp[i - 1, j] + 0.9, dp[i, j - 1] + 0.6 * (1 - s[j - 1]))
    best = min(dp[slots, j] + 0.6 * (1 - s[j:]).sum() for j in range(len(s) + 1))
    assert sequences.align(slots, s)[2] == pytest.approx(best)


def test_matching_blocks(spark):
    spark.udtf.register("blocks", sequences.MatchingBlocks)
    got = [tuple(r) for r in spark.sql("SELECT * FROM blocks('abxcd', 'abcd')").collect()]
    assert got == [(0, 0, 2), (3, 2, 2), (5, 4, 0)]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=60), st.text("abc", max_size=60))
def test_common_blocks_are_those_of_single_characters(a, b):
    import difflib

    assert sequences.common_blocks(a, b) == [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=30), st.integers(1, 6))
def test_peaks_stand_apart(values, distance):
    x = np.array(values, float)
    found = sequences.peaks(x, 1.0, distance)
    assert all(b - a >= distance for a, b in zip(found, found[1:], strict=False))
    assert all(0 < k < len(x) - 1 and x[k] >= 1 for k in found)


def test_onset_budget():
    x = np.array([0, 1, 0, 2, 0, 0, 3, 0, 0, 4, 0], float)
    assert len(sequences.onset_peaks(x, 2, 0.0, 1)) == 2


def test_butterworth():
    def response(sos, f, rate):
        z = np.exp(-2j * np.pi * f / rate)
        return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sos]))

    band = sequences.butterworth("band", 4, (200.0, 4000.0), 22050.0)
    assert response(band, 200, 22050) == pytest.approx(0.7071, abs=1e-4) and response(band, 900, 22050) == pytest.approx(1, abs=1e-3)
    assert response(sequences.butterworth("low", 4, (150.0,), 22050.0), 150, 22050) == pytest.approx(0.7071, abs=1e-4)
    assert response(sequences.butterworth("high", 4, (4000.0,), 22050.0), 50, 22050) < 1e-4


def test_mel(spark):
    x = spark.createDataFrame([(100.0,), (1000.0,), (8000.0,)], "f double").select("f", frames.hz_to_mel(F.col("f")).alias("m"), frames.mel_to_hz(frames.hz_to_mel(F.col("f"))).alias("g"))
    got = {r.f: (r.m, r.g) for r in x.collect()}
    assert got[1000.0][0] == pytest.approx(999.9855, abs=1e-4) and got[8000.0][0] == pytest.approx(2840.0230, abs=1e-4) and got[100.0][1] == pytest.approx(100)


def test_hysteresis_equals_the_state_machine(spark):
    x = np.random.default_rng(3).random(500)
    active, want = False, []
    for v in x:
        active = v > 0.7 or active and v > 0.3
        want.append(active)
    assert column(gating.hysteresis(track(spark, x), ["track"], "x", 0.7, 0.3), "f", "active") == want


def test_split_word(spark):
    x = spark.createDataFrame([(0.0, 1.0, [1.0, 1.0, 2.0], [0.28, 0.47]), (0.0, 1.0, [1.0, 1.0], [0.9]), (0.0, 0.03, [1.0, 1.0], []), (2.0, 3.0, [2.0], [])], "s double, e double, w array<double>, m array<double>")
    got = [[(v.start, v.end) for v in r.y] for r in x.select(tl.split_word(F.col("s"), F.col("e"), F.col("w"), F.col("m"), 0.1).alias("y")).collect()]
    assert sorted(got) == sorted([[(0.0, 0.28), (0.28, 0.47), (0.47, 1.0)], [(0.0, 0.5), (0.5, 1.0)], [(0.0, 0.01), (0.01, 0.03)], [(2.0, 3.0)]])


def test_next_of(spark):
    p = spark.createDataFrame([("a", k, t) for k, t in enumerate([0.0, 1.0, 1.5, 3.0, 9.0])], "k string, id int, t double")
    m = spark.createDataFrame([("a", 1.0, "x"), ("a", 3.0, "y")], "k string, m double, v string")
    got = {r.id: r.out.v if r.out else None for r in intervals.next_of(p, m, ["k"], "t", "m", "out").collect()}
    assert got == {0: "x", 1: "x", 2: "y", 3: "y", 4: None}
    got = {r.id: r.out.v if r.out else None for r in intervals.next_of(p, m, ["k"], "t", "m", "out", strict=True).collect()}
    assert got == {0: "x", 1: "y", 2: "y", 3: None, 4: None}


def test_link_words_equals_the_search_word_by_word(spark):
    """Against the same rules said over Python lists."""
    import difflib
    import random

    rng = random.Random(11)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(24)).strip() or "a" for _ in range(6)]
    pieces, t = [], 0.0
    for line in lines:
        for w in line.split():
            t += rng.choice([0.1, 0.3, 2.0])
            d = rng.choice([0.0, 0.2, 0.5, 3.0])
            pieces.append((rng.choice([w, w, w[:2], "zz"]), round(t, 3), round(t + d, 3), rng.choice([0.01, 0.2, 0.6, 0.9])))
            t += d
    good = [p for p in pieces if p[2] > p[1] and not (p[2] - p[1] > 2.5 and p[3] < 0.3)]
    words = [(li, wi, w) for li, line in enumerate(lines) for wi, w in enumerate(line.split())]
    a, b = [k for k, (_, _, w) in enumerate(words) for _ in w], [k for k, p in enumerate(good) for _ in p[0]]
    hits = {}
    for m in difflib.SequenceMatcher(None, "".join(w for *_, w in words), "".join(p[0] for p in good), autojunk=False).get_matching_blocks():
        for k in range(m.size):
            hits.setdefault(a[m.a + k], []).append(good[b[m.b + k]][1:])
    want = {}
    for k, (li, wi, w) in enumerate(words):
        groups = []
        for s, e, p in sorted(hits.get(k, [])):
            if groups and s - groups[-1][1] <= 1.2:
                g = groups[-1]
                g[1], g[2], g[3] = max(g[1], e), g[2] + 1, g[3] + p
            else:
                groups.append([s, e, 1, p])
        fine = [g for g in groups if 0.06 * g[2] <= g[1] - g[0] <= 1.5 + 0.8 * g[2] and g[3] / g[2] >= 0.05 and not (g[2] < 0.34 * len(w) and g[3] / g[2] < 0.25)]
        best = max(fine, key=lambda g: g[2], default=None)
        want[li, wi] = None if best is None else (round(best[0], 3), round(best[1], 3), round(best[3] / best[2], 3))
    got = layout.link_words(
        spark.createDataFrame([("s", li, x) for li, x in enumerate(lines)], "k string, li int, text string"),
        spark.createDataFrame([("s", k, *p) for k, p in enumerate(pieces)], "k string, pi int, text string, start double, end double, prob double"),
        ["k"],
    )
    assert {(r.li, r.wi): None if r.start is None else pytest.approx((r.start, r.end, r.prob)) for r in got.collect()} == want


def test_link_words_broadcasts_nothing(spark):
    """However few bytes Spark expects: it doesn't count what explosions and the search make of a row."""
    lines = spark.createDataFrame([("s", 0, "ab cd")], "k string, li int, text string")
    pieces = spark.createDataFrame([("s", 0, "ab", 0.0, 0.4, 0.9), ("s", 1, "cd", 0.5, 0.9, 0.9)], "k string, pi int, text string, start double, end double, prob double")
    got = layout.link_words(lines, pieces, ["k"])
    assert {(r.w, r.start, r.end) for r in got.collect()} == {("ab", 0.0, 0.4), ("cd", 0.5, 0.9)}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_fixed_rounds_as_printf(spark):
    values = [64.25, 64.75, 0.15, 0.35, 0.05, 99.95, 100.0, 1234567.25, -2.25, 0.0]
    got = spark.createDataFrame([(v,) for v in [*values, None]], "v double").select("v", tx.fixed(F.col("v"), 1, 5).alias("s")).collect()
    assert [r.s for r in got] == [*(f"{v:5.1f}" for v in values), None]


def test_line_confidence(spark):
    x = spark.createDataFrame([(1.0, 8.0, 4.0), (0.0, 9.0, 2.0), (0.5, 1.0, 4.0)], "c double, n double, m double")
    assert sorted(r.v for r in x.select(tl.line_confidence(F.col("c"), F.col("n"), F.col("m")).alias("v")).collect()) == [0.4, 0.4, 1.0]
