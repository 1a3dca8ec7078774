"""Queries from pieces to timed words, lines and documents (AL, SP, CK), and the sequential operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import text as tx, timeline as tl
from trackloom.functions.units import UNIT, parse_lines
from trackloom.operators import checks, layout as lo, sequences as sq
from trackloom.plans.text_queries import SYL, _words
from trackloom.plans.tracks import EV, FR, NR, RUNS, hourly, normal, runs
from trackloom.sources.tables import events, table

r3 = tl.r3
HOUR = 3600.0


def _pieces(spark, sf):
    """Events as pieces of their user's day: (user_id, line, event_id, text, start, end, prob)."""
    e = events(spark, sf)
    return e.select("user_id", F.floor(F.col("t") / 86400).cast("int").alias("line"), "event_id", F.col("event_type").alias("text"), F.col("t").alias("start"), (F.col("t") + F.col("value") / 100).alias("end"), ((F.col("event_id") % 100) / 100).alias("prob"))


def sound_pieces(spark, sf):
    return lo.sound_pieces(_pieces(spark, sf)).select("event_id")


def _clusters(spark, sf):
    return lo.clusters(lo.sound_pieces(_pieces(spark, sf)), ["user_id", "line"], 7200.0)


def time_clusters(spark, sf):
    return _clusters(spark, sf).select("user_id", "line", "cl", r3(F.col("start")).alias("start"), r3(F.col("end")).alias("end"), "n", F.round("p_sum", 2).alias("p_sum"))


def best_cluster(spark, sf):
    return lo.best_cluster(lo.clusters(lo.sound_pieces(_pieces(spark, sf)), ["user_id", "line"], 1.2), ["user_id", "line"], F.lit(2))


def _holes(spark, sf):
    """Pieces in order within their line; every line keeps its improbable words without times."""
    p = _pieces(spark, sf).withColumn("wi", (F.row_number().over(Window.partitionBy("user_id", "line").orderBy("start", "event_id")) - 1).cast("int"))
    known = F.col("prob") >= 0.4
    return p.withColumn("start", F.when(known, F.col("start"))).withColumn("end", F.when(known, F.col("end")))


def fill_missing_inline(spark, sf):
    x = lo.fill_in_line(_holes(spark, sf), ["user_id", "line"], "wi", F.length("text"))
    return x.filter("filled").select("event_id", r3(F.col("start")).alias("start"), r3(F.col("end")).alias("end"))


def spray_missing(spark, sf):
    w = _words(spark, sf).select(F.col("conv_id").alias("track"), "turn", "wi", F.length("w").cast("double").alias("len"))
    w = w.withColumn("k", F.row_number().over(Window.partitionBy("track").orderBy("turn", "wi"))).withColumn("lo", F.lit(100.0)).withColumn("hi", F.lit(600.0))
    r = runs(spark, sf).filter("track = 'click'").select("start", "end")
    r = table(spark, sf, "conversations").select(F.col("conv_id").alias("track")).distinct().crossJoin(F.broadcast(r)).select("track", F.col("start").alias("rs"), F.col("end").alias("re"))  # the hours of one month at most
    return lo.spray(w, r, ["track"], "k", "len").select("track", "k", "start", "end")


def bad_line_flags(spark, sf):
    x = lo.fill_in_line(_holes(spark, sf), ["user_id", "line"], "wi", F.length("text"))
    return lo.bad_lines(x.filter("start IS NOT NULL"), ["user_id", "line"])


def refine_windows(spark, sf):
    x = lo.bad_lines(_pieces(spark, sf), ["user_id", "line"]).join(_pieces(spark, sf).groupBy("user_id", "line").agg(F.min("start").alias("s"), F.max("end").alias("e")), ["user_id", "line"])
    w = Window.partitionBy("user_id").orderBy("line")
    x = x.withColumn("lo", F.coalesce(F.lag("e").over(w), F.lit(0.0)) - 2).withColumn("hi", F.coalesce(F.lead("s").over(w), F.col("e") + 25) + 2)
    return x.filter("bad").select("user_id", "line", r3(F.greatest("lo", F.lit(0.0))).alias("lo"), r3(F.col("hi")).alias("hi"))


def merge_refined(spark, sf):
    """Lines heard again: every piece a quarter of a second later, improbable ones not linked, some far too long."""
    old = _pieces(spark, sf).select("user_id", "line", F.col("event_id").alias("wi"), r3(F.col("start")).alias("start"), r3(F.col("end")).alias("end"), "prob")
    new = old.filter("prob >= 0.1").select("user_id", "line", "wi", r3(F.col("start") + 0.25).alias("start"), r3(F.col("end") + F.when(F.col("wi") % 9 == 0, 12.5).otherwise(0.25)).alias("end"), "prob")
    return lo.accept_refined(old, new, ["user_id", "line"]).select("user_id", "line", "wi", "start", "end", "accepted")


def lag_search(spark, sf):
    x = normal(spark, sf).select("track", "f", "y")
    a, b = x.filter("track = 'click'").withColumn("track", F.lit("pair")), x.filter("track = 'view'").withColumn("track", F.lit("pair"))
    g = lo.lag_search(a, b, ["track"], "y", range(-24, 25), 100)
    return g.select("lag", "n", F.round("corr", 6).alias("corr"), F.round("mad", 6).alias("mad"))


def best_lag(spark, sf):
    g = lag_search(spark, sf)
    coarse = g.filter("lag % 4 = 0").agg(F.min_by("lag", F.struct("mad", "lag")).alias("c"))
    fine = g.crossJoin(F.broadcast(coarse)).filter(F.abs(F.col("lag") - F.col("c")) <= 4)  # one row on the right
    return fine.agg(F.min_by("lag", F.struct("mad", "lag")).alias("lag"), F.min("mad").alias("mad"), F.max_by("lag", F.struct("corr", -F.col("lag"))).alias("corr_lag"))


def proportional_allocate(spark, sf):
    tracks = runs(spark, sf).select("track").distinct()
    lines = _words(spark, sf).groupBy("conv_id", "turn").agg(F.sum("m").cast("double").alias("morae"))
    lines = lines.withColumn("track", F.element_at(F.array(F.lit("click"), F.lit("view"), F.lit("signup")), (F.col("conv_id") % 3 + 1).cast("int"))).join(tracks, "track")
    lines = lines.withColumn("k", F.row_number().over(Window.partitionBy("track").orderBy("conv_id", "turn")))
    r = runs(spark, sf).select("track", F.col("start").alias("rs"), F.col("end").alias("re"), "mean")
    return lo.allocate(lines, r, ["track"], "k", "morae").select("track", "k", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


def lattice_snap(spark, sf):
    return events(spark, sf).select("event_id", r3(tl.snap(F.col("t"), F.lit(0.41), F.lit(0.2329169))).alias("snapped"))


def _timed(spark, sf):
    """Events as words with syllable spans on a grid."""
    e = events(spark, sf).select("event_id", "user_id", F.col("event_type").alias("w"), r3(F.col("t")).alias("start"), r3(F.col("t") + 0.3 + F.col("value") / 50).alias("end"), ((F.col("event_id") % 100) / 100).alias("prob"))
    n = tx.latin_syllables(F.col("w"))
    return e.withColumn("syl", tl.split_on_grid(F.col("start"), F.col("end"), n, F.lit(0.41), F.lit(0.4658)))


def split_on_grid(spark, sf):
    x = _timed(spark, sf).withColumn("resid", F.round(tl.residual(F.col("syl"), F.col("start"), F.col("end")), 4))
    return x.select("event_id", "resid", F.posexplode("syl").alias("k", "s")).select("event_id", "k", "resid", "s.start", "s.end")


def word_confidence(spark, sf):
    cover = F.round((F.col("event_id") % 7) / 6, 4)
    return _timed(spark, sf).select("event_id", tl.confidence(F.col("prob"), cover).alias("conf"))


def word_progress(spark, sf):
    x = _timed(spark, sf).withColumn("at", F.explode(F.array(*[F.lit(v) for v in (-0.1, 0.25, 0.5, 0.75, 1.1)])))
    t = F.col("start") + (F.col("end") - F.col("start")) * F.col("at")
    return x.select("event_id", "at", F.round(tl.word_progress(F.col("start"), F.col("end"), F.col("syl"), t), 4).alias("p"))


def line_progress(spark, sf):
    e = _timed(spark, sf).withColumn("line", F.floor(F.col("start") / 86400).cast("int"))
    g = e.groupBy("user_id", "line").agg(F.array_sort(F.collect_list(F.struct("start", "end", "event_id", "w"))).alias("ws"), F.min("start").alias("s"), F.max("end").alias("e"))
    ws = F.transform("ws", lambda v: F.struct(v["w"].alias("w"), v["start"].alias("start"), v["end"].alias("end"), F.lit(None).cast(tl.SPANS).alias("syl")))
    g = g.withColumn("t", F.explode(F.array(F.col("s"), (F.col("s") + F.col("e")) / 2, F.col("e")))).distinct()
    # not in one select with a new t: names in lambdas may mean aliases that come before
    g = g.withColumn("chars", F.round(tl.line_progress(ws, F.col("t")), 3))
    return g.select("user_id", "line", r3(F.col("t")).alias("t"), "chars")


def frame_state(spark, sf):
    """A frame clock over the runs of each track: the run at each frame, the one before it and the gap since."""
    r = runs(spark, sf).withColumn("gap", F.col("start") - F.lag("end").over(Window.partitionBy("track").orderBy("run_id")))
    clock = r.select("track").distinct().select("track", F.explode(F.sequence(F.lit(0), F.lit(179))).alias("i")).withColumn("t", F.col("i") * 4.0)
    from trackloom.operators.intervals import stab_first

    hit = stab_first(clock, r.withColumnRenamed("start", "s").withColumnRenamed("end", "e"), ["track"], ["i"], ["run_id"], 24.0)
    return hit.select("track", "i", "run_id", F.coalesce(F.col("gap") >= 3, F.lit(False)).alias("chopped"))


def repair_words(spark, sf):
    e = _timed(spark, sf).withColumn("line", F.floor(F.col("start") / 86400).cast("int"))
    e = e.withColumn("wi", F.row_number().over(Window.partitionBy("user_id", "line").orderBy("event_id")))
    x = lo.repair_words(e, ["user_id", "line"], "wi")
    return x.select("user_id", "line", F.explode("ws").alias("s")).select("user_id", "line", "s.*")


def line_cascade(spark, sf):
    e = _timed(spark, sf).withColumn("line", F.floor(F.col("start") / 21600).cast("int"))
    g = e.groupBy("user_id", "line").agg(F.min("start").alias("start"), (F.min("start") + F.count("*") * 9000).alias("end"))
    x = lo.cascade(g, ["user_id"], "line")
    return x.select("user_id", F.explode("ls").alias("s")).select("user_id", "s.*")


def _document(spark, sf):
    """Timed documents of users: a line a day, words laid one after the other with their syllables."""
    e = _timed(spark, sf).withColumn("day", F.floor(F.col("start") / 86400).cast("int"))
    nxt = F.lead("start").over(Window.partitionBy("user_id").orderBy("start", "event_id"))
    e = e.withColumn("end", r3(F.least("end", F.coalesce(nxt, F.col("end"))))).filter("start < end")
    n = tx.latin_syllables(F.col("w"))
    syl = F.when(n > 1, tl.split_on_grid(F.col("start"), F.col("end"), n, F.lit(0.41), F.lit(0.4658)))
    word = F.struct("start", "end", "event_id", "w", F.lit(0.5).alias("conf"), syl.alias("syl"))
    g = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(word)).alias("ws"))
    words = F.transform("ws", lambda v: F.struct(v["w"].alias("w"), v["start"].alias("start"), v["end"].alias("end"), v["conf"].alias("conf"), v["syl"].alias("syl")))
    g = g.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("day")) - 1).withColumn("words", words)
    return g.select("user_id", "i", F.array_join("words.w", " ").alias("text"), F.element_at("words", 1)["start"].alias("start"), F.element_at("words", -1)["end"].alias("end"), "words")


def _broken(spark, sf):
    """Documents with every third line's text changed and its words' confidence out of range."""
    d = _document(spark, sf)
    worse = F.transform("words", lambda v: v.withField("conf", F.lit(1.5)))
    third = F.col("i") % 3 == 2
    return d.withColumn("words", F.when(third, worse).otherwise(F.col("words"))).withColumn("text", F.when(third, F.concat("text", F.lit("!"))).otherwise(F.col("text")))


def check_document(spark, sf):
    return checks.check_document(_broken(spark, sf), ["user_id"])


def check_document_broken(spark, sf):
    """What is found, counted, with a line count demanded that few documents have."""
    return checks.check_document(_broken(spark, sf), ["user_id"], n_lines=2).groupBy("rule").count().withColumnRenamed("count", "n")


def document_lines(spark, sf):
    """Users' events of six hours as the words of a line."""
    e = _timed(spark, sf).withColumn("line", F.floor(F.col("start") / 21600).cast("int"))
    e = e.withColumn("wi", F.row_number().over(Window.partitionBy("user_id", "line").orderBy("event_id"))).withColumn("end", F.col("end") + F.col("event_id") % 3 * 9000)
    e = e.withColumn("n", tx.latin_syllables(F.col("w"))).withColumn("cover", F.round((F.col("event_id") % 7) / 6, 4))
    x = lo.build_lines(e, ["user_id"], "line", "wi", 0.41, 0.4658)
    x = x.select("user_id", "line", F.col("start").alias("line_start"), F.col("end").alias("line_end"), F.posexplode("words").alias("k", "v"))
    return x.select("user_id", "line", "line_start", "line_end", "k", "v.w", "v.start", "v.end", "v.conf", F.coalesce(F.size("v.syl"), F.lit(0)).alias("n_syl"))


def _notes(spark, sf):
    """Events as units of their user's day, on the hours of a coarse lattice, two units to a word."""
    e = events(spark, sf).withColumn("line", F.floor(F.col("t") / 86400).cast("int"))
    e = e.withColumn("u", F.row_number().over(Window.partitionBy("user_id", "line").orderBy("t", "event_id"))).withColumn("word", F.floor((F.col("u") - 1) / 2).cast("int"))
    e = e.withColumn("t", F.floor(F.col("t") / 7200) * 7200.0 - F.when(F.col("event_id") % 5 == 0, 9000.0).otherwise(0.0)).withColumn("quiet", F.col("t") + F.col("event_id") % 4 * 1800.0)
    e = e.withColumn("t0", F.col("line") * 86400.0).withColumn("t1", F.col("t0") + 86400.0)
    return lo.place_units(e, ["user_id"], "line", "u")


def placed_units(spark, sf):
    return _notes(spark, sf).select("event_id", r3(F.col("start")).alias("start"), r3(F.col("stop")).alias("stop"))


def legacy_words(spark, sf):
    x = lo.words_of_units(_notes(spark, sf), ["user_id"], "line", "word", "u")
    x = x.withColumn("n_syl", F.coalesce(F.size("syl"), F.lit(0)))
    conf = tl.line_confidence(F.col("word") % 5 / 4, F.col("n_syl").cast("double"), F.lit(2.0))
    return x.select("user_id", "line", "word", "start", "end", "n_syl", conf.alias("conf"))


def split_word(spark, sf):
    """Events as words of one to three units, cut near marks of their own."""
    e = _timed(spark, sf).select("event_id", "start", "end", tx.latin_syllables(F.col("w")).alias("n"))
    weights = F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: ((F.col("event_id") + k) % 3 + 1).cast("double"))
    marks = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda j: F.col("start") + (F.col("event_id") % 5 + 1) * 0.07 * j)
    x = e.select("event_id", F.posexplode(tl.split_word(F.col("start"), F.col("end"), weights, marks, 0.12)).alias("k", "s"))
    return x.select("event_id", "k", "s.start", "s.end")


def link_words(spark, sf):
    """Conversations against themselves as heard: a piece for each word, every seventh one misheard, every fifth one cut."""
    w = _words(spark, sf).withColumn("pi", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "wi")))
    heard = F.when(F.col("pi") % 7 == 0, "zzz").when(F.col("pi") % 5 == 0, F.substring("w", 1, 2)).otherwise(F.col("w"))
    pieces = w.select("conv_id", "pi", heard.alias("text"), (F.col("pi") * 0.5).alias("start"), (F.col("pi") * 0.5 + 0.4).alias("end"), ((F.col("pi") % 10) / 10).alias("prob"))
    lines = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("li"), "text")
    return lo.link_words(lines, pieces, ["conv_id"]).select("conv_id", "li", "wi", "w", "start", "end", "prob")


def check_units(spark, sf):
    """The rules over parsed items that are broken by their length: a text that differs, a word without units, Latin units
    without weight."""
    x = parse_lines(table(spark, sf, "benchmark"), ["item_id", "text"], "text").groupBy("item_id", "text").agg(F.array_sort(F.collect_list(F.struct("wi", "token", "units"))).alias("x"))
    x = x.withColumn("n", F.length("text"))
    n, none = F.col("n"), F.array().cast(f"array<{UNIT}>")
    units = F.transform("x.units", lambda us, k: F.when((n % 3 == 1) & (k == 0), none).otherwise(us))
    light = F.transform(units, lambda us: F.transform(us, lambda u: F.when((n % 5 == 0) & (u["cls"] == "latin"), u.withField("morae", F.lit(0.0))).otherwise(u)))
    x = x.select("item_id", F.when(n % 3 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"), F.col("x.token").alias("words"), light.alias("units"))
    return checks.check_units(x, ["item_id"], "text", "words", "units")


def check_map(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", tx.words(F.col("text")).alias("words"), tx.words(F.lower("text")).alias("tokens"))
    broken = c.filter("role <> 'system'").withColumn("text", F.when(F.length("text") % 2 == 0, F.lit("?")).otherwise(F.col("text")))
    return checks.check_map(broken, c, ["conv_id", "turn"])


def check_allocation(spark, sf):
    x = proportional_allocate(spark, sf).withColumn("ratio", F.round(F.col("end") - F.col("start"), 4)).withColumn("density", F.round(1 / F.greatest(F.col("ratio"), F.lit(0.01)), 4))
    return checks.check_allocation(x, ["track", "k"])


def decode_checks(spark, sf):
    """Two ways to the same track must agree, at lag 0: sums by hour, and sums of sums by half hour; clicks one hour late."""
    a = hourly(spark, sf).select("track", "f", "x")
    e = events(spark, sf).groupBy(F.col("event_type").alias("track"), F.floor(F.col("t") / 1800).cast("int").alias("h")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("c"))
    late = F.when(F.col("track") == "click", 1).otherwise(0)
    b = e.groupBy("track", (F.floor(F.col("h") / 2).cast("int") + late).alias("f")).agg((F.sum("c").cast("double") / 100).alias("x2"))
    b = a.select("track", "f").join(b, ["track", "f"], "left").fillna(0.0, ["x2"])
    same = a.join(b, ["track", "f"]).groupBy("track").agg(F.bool_and(F.col("x") == F.col("x2")).alias("same"), F.count("*").alias("n"), F.max(F.abs(F.col("x") - F.col("x2"))).alias("diff"))
    lag = lo.lag_search(a, b.withColumnRenamed("x2", "x"), ["track"], "x", range(-3, 4), 100).groupBy("track").agg(F.min_by("lag", F.struct("mad", "lag")).alias("lag"))
    return same.join(lag, "track").select("track", "n", "same", F.round("diff", 4).alias("diff"), "lag", (F.col("same") & (F.col("lag") == 0)).alias("ok"))


def onset_budget(spark, sf):
    return sq.onsets(normal(spark, sf), ["track"], "y", 60).withColumn("strength", F.round("strength", 6))


def banded_align(spark, sf):
    o = sq.onsets(normal(spark, sf), ["track"], "y", 60).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("k", "strength"))).alias("x"))
    x = sq.align_tracks(o.select("track", F.lit(40).alias("slots"), F.col("x.strength").alias("strengths")), ["track"], "slots", "strengths")
    return x.withColumn("cost", F.round("cost", 6))


def stft_blocks(spark, sf):
    x = sq.stft(normal(spark, sf), ["track"], "y", 64, 16, "double")
    return x.select("track", "block", F.posexplode("mag").alias("bin", "mag")).withColumn("mag", F.round("mag", 4))


def band_rms(spark, sf):
    x = sq.band_rms(normal(spark, sf), ["track"], "y", "band", (0.02, 0.2), 1.0, 24, 12)
    return x.withColumn("rms", F.round("rms", 6))


PC = EV.replace("AS track", "AS kind") + """,
pc AS (SELECT user_id, floor(t / 86400)::INT AS line, event_id, kind AS text, t AS s, t + value / 100 AS e, event_id % 100 / 100.0::DOUBLE AS prob FROM ev),
ok AS (SELECT * FROM pc WHERE e - s > 0 AND NOT (e - s > 2.5 AND prob < 0.3::DOUBLE))"""
CL = """cg AS (SELECT *, sum(n) OVER (PARTITION BY user_id, line ORDER BY s, e, prob ROWS UNBOUNDED PRECEDING) AS cl FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id, line ORDER BY s, e, prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap}::DOUBLE THEN 1 ELSE 0 END AS n FROM ok)),
cl AS (SELECT user_id, line, cl::BIGINT AS cl, min(s) AS s, max(e) AS e, count(*)::BIGINT AS n, sum(prob) AS p FROM cg GROUP BY ALL)"""
HO = PC + """,
ho AS (SELECT user_id, line, event_id, text, (row_number() OVER (PARTITION BY user_id, line ORDER BY s, event_id) - 1)::INT AS wi, CASE WHEN prob >= 0.4::DOUBLE THEN s END AS s, CASE WHEN prob >= 0.4::DOUBLE THEN e END AS e, prob FROM pc),
nb AS (SELECT *, last_value(CASE WHEN s IS NOT NULL THEN {'i': wi, 'e': e} END IGNORE NULLS) OVER (PARTITION BY user_id, line ORDER BY wi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(CASE WHEN s IS NOT NULL THEN {'i': wi, 's': s} END IGNORE NULLS) OVER (PARTITION BY user_id, line ORDER BY wi ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM ho),
sl AS (SELECT *, b.e + greatest(a.s - b.e, 0) * (wi - b.i) / greatest(a.i - b.i, 1) AS st, b.e + greatest(a.s - b.e, 0) * (wi + 1 - b.i) / greatest(a.i - b.i, 1) AS en FROM nb),
fi AS (SELECT user_id, line, event_id, prob, s IS NULL AS filled,
  CASE WHEN s IS NOT NULL THEN s WHEN b IS NOT NULL AND a IS NOT NULL THEN round(st, 3) WHEN b IS NOT NULL THEN round(b.e, 3) WHEN a IS NOT NULL THEN round(greatest(a.s - 0.45::DOUBLE, 0), 3) END AS s,
  CASE WHEN s IS NOT NULL THEN e WHEN b IS NOT NULL AND a IS NOT NULL THEN round(least(en, st + 1 + 0.45::DOUBLE * length(text)), 3) WHEN b IS NOT NULL THEN round(b.e + 0.45::DOUBLE, 3) WHEN a IS NOT NULL THEN round(a.s, 3) END AS e FROM sl)"""
LAG = NR + """,
p AS (SELECT track, f, y, y - avg(y) OVER (PARTITION BY track) AS d, sqrt(sum(y * y) OVER (PARTITION BY track) - count(*) OVER (PARTITION BY track) * avg(y) OVER (PARTITION BY track) * avg(y) OVER (PARTITION BY track)) AS nm FROM nr),
lg AS (SELECT lag::INT AS lag, count(*)::BIGINT AS n, round(sum(a.d * b.d) / (max(a.nm) * max(b.nm)), 6) AS corr, round(avg(abs(a.y - b.y)), 6) AS mad FROM p a, range(-24, 25) r(lag), p b WHERE a.track = 'click' AND b.track = 'view' AND b.f = a.f + lag GROUP BY lag)"""
TM = f"""{EV}, tm AS (SELECT event_id, user_id, track AS w, round(t, 3) AS s, round(t + 0.3::DOUBLE + value / 50, 3) AS e, event_id % 100 / 100.0::DOUBLE AS prob, {SYL.format(w='track')}::INT AS n FROM ev)"""
ALLOC = f"""{RUNS}, rw AS (SELECT runs.track, "start" AS rs, "end" AS re, avg(y) AS mean FROM runs JOIN nr ON nr.track = runs.track AND f BETWEEN a AND b GROUP BY ALL),
cp AS (SELECT *, sum(c) OVER (PARTITION BY track ORDER BY rs) / sum(c) OVER (PARTITION BY track) AS c1 FROM (SELECT *, greatest((re - rs) * (0.5::DOUBLE + least(1, mean)), 0.001::DOUBLE) AS c FROM rw)),
cq AS (SELECT *, coalesce(lag(c1) OVER (PARTITION BY track ORDER BY rs), 0) AS c0 FROM cp),
ws AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')) AS w FROM conversations),
li AS (SELECT ['click', 'view', 'signup'][(conv_id % 3 + 1)::INT] AS track, conv_id, turn, sum({SYL.format(w='lower(w)')})::DOUBLE AS m FROM ws GROUP BY conv_id, turn),
lk AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY conv_id, turn) AS k FROM li WHERE track IN (SELECT track FROM rw)),
dm AS (SELECT track, k, sum(m) OVER (PARTITION BY track ORDER BY k) / sum(m) OVER (PARTITION BY track) AS d1 FROM lk), dd AS (SELECT *, coalesce(lag(d1) OVER (PARTITION BY track ORDER BY k), 0) AS d0 FROM dm),
al AS (SELECT dd.track, k::INT AS k, round(arg_min(rs + (re - rs) * (d0 - c0) / (c1 - c0), c1) FILTER (d0 < c1 - 1e-12::DOUBLE), 4) AS "start", round(arg_min(rs + (re - rs) * (d1 - c0) / (c1 - c0), c1) FILTER (d1 <= c1 + 1e-12::DOUBLE), 4) AS "end" FROM dd JOIN cq ON cq.track = dd.track GROUP BY dd.track, k)"""

def half_up(x: str, digits: int = 3) -> str:
    """A double rounded by its shortest decimal form, halves away from zero: values that are halves are common here."""
    return f"round(({x})::VARCHAR::DECIMAL(30, 14), {digits})::DOUBLE"


IDEAL = "s + (e - s) * {k} / n"
SNAP = "(0.41::DOUBLE + round_even(({x} - 0.41::DOUBLE) / (0.4658::DOUBLE / 2), 0) * (0.4658::DOUBLE / 2))"
#: Spans of the words (event_id, s, e, n) of a table on the lattice: (event_id, k, a, b), k from 0, rounded.
def spans(words: str) -> str:
    at, after = IDEAL.format(k="(k + 1)"), IDEAL.format(k="(k + 2)")
    return f"""ct(event_id, s, e, n, k, c) AS (SELECT event_id, s, e, n, 0, s FROM {words} UNION ALL
  SELECT event_id, s, e, n, k + 1, CASE WHEN k + 1 = n THEN e WHEN {after} - 0.02::DOUBLE < c + 0.02::DOUBLE THEN c + 0.02::DOUBLE ELSE least(greatest({SNAP.format(x=at)}, c + 0.02::DOUBLE), {after} - 0.02::DOUBLE) END FROM ct WHERE k < n),
pr AS (SELECT event_id, s, e, n, k - 1 AS k, lag(c) OVER (PARTITION BY event_id ORDER BY k) AS a, c AS b FROM ct),
sn AS (SELECT event_id, s, e, n, k::INT AS k, {half_up(f"CASE WHEN bad THEN {IDEAL.format(k='k')} ELSE a END")} AS a, {half_up(f"CASE WHEN bad THEN {IDEAL.format(k='(k + 1)')} ELSE b END")} AS b FROM (SELECT *, bool_or(b <= a) OVER (PARTITION BY event_id) AS bad FROM pr WHERE k >= 0))"""


#: Words rw (user_id, line, k, s, e, ...) of lines in order, repaired: rp (user_id, line, k, s, e).
REPAIR = """rr(user_id, line, k, s, e) AS (SELECT user_id, line, k, s, e FROM rw WHERE k = 1 UNION ALL
  SELECT x.user_id, x.line, x.k, CASE WHEN r.e - x.s > 0 AND NOT x.s - r.s >= 0.02::DOUBLE THEN round(r.e, 3) ELSE x.s END, CASE WHEN r.e - x.s > 0 AND NOT x.s - r.s >= 0.02::DOUBLE THEN round(greatest(x.e, r.e + 0.02::DOUBLE), 3) ELSE x.e END
  FROM rr r JOIN rw x ON x.user_id = r.user_id AND x.line = r.line AND x.k = r.k + 1),
rp AS (SELECT rr.user_id, rr.line, rr.k, rr.s, CASE WHEN rr.e - x.s > 0 AND x.s - rr.s >= 0.02::DOUBLE THEN round(x.s, 3) ELSE rr.e END AS e FROM rr LEFT JOIN rw x ON x.user_id = rr.user_id AND x.line = rr.line AND x.k = rr.k + 1)"""
NOTES = f"""{EV}, nu AS (SELECT event_id, user_id, floor(t / 86400)::INT AS line, t, row_number() OVER (PARTITION BY user_id, floor(t / 86400)::INT ORDER BY t, event_id) AS u FROM ev),
nt AS (SELECT *, ((u - 1) // 2)::INT AS word, t9 + event_id % 4 * 1800.0::DOUBLE AS quiet, line * 86400.0::DOUBLE AS t0, line * 86400.0::DOUBLE + 86400 AS t1 FROM (SELECT *, floor(t / 7200) * 7200.0::DOUBLE - CASE WHEN event_id % 5 = 0 THEN 9000 ELSE 0 END AS t9 FROM nu)),
nc AS (SELECT *, max(least(least(greatest(t9, t0 + 0.005::DOUBLE), t1 - 0.005::DOUBLE), CASE WHEN u = n THEN t1 - 0.02::DOUBLE ELSE t1 END)) OVER (PARTITION BY user_id, line ORDER BY u) AS m FROM (SELECT *, count(*) OVER (PARTITION BY user_id, line) AS n FROM nt)),
ng AS (SELECT *, sum(CASE WHEN m - p <= 1e-9::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, line ORDER BY u) AS g FROM (SELECT *, lag(m) OVER (PARTITION BY user_id, line ORDER BY u) AS p FROM nc)),
gr AS (SELECT user_id, line, g, min(m) AS s, arg_min(quiet, u) AS q, max(t1) AS t1, count(*) AS n FROM ng GROUP BY user_id, line, g),
ge AS (SELECT *, CASE WHEN e <= s THEN s + 0.02::DOUBLE ELSE e END AS e2 FROM (SELECT *, least(coalesce(lead(s) OVER (PARTITION BY user_id, line ORDER BY g), t1), q) AS e FROM gr)),
pl AS (SELECT event_id, ng.user_id, ng.line, word, u, CASE WHEN e2 - s < 0.001::DOUBLE * ge.n THEN s ELSE s + (e2 - s) * k / ge.n END AS a, CASE WHEN e2 - s < 0.001::DOUBLE * ge.n THEN e2 ELSE s + (e2 - s) * (k + 1) / ge.n END AS b FROM (SELECT *, row_number() OVER (PARTITION BY user_id, line, g ORDER BY u) - 1 AS k FROM ng) ng JOIN ge USING (user_id, line, g))"""
DOCS = f"""{TM}, dn AS (SELECT *, floor(s / 86400)::INT AS day, round(least(e, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id), e)), 3) AS e2 FROM tm),
dl AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY day) - 1)::INT AS i, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT DISTINCT user_id, day FROM dn WHERE s < e2))"""

#: Peaks of nr.y as sequences.onset_peaks() chooses them: (track, k, f, y) in kept.
ONSETS = f"""{NR}, c AS (SELECT *, sum(n) OVER (PARTITION BY track ORDER BY f) AS g FROM (SELECT *, CASE WHEN y = lag(y) OVER (PARTITION BY track ORDER BY f) THEN 0 ELSE 1 END AS n FROM nr)),
q AS (SELECT track, g, min(f) AS a, max(f) AS b, min(y) AS y FROM c GROUP BY track, g), z AS (SELECT *, lag(y) OVER w AS l, lead(y) OVER w AS r FROM q WINDOW w AS (PARTITION BY track ORDER BY g)),
h AS (SELECT track, coalesce(quantile_cont(y, 0.85) FILTER (y > 0), 1) AS h FROM nr GROUP BY track),
pk(track, rem, xs) AS (SELECT track, list({{'y': y, 'f': ((a + b) // 2)::INT}} ORDER BY y DESC, a + b DESC), [{{'y': 0.0::DOUBLE, 'f': 0::INT}}][2:] FROM z JOIN h USING (track) WHERE y > l AND y > r AND y >= h GROUP BY track
UNION ALL SELECT track, list_filter(rem, lambda x: abs(x.f - rem[1].f) >= 3), list_append(xs, rem[1]) FROM pk WHERE len(rem) > 0),
th(track, xs) AS (SELECT track, list(x ORDER BY x.f) FROM (SELECT track, unnest(xs) AS x FROM pk WHERE len(rem) = 0) GROUP BY track
UNION ALL SELECT track, xs[1:j - 1] || xs[j + 1:] FROM (SELECT track, xs, CASE WHEN xs[m].y <= xs[m + 1].y THEN m ELSE m + 1 END AS j
  FROM (SELECT track, xs, list_position(d, list_min(d)) AS m FROM (SELECT track, xs, list_transform(range(1, len(xs)), lambda i: xs[i + 1].f - xs[i].f) AS d FROM th WHERE len(xs) > 60)))),
kept AS (SELECT track, k, x.f AS f, x.y AS y FROM (SELECT track, unnest(range(len(xs)))::INT AS k, unnest(xs) AS x FROM th WHERE len(xs) <= 60))"""


def _cascade(name: str, source: str) -> str:
    """A recursive table name(track, f, o, states...) of the sections of band_rms() over source(track, f, y), f from 0."""
    sos = sq.butterworth("band", 4, (0.02, 0.2), 1.0)
    states = [f"s{k}{i}" for k in range(len(sos)) for i in (1, 2)]
    out, after, at = [], [], "d.y"
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos.tolist()):
        out.append(f"{b0!r}::DOUBLE * {at} + p.s{k}1 AS o{k}")
        after += [f"{b1!r}::DOUBLE * {at} - {a1!r}::DOUBLE * o{k} + p.s{k}2 AS n{k}1", f"{b2!r}::DOUBLE * {at} - {a2!r}::DOUBLE * o{k} AS n{k}2"]
        at = f"o{k}"
    fields = ", ".join(f"n{x[1:]}" for x in states)
    zero = ", ".join("0.0::DOUBLE" for _ in states)
    return f"""{name}(track, f, o, {", ".join(states)}) AS (SELECT DISTINCT track, -1, 0.0::DOUBLE, {zero} FROM {source}
UNION ALL SELECT track, f, {at}, {fields} FROM (SELECT d.track, d.f, {", ".join(out + after)} FROM {name} p JOIN {source} d ON d.track = p.track AND d.f = p.f + 1))"""


CATALOGUE = {
    "sound_pieces": (sound_pieces, f"WITH {PC} SELECT event_id FROM ok"),
    "time_clusters": (time_clusters, f"WITH {PC}, {CL.format(gap=7200)} SELECT user_id, line, cl, round(s, 3) AS \"start\", round(e, 3) AS \"end\", n, round(p, 2) AS p_sum FROM cl"),
    "best_cluster": (best_cluster, f"""WITH {PC}, {CL.format(gap=1.2)}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id, line ORDER BY n DESC, cl) AS k FROM cl WHERE NOT (e - s < 0.06::DOUBLE * n OR e - s > 1.5 + 0.8::DOUBLE * n OR p / n < 0.05::DOUBLE OR (n < 0.34 * 2 AND p / n < 0.25::DOUBLE)))
SELECT user_id, line, round(s, 3) AS "start", round(e, 3) AS "end", round(p / n, 3) AS prob FROM b WHERE k = 1"""),
    "fill_missing_inline": (fill_missing_inline, f'WITH {HO} SELECT event_id, round(s, 3) AS "start", round(e, 3) AS "end" FROM fi WHERE filled'),
    "spray_missing": (spray_missing, f"""WITH {RUNS}, q0 AS (SELECT greatest("start", 100.0::DOUBLE) AS a, least("end", 600.0::DOUBLE) AS b FROM runs WHERE track = 'click'), q1 AS (SELECT a, b FROM q0 WHERE a < b UNION ALL SELECT 100.0::DOUBLE, 600.0::DOUBLE WHERE NOT EXISTS (SELECT 1 FROM q0 WHERE a < b)),
sg AS (SELECT a, b, c1, c1 - (b - a) AS c0, max(c1) OVER () AS total FROM (SELECT a, b, sum(b - a) OVER (ORDER BY a) AS c1 FROM q1)),
ws AS (SELECT conv_id, turn, unnest(range(len(l))) AS wi, unnest(l) AS w FROM (SELECT conv_id, turn, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '') AS l FROM conversations)),
wk AS (SELECT conv_id AS track, row_number() OVER p AS k, length(w)::DOUBLE AS len, sum(length(w)::DOUBLE) OVER p AS c, sum(length(w)::DOUBLE) OVER (PARTITION BY conv_id) AS whole FROM ws WINDOW p AS (PARTITION BY conv_id ORDER BY turn, wi)),
u AS (SELECT track, k, len, total * c / whole AS u1, total * (c - len) / whole AS u0 FROM wk, (SELECT max(total) AS total FROM sg)),
x AS (SELECT track, k, max(len) AS len, max(u0) AS u0, max(u1) AS u1, arg_min(a + (u0 - c0), c1) FILTER (u0 <= c1 + 1e-9::DOUBLE) AS st, arg_min(b, c1) FILTER (u0 <= c1 + 1e-9::DOUBLE) AS st_end, arg_min(a + (u1 - c0), c1) FILTER (u1 <= c1 + 1e-9::DOUBLE) AS en FROM u, sg GROUP BY track, k),
y AS (SELECT track, k, st, least(CASE WHEN en - st > u1 - u0 + 0.35::DOUBLE THEN least(en, st_end) ELSE en END, st + 1 + 0.45::DOUBLE * len) AS e FROM x)
SELECT track, k::INT AS k, {half_up('st')} AS "start", {half_up('CASE WHEN e <= st THEN st + 0.02::DOUBLE ELSE e END')} AS "end" FROM y"""),
    "bad_line_flags": (bad_line_flags, f"WITH {HO} SELECT user_id, line, (max(e - s) > 6.5 OR max(prob) <= 0 OR max(e) - min(s) > 12 OR (count(*) > 1 AND max(e - s) > 0.75 * (max(e) - min(s)))) AS bad FROM fi WHERE s IS NOT NULL GROUP BY user_id, line"),
    "refine_windows": (refine_windows, f"""WITH {PC}, g AS (SELECT user_id, line, min(s) AS s, max(e) AS e, (max(e - s) > 6.5 OR max(prob) <= 0 OR max(e) - min(s) > 12 OR (count(*) > 1 AND max(e - s) > 0.75 * (max(e) - min(s)))) AS bad FROM pc GROUP BY user_id, line),
w AS (SELECT *, coalesce(lag(e) OVER p, 0) - 2 AS lo, coalesce(lead(s) OVER p, e + 25) + 2 AS hi FROM g WINDOW p AS (PARTITION BY user_id ORDER BY line)) SELECT user_id, line, round(greatest(lo, 0), 3) AS lo, round(hi, 3) AS hi FROM w WHERE bad"""),
    "merge_refined": (merge_refined, f"""WITH {PC}, o AS (SELECT user_id, line, event_id AS wi, prob, round(s, 3) AS a, round(e, 3) AS b FROM pc), w AS (SELECT *, prob >= 0.1::DOUBLE AS linked, round(a + 0.25::DOUBLE, 3) AS a2, round(b + CASE WHEN wi % 9 = 0 THEN 12.5 ELSE 0.25 END::DOUBLE, 3) AS b2 FROM o),
k AS (SELECT *, bool_and(linked AND b2 - a2 <= 12) OVER (PARTITION BY user_id, line) AS ok FROM w) SELECT user_id, line, wi, CASE WHEN ok THEN a2 ELSE a END AS "start", CASE WHEN ok THEN b2 ELSE b END AS "end", ok AS accepted FROM k"""),
    "lag_search": (lag_search, f"WITH {LAG} SELECT lag, n, corr, mad FROM lg"),
    "best_lag": (best_lag, f"WITH {LAG}, c AS (SELECT arg_min(lag, (mad, lag)) AS c FROM lg WHERE lag % 4 = 0), z AS (SELECT * FROM lg, c WHERE abs(lag - c) <= 4) SELECT arg_min(lag, (mad, lag)) AS lag, min(mad) AS mad, arg_max(lag, (corr, -lag)) AS corr_lag FROM z"),
    "proportional_allocate": (proportional_allocate, f"WITH {ALLOC} SELECT * FROM al"),
    "lattice_snap": (lattice_snap, f"WITH {EV} SELECT event_id, round(0.41::DOUBLE + round_even((t - 0.41::DOUBLE) / 0.2329169::DOUBLE, 0) * 0.2329169::DOUBLE, 3) AS snapped FROM ev"),
    "word_confidence": (word_confidence, "SELECT event_id, round(least(greatest(CASE WHEN p > 0 THEN p ELSE 0.5 END * (0.5::DOUBLE + 0.5::DOUBLE * c), 0), 1), 3) AS conf FROM (SELECT event_id, event_id % 100 / 100.0::DOUBLE AS p, round(event_id % 7 / 6.0::DOUBLE, 4) AS c FROM events)"),
    "split_on_grid": (split_on_grid, f"""WITH RECURSIVE {TM}, {spans('tm')} SELECT event_id, k, round(CASE WHEN n > 1 THEN (sum(CASE WHEN k > 0 THEN abs(a - ({IDEAL.format(k='k')})) END) OVER (PARTITION BY event_id)) / (n - 1) ELSE 0 END, 4) AS resid, a AS "start", b AS "end" FROM sn"""),
    "word_progress": (word_progress, f"""WITH RECURSIVE {TM}, {spans('tm')}, q AS (SELECT *, s + (e - s) * z AS t FROM sn, unnest([-0.1::DOUBLE, 0.25, 0.5, 0.75, 1.1]) u(z)),
g AS (SELECT event_id, z, max(s) AS s, max(e) AS e, max(t) AS t, max(n) AS n, count(*) FILTER (b <= t) AS done, arg_min((t - a) / (b - a), k) FILTER (a <= t AND t < b) AS part FROM q GROUP BY event_id, z)
SELECT event_id, z AS "at", round(CASE WHEN t <= s THEN 0 WHEN t >= e THEN 1 ELSE (done + coalesce(part, 0)) / n END, 4) AS p FROM g"""),
    "line_progress": (line_progress, f"""WITH {TM}, l AS (SELECT *, floor(s / 86400)::INT AS line, row_number() OVER (PARTITION BY user_id, floor(s / 86400) ORDER BY s, e, event_id, w) AS k FROM tm),
b AS (SELECT user_id, line, min(s) AS s, max(e) AS e FROM l GROUP BY ALL), t AS (SELECT DISTINCT user_id, line, unnest([s, (s + e) / 2, e]) AS t FROM b),
p AS (SELECT t.user_id, t.line, t.t, k, length(w) AS n, CASE WHEN t.t <= s THEN 0 WHEN t.t >= e THEN 1 ELSE (t.t - s) / (e - s) END AS p FROM t JOIN l USING (user_id, line)),
o AS (SELECT *, coalesce(min(p) OVER (PARTITION BY user_id, line, t ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) >= 1 AS open FROM p)
SELECT user_id, line, {half_up('o.t')} AS t, round(sum(CASE WHEN NOT open THEN 0 WHEN p >= 1 THEN n + 1 ELSE p * n END)::DOUBLE, 3) AS chars FROM o GROUP BY user_id, line, o.t"""),
    "split_word": (split_word, f"""WITH RECURSIVE {TM}, wt AS (SELECT event_id, s, e, n, list_transform(range(1, n + 1), lambda k: ((event_id + k) % 3 + 1)::DOUBLE) AS ws, list_transform(range(1, 5), lambda j: s + (event_id % 5 + 1) * 0.07::DOUBLE * j) AS ms FROM tm),
ct AS (SELECT *, 0 AS k, s AS c FROM wt UNION ALL SELECT event_id, s, e, n, ws, ms, k + 1, CASE WHEN k + 1 = n THEN e ELSE least(greatest(CASE WHEN abs(m - g) <= 0.12::DOUBLE AND m > c + 0.02::DOUBLE AND m < e - 0.02::DOUBLE THEN m ELSE g END, c + 0.02::DOUBLE), e - 0.02::DOUBLE * (n - k - 1)) END
  FROM (SELECT *, list_sort(list_transform(ms, lambda m: {{'d': abs(m - g), 'm': m}}))[1]['m'] AS m FROM (SELECT *, s + (e - s) * list_sum(ws[1:(k + 1)]) / list_sum(ws) AS g FROM ct WHERE k < n))),
pr AS (SELECT event_id, (k - 1)::INT AS k, {half_up('lag(c) OVER (PARTITION BY event_id ORDER BY k)')} AS a, {half_up('c')} AS b FROM ct) SELECT event_id, k, a AS "start", b AS "end" FROM pr WHERE k >= 0"""),
    "placed_units": (placed_units, f"""WITH {NOTES} SELECT event_id, {half_up('a')} AS "start", {half_up('b')} AS stop FROM pl"""),
    "legacy_words": (legacy_words, f"""WITH {NOTES}, wd AS (SELECT user_id, line, word, {half_up('arg_min(a, u)')} AS "start", {half_up('arg_max(b, u)')} AS "end", count(*) FILTER (b > a)::INT AS m FROM pl GROUP BY user_id, line, word), wn AS (SELECT *, CASE WHEN m > 1 THEN m ELSE 0 END AS n FROM wd)
SELECT user_id, line, word, "start", "end", n AS n_syl, {half_up('least(0.6::DOUBLE * (word % 5 / 4.0::DOUBLE) + 0.4::DOUBLE * least(n / 2.0::DOUBLE, 1), 0.5::DOUBLE + 0.5::DOUBLE * (word % 5 / 4.0::DOUBLE))', 2)} AS conf FROM wn"""),
    "link_words": (link_words, None),
    "document_lines": (document_lines, f"""WITH RECURSIVE {TM}, rw AS MATERIALIZED (SELECT user_id, floor(s / 21600)::INT AS line, event_id, w, n, prob, row_number() OVER (PARTITION BY user_id, floor(s / 21600)::INT ORDER BY event_id) AS k, s, greatest(e + event_id % 3 * 9000, s + 0.02::DOUBLE) AS e FROM tm), {REPAIR},
x AS (SELECT rp.*, w, n, prob, event_id, round(greatest(rp.e, rp.s + 0.02::DOUBLE), 3) AS stop FROM rp JOIN rw USING (user_id, line, k)),
l AS (SELECT *, lead(ls) OVER (PARTITION BY user_id ORDER BY line) AS nxt FROM (SELECT user_id, line, round(arg_min(s, k), 3) AS ls, arg_max(stop, k) AS le, max(k) AS last FROM x GROUP BY user_id, line)),
c AS (SELECT x.*, (k = last AND le > nxt AND nxt > round(x.s, 3)) AS cl, nxt FROM x JOIN l USING (user_id, line)),
d AS (SELECT user_id, line, (k - 1)::INT AS k, w, round(s, 3) AS a, CASE WHEN cl THEN round(greatest(nxt, round(s, 3) + 0.02::DOUBLE), 3) ELSE stop END AS b, round(least(greatest(CASE WHEN prob > 0 THEN prob ELSE 0.5 END * (0.5::DOUBLE + 0.5::DOUBLE * round(event_id % 7 / 6.0::DOUBLE, 4)), 0), 1), 3) AS conf, CASE WHEN n > 1 THEN n ELSE 0 END AS n_syl FROM c)
SELECT user_id, line, first_value(a) OVER v AS line_start, last_value(b) OVER v AS line_end, k, w, a AS "start", b AS "end", conf, n_syl FROM d WINDOW v AS (PARTITION BY user_id, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""),
    "frame_state": (frame_state, f"""WITH {RUNS}, g AS (SELECT *, "start" - lag("end") OVER (PARTITION BY track ORDER BY run_id) AS gap FROM runs), c AS (SELECT track, i::INT AS i, i * 4.0::DOUBLE AS t FROM (SELECT DISTINCT track FROM runs), range(180) r(i))
SELECT c.track, i, arg_min(run_id, run_id) AS run_id, coalesce(arg_min(gap >= 3, run_id), false) AS chopped FROM c JOIN g ON g.track = c.track AND t >= "start" AND t < "end" GROUP BY c.track, i"""),
    "repair_words": (repair_words, f"""WITH RECURSIVE {TM}, rw AS MATERIALIZED (SELECT user_id, floor(s / 86400)::INT AS line, row_number() OVER (PARTITION BY user_id, floor(s / 86400)::INT ORDER BY event_id) AS k, s, e FROM tm), {REPAIR} SELECT user_id, line, k::INT AS i, s AS "start", e AS "end" FROM rp"""),
    "line_cascade": (line_cascade, f"""WITH RECURSIVE {TM}, l AS (SELECT user_id, floor(s / 21600)::INT AS i, min(s) AS s, min(s) + count(*) * 9000 AS e FROM tm GROUP BY ALL), k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM l),
r(user_id, k, i, s, e) AS (SELECT user_id, k, i, round(s, 3), round(e, 3) FROM k WHERE k = 1 UNION ALL SELECT k.user_id, k.k, k.i, round(k.s + b, 3), round(k.e + b, 3) FROM (SELECT k.*, CASE WHEN r.e > k.s THEN r.e - k.s + 0.001::DOUBLE ELSE 0 END AS b FROM r JOIN k ON k.user_id = r.user_id AND k.k = r.k + 1) k)
SELECT user_id, i, s AS "start", e AS "end" FROM r"""),
    "check_document": (check_document, f"WITH {DOCS} SELECT unnest(['confidence', 'text']) AS rule, user_id, i FROM dl WHERE i % 3 = 2"),
    "check_document_broken": (check_document_broken, f"WITH {DOCS}, r AS (SELECT unnest(['confidence', 'text']) AS rule FROM dl WHERE i % 3 = 2 UNION ALL SELECT 'line count' FROM dl WHERE i = 0 AND n <> 2) SELECT rule, count(*)::BIGINT AS n FROM r GROUP BY rule"),
    "check_units": (check_units, f"""WITH b AS (SELECT item_id, length(text) AS n, string_split(text, ' ') AS ws FROM benchmark), r AS (SELECT *, [CASE WHEN n % 3 = 0 THEN 'text' END, CASE WHEN n % 3 = 1 AND ws[1] <> '' THEN 'token' END, CASE WHEN n % 5 = 0 AND regexp_matches(array_to_string(CASE WHEN n % 3 = 1 THEN ws[2:] ELSE ws END, ' '), '[A-Za-z'']') THEN 'weight' END] AS rs FROM b)
SELECT unnest(list_filter(rs, lambda x: x IS NOT NULL)) AS rule, item_id FROM r"""),
    "check_map": (check_map, "SELECT CASE WHEN role = 'system' THEN 'missing' ELSE 'text' END AS rule, conv_id, turn FROM conversations WHERE role = 'system' OR length(text) % 2 = 0"),
    "check_allocation": (check_allocation, f"""WITH {ALLOC}, x AS (SELECT *, round("end" - "start", 4) AS ratio, round(1 / greatest(round("end" - "start", 4), 0.01::DOUBLE), 4) AS density FROM al)
SELECT unnest(list_filter([CASE WHEN "end" - "start" < 0.25::DOUBLE THEN 'short' END, CASE WHEN "end" - "start" > 12 THEN 'long' END, CASE WHEN NOT ratio BETWEEN 0.5 AND 2 THEN 'ratio' END, CASE WHEN NOT density BETWEEN 0.4::DOUBLE AND 3.5 THEN 'density' END], lambda r: r IS NOT NULL)) AS rule, track, k FROM x"""),
    "decode_checks": (decode_checks, f"""WITH {FR}, h AS (SELECT track, floor(t / 1800)::INT AS h, sum(round(value * 100)::BIGINT) AS c FROM ev GROUP BY ALL), b AS (SELECT track, (h // 2 + (track = 'click')::INT)::INT AS f, sum(c)::DOUBLE / 100 AS x2 FROM h GROUP BY ALL),
j AS (SELECT fr.track, fr.f, x, coalesce(x2, 0) AS x2 FROM fr LEFT JOIN b ON b.track = fr.track AND b.f = fr.f), g AS (SELECT track, bool_and(x = x2) AS same, count(*)::BIGINT AS n, max(abs(x - x2)) AS diff FROM j GROUP BY track),
m AS (SELECT p.track, lag::INT AS lag, avg(abs(p.x - q.x2)) AS mad FROM j p, range(-3, 4) r(lag), j q WHERE q.track = p.track AND q.f = p.f + lag GROUP BY ALL), z AS (SELECT track, arg_min(lag, (mad, lag)) AS lag FROM m GROUP BY track)
SELECT track, n, same, round(diff, 4) AS diff, lag, same AND lag = 0 AS ok FROM g JOIN z USING (track)"""),
    "onset_budget": (onset_budget, f"""WITH RECURSIVE {ONSETS}
SELECT track, k, f, round(y / max(y) OVER (PARTITION BY track), 6) AS strength FROM kept"""),
    "banded_align": (banded_align, f"""WITH RECURSIVE {ONSETS},
o AS (SELECT track, k, y / max(y) OVER (PARTITION BY track) AS s FROM kept), oc AS (SELECT track, k, 0.25::DOUBLE * (1 - s) AS soft, sum(0.6::DOUBLE * (1 - s)) OVER (PARTITION BY track ORDER BY k) AS cum FROM o),
st AS MATERIALIZED (SELECT track, count(*)::INT AS n, list(soft ORDER BY k) AS soft, [0.0::DOUBLE] || list(cum ORDER BY k) AS cum FROM oc GROUP BY track),
dp(track, i, r, how) AS (SELECT track, 0, [0.0::DOUBLE] || list_transform(range(n), lambda j: 1e9::DOUBLE), []::INT[] FROM st
UNION ALL SELECT track, i, [1e9::DOUBLE] || list_transform(range(1, n + 1), lambda j: CASE WHEN j BETWEEN a AND b THEN least(al[j], be[j]) ELSE 1e9 END),
  list_transform(range(1, n + 1), lambda j: CASE WHEN j NOT BETWEEN a AND b THEN 0 WHEN al[j] < be[j] - 1e-9::DOUBLE THEN 3 WHEN mt[j] <= hd[j] THEN 1 ELSE 2 END)
  FROM (SELECT *, list_transform(range(1, n + 1), lambda j: CASE WHEN j BETWEEN a AND b THEN list_min(list_transform(range(a, j + 1), lambda t: be[t] - cum[t + 1])) + cum[j + 1] ELSE 1e9 END) AS al
  FROM (SELECT *, list_transform(range(1, n + 1), lambda j: least(mt[j], hd[j])) AS be
  FROM (SELECT *, list_transform(range(1, n + 1), lambda j: r[j] + soft[j]) AS mt, list_transform(range(1, n + 1), lambda j: r[j + 1] + 0.9::DOUBLE) AS hd
  FROM (SELECT dp.track, dp.i + 1 AS i, r, n, soft, cum, greatest(1, round_even((dp.i + 1) * n / 40.0::DOUBLE, 0)::INT - greatest(60, floor(0.2::DOUBLE * n)::INT)) AS a, least(n, round_even((dp.i + 1) * n / 40.0::DOUBLE, 0)::INT + greatest(60, floor(0.2::DOUBLE * n)::INT)) AS b
  FROM dp JOIN st ON st.track = dp.track WHERE dp.i < 40))))),
e AS (SELECT dp.track, list_transform(range(0, n + 1), lambda j: r[j + 1] + cum[n + 1] - cum[j + 1]) AS ends FROM dp JOIN st ON st.track = dp.track WHERE i = 40),
hw AS MATERIALIZED (SELECT track, list(how ORDER BY i) AS how FROM dp WHERE i > 0 GROUP BY track),
tb(track, i, j, slot, onset) AS (SELECT track, 40, (list_position(ends, list_min(ends)) - 1)::INT, NULL::INT, NULL::INT FROM e
UNION ALL SELECT track, i - (h < 3)::INT, j - (h <> 2)::INT, CASE WHEN h = 1 THEN i - 1 END, CASE WHEN h = 1 THEN j - 1 END FROM (SELECT tb.track, i, j, how[i][j] AS h FROM tb JOIN hw ON hw.track = tb.track WHERE i > 0 AND j > 0) WHERE h > 0),
m AS (SELECT track, slot, onset FROM tb WHERE slot IS NOT NULL)
SELECT e.track, sl.slot::INT AS slot, m.onset, round(list_min(ends), 6) AS cost, (SELECT count(*) FROM m c WHERE c.track = e.track)::INT AS n_match FROM e JOIN range(40) sl(slot) ON true LEFT JOIN m ON m.track = e.track AND m.slot = sl.slot"""),
    "stft_blocks": (stft_blocks, f"""WITH {NR}, bs AS (SELECT b.k AS bin, j, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 63) AS w, 2 * pi() * b.k * j / 64 AS a FROM range(33) b(k), range(64) r(j)),
p AS (SELECT track, f + 32 AS i, y FROM nr), m AS (SELECT track, block, bin, sqrt(pow(sum(y * w * cos(a)), 2) + pow(sum(y * w * sin(a)), 2)) AS mag FROM range(46) r(block) JOIN p ON i >= block * 16 AND i < block * 16 + 64 JOIN bs ON j = i - block * 16 GROUP BY ALL)
SELECT track, block::INT AS block, bin::INT AS bin, round(mag, 4) AS mag FROM m"""),
    "band_rms": (band_rms, f"""WITH RECURSIVE {NR}, d1 AS MATERIALIZED (SELECT track, f, y FROM nr), {_cascade("up", "d1")}, d2 AS MATERIALIZED (SELECT track, 719 - f AS f, o AS y FROM up WHERE f >= 0), {_cascade("down", "d2")}
SELECT track, f // 12 AS f, round(r, 6) AS rms FROM (SELECT track, 719 - f AS f, sqrt(sum(o * o) OVER (PARTITION BY track ORDER BY 719 - f ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) / 24) AS r FROM down WHERE f >= 0) WHERE f % 12 = 0"""),
}
