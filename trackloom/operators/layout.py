"""From recognised pieces to timed words, lines and documents."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.timeline import LEAST, emit_word, r3
from trackloom.operators.intervals import next_of


def sound_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces (start, end, prob) without empty ones and without long improbable ones."""
    d = F.col("end") - F.col("start")
    return pieces.filter((d > 0) & ~((d > 2.5) & (F.col("prob") < 0.3)))


def clusters(hits: DataFrame, keys: list[str], gap: float = 1.2) -> DataFrame:
    """(keys, cl, start, end, n, p): hits in order of start, end, prob; a new cluster where the next start is more than
    `gap` after all ends so far."""
    w = Window.partitionBy(*keys).orderBy("start", "end", "prob")
    far = F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) + gap
    x = hits.withColumn("cl", F.sum(F.when(far, 1).otherwise(0)).over(w))
    return x.groupBy(*keys, "cl").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.sum("prob").alias("p_sum"))


def best_cluster(found: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """Of the plausible clusters that with most hits, the earlier of equals: (keys, start, end, prob)."""
    d, p = F.col("end") - F.col("start"), F.col("p_sum") / F.col("n")
    bad = (d < 0.06 * F.col("n")) | (d > 1.5 + 0.8 * F.col("n")) | (p < 0.05) | ((F.col("n") < 0.34 * length) & (p < 0.25))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "cl")
    x = found.filter(~bad).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return x.select(*keys, r3(F.col("start")).alias("start"), r3(F.col("end")).alias("end"), r3(p).alias("prob"))


def fill_in_line(words: DataFrame, keys: list[str], order: str, length: Column) -> DataFrame:
    """Words with null start and end get times from the nearest known words of their line: slots between both, the
    first slot left empty, each at most 1 + .45 per character; .45 s after the last or before the first known one.
    Lines without any known word stay null."""
    w = Window.partitionBy(*keys).orderBy(order)
    known = F.when(F.col("start").isNotNull(), F.struct(F.col(order).alias("i"), "start", "end"))
    x = words.withColumn("_k", known)
    x = x.withColumn("_b", F.last("_k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_a", F.last("_k", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)))
    lo, hi = F.col("_b.end"), F.col("_a.start")
    span, bucket, k = F.greatest(hi - lo, F.lit(0.0)), F.greatest(F.col("_a.i") - F.col("_b.i"), F.lit(1)), F.col(order) - F.col("_b.i")
    st = lo + span * k / bucket
    en = F.least(lo + span * (k + 1) / bucket, st + 1.0 + 0.45 * F.greatest(length, F.lit(1)))
    both = F.col("_b").isNotNull() & F.col("_a").isNotNull()
    start = F.when(both, st).when(F.col("_b").isNotNull(), lo).when(F.col("_a").isNotNull(), F.greatest(hi - 0.45, F.lit(0.0)))
    end = F.when(both, en).when(F.col("_b").isNotNull(), lo + 0.45).otherwise(hi)
    missing = F.col("start").isNull()
    return x.withColumn("_s", F.when(missing, r3(start)).otherwise(F.col("start"))).withColumn("_e", F.when(missing, r3(end)).otherwise(F.col("end"))).withColumn("filled", missing).drop("start", "end", "_k", "_b", "_a").withColumnRenamed("_s", "start").withColumnRenamed("_e", "end")


def spray(words: DataFrame, runs: DataFrame, keys: list[str], order: str, weight: str) -> DataFrame:
    """(keys, order, weight, lo, hi) words of one unlinked stretch, spread over the active time of runs (keys, rs, re)
    within lo..hi in proportion to weight (all of lo..hi if no run is there). A word that would straddle a silence ends
    with the run it starts in; none is wider than 1 + .45 per weight."""
    span = words.groupBy(*keys).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.sum(weight).alias("_w"))
    cut = runs.join(span.select(*keys, "lo", "hi"), keys).withColumn("a", F.greatest("rs", "lo")).withColumn("b", F.least("re", "hi")).filter("a < b").select(*keys, "a", "b")
    none = span.join(cut.select(*keys).distinct(), keys, "left_anti").select(*keys, F.col("lo").alias("a"), F.col("hi").alias("b"))
    w = Window.partitionBy(*keys).orderBy("a")
    segs = cut.unionByName(none).withColumn("c1", F.sum(F.col("b") - F.col("a")).over(w)).withColumn("c0", F.col("c1") - (F.col("b") - F.col("a")))
    total = segs.groupBy(*keys).agg(F.max("c1").alias("_total"))
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = words.join(span.select(*keys, "_w"), keys).join(total, keys).withColumn("_c", F.sum(weight).over(before))
    x = x.withColumn("u1", F.col("_total") * F.col("_c") / F.col("_w")).withColumn("u0", F.col("_total") * (F.col("_c") - F.col(weight)) / F.col("_w"))

    def at(frame: DataFrame, u: str, out: str) -> DataFrame:
        # the first segment whose cumulative end reaches u
        hit = next_of(frame, segs.withColumn("_reach", F.col("c1") + 1e-9).select(*keys, "a", "b", "c0", "_reach"), keys, u, "_reach", "_s")
        return hit.withColumn(out, F.col("_s.a") + (F.col(u) - F.col("_s.c0"))).withColumn(f"{out}_end", F.col("_s.b")).drop("_s")

    x = at(at(x, "u0", "st"), "u1", "en")
    straddles = F.col("en") - F.col("st") > F.col("u1") - F.col("u0") + 0.35
    end = F.when(straddles, F.least("en", "st_end")).otherwise(F.col("en"))
    end = F.least(end, F.col("st") + 1.0 + 0.45 * F.col(weight))
    x = x.withColumn("end", r3(F.when(end <= F.col("st"), F.col("st") + LEAST).otherwise(end))).withColumn("start", r3(F.col("st")))
    return x.drop("_w", "_total", "_c", "u0", "u1", "st", "en", "st_end", "en_end")


def bad_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bad): a word over 6.5 s, no probability at all, over 12 s, or one word with over 75 % of the line."""
    d = F.col("end") - F.col("start")
    g = words.groupBy(*keys).agg(F.max(d).alias("_d"), F.max("prob").alias("_p"), (F.max("end") - F.min("start")).alias("_s"), F.count("*").alias("_n"))
    bad = (F.col("_d") > 6.5) | (F.col("_p") <= 0) | (F.col("_s") > 12) | ((F.col("_n") > 1) & (F.col("_d") > 0.75 * F.col("_s")))
    return g.select(*keys, bad.alias("bad"))


def allocate(lines: DataFrame, runs: DataFrame, keys: list[str], order: str, weight: str) -> DataFrame:
    """(keys, order, start, end): lines in proportion to weight over the runs (keys, rs, re, mean), whose capacity is
    their length by (.5 + min(1, mean)); the inverse of the cumulative capacity is linear within a run."""
    cap = F.greatest((F.col("re") - F.col("rs")) * (0.5 + F.least(F.lit(1.0), F.col("mean"))), F.lit(1e-3))
    w = Window.partitionBy(*keys)
    r = runs.withColumn("_c", cap).withColumn("c1", F.sum("_c").over(w.orderBy("rs")) / F.sum("_c").over(w))
    r = r.withColumn("c0", F.coalesce(F.lag("c1").over(w.orderBy("rs")), F.lit(0.0))).select(*keys, "rs", "re", "c0", "c1")
    d = lines.withColumn("d1", F.sum(weight).over(w.orderBy(order)) / F.sum(weight).over(w))
    d = d.withColumn("d0", F.coalesce(F.lag("d1").over(w.orderBy(order)), F.lit(0.0)))

    def place(frame: DataFrame, u: str, out: str, slack: float, strict: bool) -> DataFrame:
        # the first run whose cumulative capacity passes u
        x = next_of(frame, r.withColumn("_reach", F.col("c1") + slack), keys, u, "_reach", "_r", strict=strict)
        return x.withColumn(out, F.col("_r.rs") + (F.col("_r.re") - F.col("_r.rs")) * (F.col(u) - F.col("_r.c0")) / (F.col("_r.c1") - F.col("_r.c0"))).drop("_r")

    x = place(place(d, "d0", "start", -1e-12, True), "d1", "end", 1e-12, False)
    return x.join(r.select(*keys).distinct(), keys, "left_semi").select(*keys, order, weight, "start", "end")


def repair_words(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, ws): the words of a line in order: one that starts before the last one's start is pushed right; on an
    overlap the last one is shortened if LEAST remains of it, else this one is pushed."""
    item = "array<struct<i:int,start:double,end:double>>"
    rows = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("int").alias("i"), "start", "end"))).alias("ws"))

    def step(acc: Column, w: Column) -> Column:
        last, size = F.element_at(acc, -1), F.size(acc)
        over = last["end"] - w["start"]
        room = w["start"] - last["start"] >= LEAST
        shorter = F.concat(F.slice(acc, 1, size - 1), F.array(F.struct(last["i"].alias("i"), last["start"].alias("start"), r3(w["start"]).alias("end"))))
        pushed = F.struct(w["i"].alias("i"), r3(last["end"]).alias("start"), r3(F.greatest(w["end"], last["end"] + LEAST)).alias("end"))
        return F.when((size == 0) | (over <= 0), F.concat(acc, F.array(w))).when(room, F.concat(shorter, F.array(w))).otherwise(F.concat(acc, F.array(pushed)))

    return rows.withColumn("ws", F.aggregate("ws", F.array().cast(item), step))


def build_lines(words: DataFrame, keys: list[str], line: str, order: str, phase: float, period: float, subdiv: float = 2.0) -> DataFrame:
    """(keys, line, start, end, words) of a document from words (keys, line, order, w, start, end, n, prob, cover) with n
    syllables each: widths of LEAST at least, repair within the line, words emitted with their syllables, and a line
    that reaches into the next one loses the end of its last word, which is emitted anew."""
    ks = [*keys, line]
    wide = words.withColumn("end", F.greatest("end", F.col("start") + LEAST))
    fixed = repair_words(wide, ks, order).select(*ks, F.explode("ws").alias("s")).select(*ks, F.col("s.i").alias(order), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    x = fixed.join(words.select(*ks, F.col(order).cast("int").alias(order), "w", "n", "prob", "cover"), [*ks, order])
    stop = r3(F.greatest("end", F.col("start") + LEAST))
    per = x.groupBy(*ks).agg(r3(F.min_by("start", order)).alias("_s"), F.max_by(stop, order).alias("_e"), F.max(order).alias("_last"))
    per = per.withColumn("_next", F.lead("_s").over(Window.partitionBy(*keys).orderBy(line)))
    x = x.join(per, ks)
    clamp = (F.col(order) == F.col("_last")) & (F.col("_e") > F.col("_next")) & (F.col("_next") > r3(F.col("start")))
    word = emit_word(F.col("w"), F.when(clamp, r3(F.col("start"))).otherwise(F.col("start")), F.when(clamp, F.col("_next")).otherwise(F.col("end")), F.col("n"), F.col("prob"), F.col("cover"), F.lit(phase), F.lit(period), subdiv)
    out = x.select(*ks, F.struct(F.col(order).alias("i"), word.alias("v")).alias("x")).groupBy(*ks).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    found = F.col("xs.v")
    return out.select(*ks, F.element_at(found, 1)["start"].alias("start"), F.element_at(found, -1)["end"].alias("end"), found.alias("words"))


def link_words(lines: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """lines (keys, li, text), pieces (keys, pi, text, start, end, prob) -> (keys, li, wi, w, start, end, prob) of every
    word, times null where nothing was heard: sound pieces, common blocks of the two folded character streams, and of a
    word's matched characters the best cluster in time.

    All joins are by sort and merge: rows are put at one for each row before an explosion or a UDTF, so by size words and
    characters of any number would be broadcast."""
    from trackloom.functions import text as tx
    from trackloom.operators.sequences import MatchingBlocks

    words = lines.select(*keys, "li", F.posexplode(tx.words(F.col("text"))).alias("wi", "w")).withColumn("_f", tx.fold(F.col("w")))
    heard = sound_pieces(pieces).withColumn("_f", tx.fold(F.col("text")))

    def stream(rows: DataFrame, order: list[str], name: str) -> DataFrame:
        x = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "_f"))).alias("_x"))
        return x.select(*keys, F.array_join(F.col("_x._f"), "").alias(name))

    def places(rows: DataFrame, order: list[str], at: str) -> DataFrame:
        n = F.length("_f")
        x = rows.withColumn("_0", F.sum(n).over(Window.partitionBy(*keys).orderBy(*order)) - n).filter(n > 0)
        return x.withColumn(at, F.explode(F.sequence(F.col("_0").cast("int"), (F.col("_0") + n - 1).cast("int"))))

    both = stream(words, ["li", "wi"], "_a").join(stream(heard, ["pi"], "_b").hint("merge"), keys)
    # few bytes, much work: dealt anew by number, partitions aren't joined into fewer ones
    both = both.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = both.lateralJoin(MatchingBlocks(F.col("_a").outer(), F.col("_b").outer()).alias("m")).filter("m.size > 0")
    blocks = blocks.select(*keys, F.col("m.a").alias("_p"), F.col("m.b").alias("_q"), F.explode(F.sequence(F.lit(0), F.col("m.size") - 1)).alias("_k"))
    at = blocks.select(*keys, (F.col("_p") + F.col("_k")).alias("_p"), (F.col("_q") + F.col("_k")).alias("_q"))
    of_words, of_heard = places(words, ["li", "wi"], "_p").select(*keys, "li", "wi", "_p"), places(heard, ["pi"], "_q").select(*keys, "start", "end", "prob", "_q")
    hits = at.join(of_words.hint("merge"), [*keys, "_p"]).join(of_heard.hint("merge"), [*keys, "_q"])
    ids = [*keys, "li", "wi"]
    found = clusters(hits.select(*ids, "start", "end", "prob"), ids).join(words.select(*ids, F.greatest(F.length("_f"), F.lit(1)).alias("_len")).hint("merge"), ids)
    return words.drop("_f").join(best_cluster(found, ids, F.col("_len")).hint("merge"), ids, "left")


def accept_refined(old: DataFrame, new: DataFrame, keys: list[str], longest: float = 12.0) -> DataFrame:
    """old and new (keys, wi, start, end, prob): a line's new times replace the old ones if every word of it was linked
    and none lasts longer than `longest`; accepted tells."""
    x = old.join(new.select(*keys, "wi", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("prob").alias("_p")), [*keys, "wi"], "left")
    line = Window.partitionBy(*keys)
    ok = F.min((F.col("_s").isNotNull() & F.coalesce(F.col("_e") - F.col("_s") <= longest, F.lit(False))).cast("int")).over(line) == 1
    x = x.withColumn("accepted", ok)
    pick = lambda a, b: F.when(F.col("accepted"), F.col(b)).otherwise(F.col(a)).alias(a)
    return x.select(*keys, "wi", pick("start", "_s"), pick("end", "_e"), pick("prob", "_p"), "accepted")


def place_units(units: DataFrame, keys: list[str], line: str, order: str, tie: float = 1e-9, least: float = 0.001) -> DataFrame:
    """units (keys, line, order, t, quiet, t0, t1) with start and stop: starts are kept inside their line's t0..t1 and in
    order; units of one start share its note, which lasts up to the next start (the line's end), but not beyond `quiet`,
    where the voice stops after it, and LEAST if nothing is left; shares are even, or all the whole of a note that is
    too short."""
    ks = [*keys, line]
    w = Window.partitionBy(*ks).orderBy(order)
    last = F.lead(order).over(w).isNull()
    inside = F.least(F.greatest("t", F.col("t0") + 0.005), F.col("t1") - 0.005)
    x = units.withColumn("_t", F.when(last, F.least(inside, F.col("t1") - LEAST)).otherwise(inside))
    x = x.withColumn("_t", F.max("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_g", F.sum(F.when(F.col("_t") - F.lag("_t").over(w) <= tie, 0).otherwise(1)).over(w))
    note = x.groupBy(*ks, "_g").agg(F.min("_t").alias("_s"), F.min_by("quiet", order).alias("_q"), F.max("t1").alias("_1"), F.count("*").alias("_n"))
    stop = F.least(F.coalesce(F.lead("_s").over(Window.partitionBy(*ks).orderBy("_g")), F.col("_1")), F.coalesce("_q", F.col("_1")))
    note = note.withColumn("_e", stop).withColumn("_e", F.when(F.col("_e") <= F.col("_s"), F.col("_s") + LEAST).otherwise(F.col("_e")))
    x = x.join(note.drop("_q", "_1"), [*ks, "_g"]).withColumn("_k", F.row_number().over(Window.partitionBy(*ks, "_g").orderBy(order)) - 1)
    room = F.col("_e") - F.col("_s")
    whole = room < F.lit(least) * F.col("_n")
    start = F.when(whole, F.col("_s")).otherwise(F.col("_s") + room * F.col("_k") / F.col("_n"))
    end = F.when(whole, F.col("_e")).otherwise(F.col("_s") + room * (F.col("_k") + 1) / F.col("_n"))
    return x.withColumn("start", start).withColumn("stop", end).drop("_t", "_g", "_s", "_e", "_n", "_k")


def words_of_units(placed: DataFrame, keys: list[str], line: str, word: str, order: str) -> DataFrame:
    """(keys, line, word, start, end, syl) from what place_units() returns: a word reaches from its first unit to its
    last; syl holds its units of some width if there are several."""
    span = F.struct(F.col(order).alias("i"), r3(F.col("start")).alias("start"), r3(F.col("stop")).alias("end"))
    g = placed.groupBy(*keys, line, word).agg(r3(F.min_by("start", order)).alias("start"), r3(F.max_by("stop", order)).alias("end"), F.array_sort(F.collect_list(F.when(F.col("stop") > F.col("start"), span))).alias("_s"))
    syl = F.transform("_s", lambda v: F.struct(v["start"].alias("start"), v["end"].alias("end")))
    return g.withColumn("syl", F.when(F.size("_s") > 1, syl)).drop("_s")


def cascade(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, ls): lines in order; one that starts before the last one's end moves, as a whole, .001 past it."""
    rows = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("int").alias("i"), "start", "end"))).alias("ls"))

    def step(acc: Column, x: Column) -> Column:
        over = F.element_at(acc, -1)["end"] - x["start"]
        by = F.when((F.size(acc) > 0) & (over > 0), over + 0.001).otherwise(0.0)
        return F.concat(acc, F.array(F.struct(x["i"].alias("i"), r3(x["start"] + by).alias("start"), r3(x["end"] + by).alias("end"))))

    return rows.withColumn("ls", F.aggregate("ls", F.array().cast("array<struct<i:int,start:double,end:double>>"), step))


def lag_search(a: DataFrame, b: DataFrame, keys: list[str], x: str, lags: range, least_pairs: int = 1) -> DataFrame:
    """(keys, lag, n, corr, mad): for each lag the pairs a[f], b[f + lag], their centred correlation over the norms of
    all frames, and their mean absolute difference. An equi-join per lag value, summed before it is shuffled."""
    def centred(t: DataFrame, name: str) -> DataFrame:
        m = t.groupBy(*keys).agg(F.avg(x).alias("_m"), F.sqrt(F.sum(F.col(x) * F.col(x)) - F.count("*") * F.avg(x) * F.avg(x)).alias(f"norm_{name}"))
        return t.join(m, keys).select(*keys, "f", F.col(x).alias(name), (F.col(x) - F.col("_m")).alias(f"d_{name}"), f"norm_{name}")

    steps = F.array(*[F.lit(k) for k in lags])
    left = centred(a, "a").withColumn("lag", F.explode(steps)).withColumn("f", F.col("f") + F.col("lag"))
    g = left.join(centred(b, "b"), [*keys, "f"]).groupBy(*keys, "lag")
    out = g.agg(F.count("*").alias("n"), (F.sum(F.col("d_a") * F.col("d_b")) / (F.first("norm_a") * F.first("norm_b"))).alias("corr"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mad"))
    return out.filter(F.col("n") >= least_pairs)
