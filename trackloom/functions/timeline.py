"""Scalar functions of time: lattices, syllable spans, progress. Folds over the few syllables of one word."""

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 0.02
SPANS = "array<struct<start:double,end:double>>"


def r3(c: Column) -> Column:
    return F.round(c, 3)


def snap(t: Column, phase: Column, step: Column) -> Column:
    """The nearest point of the lattice phase + k * step, halves to the even one."""
    return phase + F.rint((t - phase) / step) * step


def once(x: Column, f) -> Column:
    """f(x), with x computed once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def split_on_grid(start: Column, end: Column, n: Column, phase: Column, period: Column, subdiv: float = 2.0) -> Column:
    """n spans that tile start..end: even cuts snapped to the lattice of period / subdiv, each at least LEAST after
    the cut before and before the next even one; even spans where that leaves none."""
    ideal = lambda k: start + (end - start) * k / n
    inner = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))

    def cut(acc: Column, k: Column) -> Column:
        before, high = F.element_at(acc, -1), ideal(k + 1) - LEAST
        low = before + LEAST
        s = F.least(F.greatest(snap(ideal(k), phase, period / subdiv), low), high)
        return F.concat(acc, F.array(F.when(high < low, low).otherwise(s)))

    def spans(cuts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.element_at(cuts, k).alias("start"), F.element_at(cuts, k + 1).alias("end")))

    even = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(ideal(k - 1).alias("start"), ideal(k).alias("end")))
    found = once(F.concat(F.aggregate(inner, F.array(start), cut), F.array(end)), spans)
    found = once(found, lambda x: F.when(F.exists(x, lambda s: s["end"] <= s["start"]), even).otherwise(x))
    return F.transform(found, lambda s: F.struct(r3(s["start"]).alias("start"), r3(s["end"]).alias("end")))


def split_word(start: Column, end: Column, weights: Column, marks: Column, tol: float) -> Column:
    """Spans that tile start..end in proportion to weights, each cut moved to the nearest mark (the earlier of equals) if
    that is at most tol away and more than LEAST inside the cut before and the end; then kept LEAST after the cut before
    and LEAST for each span to come before the end. Rounded to .001. marks: array<double>."""
    n = F.size(weights)
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)

    def cut(acc: Column, k: Column) -> Column:
        before, done = F.element_at(acc["cuts"], -1), acc["done"] + F.element_at(weights, k)
        target = start + (end - start) * done / total
        best = F.array_min(F.transform(marks, lambda m: F.struct(F.abs(m - target).alias("d"), m.alias("m"))))
        near = (best["d"] <= tol) & (best["m"] > before + LEAST) & (best["m"] < end - LEAST)
        at = F.least(F.greatest(F.when(near, best["m"]).otherwise(target), before + LEAST), end - LEAST * (n - k))
        return F.struct(F.concat(acc["cuts"], F.array(at)).alias("cuts"), done.alias("done"))

    inner = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    cuts = F.aggregate(inner, F.struct(F.array(start).alias("cuts"), F.lit(0.0).alias("done")), cut, lambda acc: F.concat(acc["cuts"], F.array(end)))
    return once(cuts, lambda c: F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(r3(F.element_at(c, k)).alias("start"), r3(F.element_at(c, k + 1)).alias("end"))))


def emit_word(w: Column, start: Column, end: Column, n: Column, prob: Column, cover: Column, phase: Column, period: Column, subdiv: float = 2.0) -> Column:
    """A document's word: at least LEAST wide, syl only for more than one syllable, conf from prob and coverage."""
    end = F.greatest(end, start + LEAST)
    syl = F.when(n > 1, split_on_grid(start, end, n, phase, period, subdiv))
    return F.struct(w.alias("w"), r3(start).alias("start"), r3(end).alias("end"), confidence(prob, cover).alias("conf"), syl.alias("syl"))


def residual(spans: Column, start: Column, end: Column) -> Column:
    """Mean distance of the inner cuts from even ones; 0 for one span."""
    n = F.size(spans)
    off = F.transform(F.when(n > 1, F.sequence(F.lit(2), n)), lambda k: F.abs(F.element_at(spans, k)["start"] - (start + (end - start) * (k - 1) / n)))
    return F.when(n > 1, F.aggregate(off, F.lit(0.0), lambda a, x: a + x) / (n - 1)).otherwise(0.0)


def confidence(prob: Column, cover: Column) -> Column:
    """Recogniser probability (one half if there is none) weighted by coverage."""
    return r3(F.least(F.greatest(F.when(prob > 0, prob).otherwise(0.5) * (0.5 + 0.5 * cover), F.lit(0.0)), F.lit(1.0)))


def line_confidence(cover: Column, notes: Column, morae: Column) -> Column:
    """Coverage and notes for each mora, the latter weighing less where nothing is heard; rounded to .01."""
    ratio = F.least(notes / F.greatest(morae, F.lit(1.0)), F.lit(1.0))
    return F.round(F.least(0.6 * cover + 0.4 * ratio, 0.5 + 0.5 * cover), 2)


def word_progress(start: Column, end: Column, syl: Column, t: Column) -> Column:
    """0 before the word, 1 after; within, equal shares per syllable, held in gaps between them."""
    n = F.size(syl)
    done = F.size(F.filter(syl, lambda s: s["end"] <= t))
    now = F.element_at(F.filter(syl, lambda s: (s["start"] <= t) & (t < s["end"])), 1)
    part = F.when(now.isNull(), 0.0).otherwise((t - now["start"]) / (now["end"] - now["start"]))
    whole = F.when(F.coalesce(n, F.lit(0)) > 0, (done + part) / n).otherwise((t - start) / (end - start))
    return F.when(t <= start, 0.0).when(t >= end, 1.0).otherwise(whole)


def line_progress(words: Column, t: Column) -> Column:
    """Characters sung of [(w, start, end, syl)]: each finished word with one blank after it, then the part of the
    first unfinished one."""

    def step(acc: Column, w: Column) -> Column:
        p = word_progress(w["start"], w["end"], w["syl"], t)
        more = F.when(p >= 1, F.length(w["w"]) + 1).otherwise(p * F.length(w["w"]))
        return F.when(acc["open"], F.struct((acc["chars"] + more).alias("chars"), (p >= 1).alias("open"))).otherwise(acc)

    return F.aggregate(words, F.struct(F.lit(0.0).alias("chars"), F.lit(True).alias("open")), step, lambda acc: acc["chars"])
