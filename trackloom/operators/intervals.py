"""Joins on a time line: nearest as-of, overlap, stabbing, coverage; and repairs of ordered bounds.

Interval joins never loop over pairs of a track: both sides are cut into cells of `width` seconds, joined on
(keys, cell), and the exact condition is checked in the first cell that both share, so a pair comes out once. A long
interval costs a row for each cell it covers; choose the width near the intervals' length.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cells(df: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    return df.withColumn("_cell", F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long"))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: float, how: str = "inner") -> DataFrame:
    """Rows of left (s, e) and right (rs, re) that overlap: s < re and rs < e. Right's keys must have the same names."""
    a = _cells(left.filter("s < e"), F.col("s"), F.col("e"), width)
    b = _cells(right.filter("rs < re"), F.col("rs"), F.col("re"), width)
    first = F.floor(F.greatest("s", "rs") / width) == F.col("_cell")
    return a.join(b, [*keys, "_cell"]).filter((F.col("s") < F.col("re")) & (F.col("rs") < F.col("e")) & first).drop("_cell")


def coverage(spans: DataFrame, runs: DataFrame, keys: list[str], span_id: str, width: float) -> DataFrame:
    """spans (keys, span_id, s, e) with coverage: the share of the span that runs (keys, rs, re) cover, 1 at most, 0
    if the span is empty."""
    hit = overlap_join(spans.select(*keys, span_id, "s", "e"), runs.select(*keys, "rs", "re"), keys, width)
    part = hit.groupBy(*keys, span_id).agg(F.sum(F.least("e", "re") - F.greatest("s", "rs")).alias("_c"))
    share = F.least(F.coalesce("_c", F.lit(0.0)) / (F.col("e") - F.col("s")), F.lit(1.0))
    return spans.join(part, [*keys, span_id], "left").withColumn("coverage", F.when(F.col("e") <= F.col("s"), 0.0).otherwise(share)).drop("_c")


def points_in(spans: DataFrame, points: DataFrame, keys: list[str], width: float, closed: bool = False) -> DataFrame:
    """Rows of spans (s, e) and points (t) with s <= t < e (t <= e if closed)."""
    a = _cells(spans, F.col("s"), F.col("e"), width)
    b = points.withColumn("_cell", F.floor(F.col("t") / width).cast("long"))
    inside = (F.col("t") >= F.col("s")) & ((F.col("t") <= F.col("e")) if closed else (F.col("t") < F.col("e")))
    return a.join(b, [*keys, "_cell"]).filter(inside).drop("_cell")


def stab_first(points: DataFrame, spans: DataFrame, keys: list[str], point_id: list[str], order: list[str], width: float) -> DataFrame:
    """For each point the first span (by order) that holds it, s <= t < e."""
    hit = points_in(spans, points, keys, width)
    w = Window.partitionBy(*keys, *point_id).orderBy(*order)
    return hit.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def nearest(points: DataFrame, marks: DataFrame, keys: list[str], point_id: str, tolerance: float) -> DataFrame:
    """points (keys, point_id, t) with mark (the nearest m, the earlier of two as near) and found (within tolerance);
    bounds lo, hi of the points, where they have them, must be more than 0.02 away from it. One sort per key."""
    both = points.withColumn("m", F.lit(None).cast("double")).withColumn("_o", F.lit(1))
    both = both.unionByName(marks.select(*keys, F.col("m").alias("t"), F.col("m"), F.lit(0).alias("_o")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("t", "_o")
    # a mark at t itself comes before the point, and is the nearest
    before = F.last("m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # the same from the other end: a frame that ends at the last row would be read again for each row
    back = Window.partitionBy(*keys).orderBy(F.desc("t"), F.desc("_o"))
    after = F.last("m", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    x = both.withColumn("_b", before).withColumn("_a", after).filter("_o = 1")
    best = F.when(F.col("_a").isNull() | (F.col("t") - F.col("_b") <= F.col("_a") - F.col("t")), F.col("_b")).otherwise(F.col("_a"))
    x = x.withColumn("mark", best)
    ok = F.abs(F.col("mark") - F.col("t")) <= tolerance
    if {"lo", "hi"} <= set(points.columns):
        ok = ok & (F.col("mark") > F.col("lo") + 0.02) & (F.col("mark") < F.col("hi") - 0.02)
    return x.withColumn("found", F.coalesce(ok, F.lit(False))).withColumn("mark", F.when(F.col("found"), F.col("mark")).otherwise(F.col("t"))).drop("_b", "_a", "_o", "m")


def snap_to_gaps(bounds: DataFrame, runs: DataFrame, keys: list[str], bound_id: str, tolerance: float, floor: Column | None = None) -> DataFrame:
    """bounds (keys, bound_id, b) moved to the middle of the nearest gap between runs (keys, rs, re) if it is within
    tolerance (and not below floor); tracks of one run have no gap and keep their bounds."""
    w = Window.partitionBy(*keys).orderBy("rs")
    gaps = runs.withColumn("_next", F.lead("rs").over(w)).filter(F.col("_next") > F.col("re")).select(*keys, ((F.col("re") + F.col("_next")) / 2).alias("m"))
    near = nearest(bounds.withColumn("t", F.col("b")), gaps, keys, bound_id, tolerance).drop("t")
    snapped = F.col("mark") if floor is None else F.greatest(F.col("mark"), floor)
    return near.withColumn("snapped", snapped).drop("mark")


def clip(runs: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """runs (rs, re) cut to lo..hi, what is left positive."""
    return runs.withColumn("rs", F.greatest("rs", lo)).withColumn("re", F.least("re", hi)).filter("rs < re")


def min_gap(rows: DataFrame, keys: list[str], order: str, b: str, m: float) -> DataFrame:
    """Each bound at least m after the one before: b[i] = max(b[i], b[i-1] + m), in closed form."""
    w = Window.partitionBy(*keys).orderBy(order)
    i = F.row_number().over(w)
    x = rows.withColumn("_i", i)
    top = F.max(F.col(b) - F.col("_i") * m).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("repaired", top + F.col("_i") * m).drop("_i")


def forward_fill(rows: DataFrame, keys: list[str], order: str, value: str, seed: str) -> DataFrame:
    """value where it is known, else the last known before, else the seed; filled marks what was missing."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("filled", F.col(value).isNull()).withColumn("value", F.coalesce(F.last(value, ignorenulls=True).over(w), F.col(seed)))


def neighbours(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """rows with before and after: the nearest known value on either side."""
    known, w = F.last(value, ignorenulls=True), Window.partitionBy(*keys)
    side = lambda *by: known.over(w.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", side(F.asc(order))).withColumn("after", side(F.desc(order)))


def next_of(points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark_at: str, out: str, *, strict: bool = False) -> DataFrame:
    """points with a struct `out`: of marks (keys, mark_at, ...) the first at or after each point, strictly after it if
    strict; null if there is none. One sort for each key."""
    others = [c for c in marks.columns if c not in keys]
    m = marks.select(*keys, F.col(mark_at).cast("double").alias("_at"), F.lit(0 if strict else 1).alias("_k"), F.struct(*others).alias(out))
    p = points.withColumn("_at", F.col(at).cast("double")).withColumn("_k", F.lit(1 if strict else 0)).withColumn("_p", F.lit(True))
    back = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)
    both = p.withColumn(out, F.lit(None).cast(m.schema[out].dataType)).unionByName(m, allowMissingColumns=True)
    return both.withColumn(out, F.last(out, ignorenulls=True).over(back)).filter("_p").drop("_at", "_k", "_p")


def line_spans(units: DataFrame, keys: list[str], tail: float) -> DataFrame:
    """(keys, line, start, end, last): from units (line, u, t): first unit's start, the start of the next line's first
    unit (for the last line its last unit plus tail), and the last unit's start."""
    per = units.groupBy(*keys, "line").agg(F.min_by("t", "u").alias("start"), F.max_by("t", "u").alias("last"), F.min("u").alias("_u"))
    w = Window.partitionBy(*keys).orderBy("_u")
    return per.withColumn("end", F.coalesce(F.lead("start").over(w), F.col("last") + tail)).drop("_u")


def share_notes(units: DataFrame, keys: list[str], order: str, t: str, end: str, tie: float = 1e-9, least: float = 0.001) -> DataFrame:
    """Units of one start (within tie) divide the room up to the next start (or `end`) evenly; with less room than
    `least` for each, all keep the whole."""
    w = Window.partitionBy(*keys).orderBy(order)
    g = units.withColumn("_g", F.sum(F.when(F.col(t) - F.lag(t).over(w) <= tie, 0).otherwise(1)).over(w))
    per = g.groupBy(*keys, "_g").agg(F.min(t).alias("_t"), F.max(end).alias("_end"), F.count("*").alias("_n"))
    per = per.withColumn("_stop", F.coalesce(F.lead("_t").over(Window.partitionBy(*keys).orderBy("_g")), F.col("_end")))
    x = g.join(per, [*keys, "_g"]).withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_g").orderBy(order)) - 1)
    room = F.col("_stop") - F.col("_t")
    tight = room < F.lit(least) * F.col("_n")
    start = F.when(tight, F.col("_t")).otherwise(F.col("_t") + room * F.col("_k") / F.col("_n"))
    stop = F.when(tight, F.col("_stop")).otherwise(F.col("_t") + room * (F.col("_k") + 1) / F.col("_n"))
    return x.withColumn("start", start).withColumn("stop", stop).drop("_g", "_t", "_end", "_n", "_stop", "_k")
