"""Runs, islands, peaks and periods of framed tracks, as window functions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.intervals import next_of


def islands(rows: DataFrame, keys: list[str], order: str, flag: Column, name: str = "island") -> DataFrame:
    """The rows where flag holds, numbered by maximal stretches of consecutive order values."""
    w = Window.partitionBy(*keys).orderBy(order)
    kept = rows.filter(flag).withColumn("_new", F.when(F.col(order) - F.lag(order).over(w) == 1, 0).otherwise(1))
    return kept.withColumn(name, F.sum("_new").over(w)).drop("_new")


def hysteresis(frames: DataFrame, keys: list[str], x: str, on: float, off: float) -> DataFrame:
    """frames with a column active: opens above `on`, stays while above `off`."""
    w = Window.partitionBy(*keys).orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(F.col(x) > on, 1).when(F.col(x) <= off, 0), ignorenulls=True).over(w)
    return frames.withColumn("active", F.coalesce(state, F.lit(0)) == 1)


def phrase_runs(frames: DataFrame, keys: list[str], x: str = "x", *, fps: float = 100.0, on: float = 0.18, off: float = 0.10, min_run: float = 0.15, merge: float = 0.15) -> DataFrame:
    """(keys, run_id, start, end, mean, peak): hysteresis runs, those less than `merge` seconds apart joined, shorter
    ones than `min_run` dropped; mean and peak cover joined gaps too."""
    runs = islands(hysteresis(frames, keys, x, on, off), keys, "f", F.col("active"))
    runs = runs.groupBy(*keys, "island").agg(F.min("f").alias("a"), F.max("f").alias("b"))
    w = Window.partitionBy(*keys).orderBy("a")
    apart = (F.col("a") - F.lag("b").over(w)) / F.lit(fps)
    runs = runs.withColumn("g", F.sum(F.when(apart < merge, 0).otherwise(1)).over(w)).groupBy(*keys, "g").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    runs = runs.filter((F.col("b") - F.col("a") + 1) / F.lit(fps) >= min_run).withColumn("run_id", (F.row_number().over(Window.partitionBy(*keys).orderBy("a")) - 1).cast("int"))
    # a run's first frame brings it along; the frames after it see the last one brought
    brought = frames.join(runs.select(*keys, F.col("a").alias("f"), F.struct("run_id", "a", "b").alias("_run")), [*keys, "f"], "left")
    seen = F.last("_run", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("f").rowsBetween(Window.unboundedPreceding, 0))
    inside = brought.withColumn("_run", seen).filter(F.col("f") <= F.col("_run.b")).select("*", "_run.*")
    out = inside.groupBy(*keys, "run_id", "a", "b").agg(F.avg(x).alias("mean"), F.max(x).alias("peak"))
    return out.select(*keys, "run_id", (F.col("a") / fps).alias("start"), ((F.col("b") + 1) / fps).alias("end"), "mean", "peak")


def active_runs(frames: DataFrame, keys: list[str], x: str, threshold: float, *, fps: float = 100.0, min_s: float = 0.08) -> DataFrame:
    """(keys, start, end) of stretches above one threshold, at least min_s long, nothing joined."""
    runs = islands(frames, keys, "f", F.col(x) > threshold).groupBy(*keys, "island").agg(F.min("f").alias("a"), F.max("f").alias("b"))
    return runs.filter((F.col("b") - F.col("a") + 1) / F.lit(fps) >= min_s).select(*keys, (F.col("a") / fps).alias("start"), ((F.col("b") + 1) / fps).alias("end"))


def local_peaks(frames: DataFrame, keys: list[str], x: str, height: float) -> DataFrame:
    """(keys, f, x) of strict local maxima of at least `height`; of a plateau the middle (the lower of two), never at an edge."""
    w = Window.partitionBy(*keys).orderBy("f")
    flat = frames.withColumn("_g", F.sum(F.when(F.col(x) == F.lag(x).over(w), 0).otherwise(1)).over(w))
    flat = flat.groupBy(*keys, "_g").agg(F.min("f").alias("a"), F.max("f").alias("b"), F.first(x).alias(x))
    v = Window.partitionBy(*keys).orderBy("_g")
    top = (F.col(x) > F.lag(x).over(v)) & (F.col(x) > F.lead(x).over(v))
    return flat.withColumn("_top", top).filter(F.col("_top") & (F.col(x) >= height)).select(*keys, F.floor((F.col("a") + F.col("b")) / 2).cast("int").alias("f"), x)


def quiet_from(points: DataFrame, frames: DataFrame, keys: list[str], x: str, *, fps: float = 100.0, threshold: float = 0.05, gap: float = 0.12) -> DataFrame:
    """points (keys, id, t) with t_end: where, from frame rint(t * fps) on, the first stretch at or below the threshold
    starts that lasts `gap` seconds; a stretch under way counts from t only; null if there is none."""
    quiet = islands(frames, keys, "f", F.col(x) <= threshold).groupBy(*keys, "island").agg(F.min("f").alias("qs"), (F.max("f") + 1).alias("qe"))
    long = quiet.withColumn("_long", F.col("qe") - F.col("qs") >= F.lit(gap * fps)).filter("_long").select(*keys, "qs", "qe")
    at = points.withColumn("_f", F.rint(F.col("t") * fps))
    # stretches are apart: one that ends after the point is under way or still to come
    x = next_of(next_of(at, long, keys, "_f", "qe", "_now", strict=True), long, keys, "_f", "qs", "_next", strict=True)
    here = (F.col("_now.qs") <= F.col("_f")) & (F.col("_now.qe") - F.col("_f") >= F.lit(gap * fps))
    return x.withColumn("t_end", F.when(here, F.col("_f")).otherwise(F.col("_next.qs")) / fps).drop("_f", "_now", "_next")


def gaps_within(units: DataFrame, line: list[str], order: str, gap: float) -> DataFrame:
    """(line..., gap_start, gap_end) between neighbours of one line that are at least `gap` seconds apart."""
    w = Window.partitionBy(*line).orderBy(order)
    nxt = units.withColumn("gap_end", F.lead("start").over(w)).filter(F.col("gap_end") - F.col("end") >= gap)
    return nxt.select(*line, F.col("end").alias("gap_start"), "gap_end")


def autocorrelation(frames: DataFrame, keys: list[str], x: str, lo: int, hi: int) -> DataFrame:
    """(keys, lag, ac) for lo <= lag < hi: demeaned products over their sum at lag 0, an equi-join on f + lag."""
    mean = frames.groupBy(*keys).agg(F.avg(x).alias("_m"))
    d = frames.join(mean, keys).select(*keys, "f", (F.col(x) - F.col("_m")).alias("d"))
    zero = d.groupBy(*keys).agg(F.sum(F.col("d") * F.col("d")).alias("z"))
    left = d.withColumn("lag", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))).select(*keys, "lag", (F.col("f") + F.col("lag")).alias("f"), F.col("d").alias("d0"))
    ac = left.join(d, [*keys, "f"]).groupBy(*keys, "lag").agg(F.sum(F.col("d0") * F.col("d")).alias("s"))
    return ac.join(zero, keys).select(*keys, "lag", (F.col("s") / F.col("z")).alias("ac"))


def period(ac: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lag, ac_peak, refined): the best lag (first of equals) and its parabolic refinement between neighbours."""
    w = Window.partitionBy(*keys).orderBy("lag")
    x = ac.withColumn("p", F.lag("ac").over(w)).withColumn("q", F.lead("ac").over(w))
    best = x.groupBy(*keys).agg(F.max_by(F.struct("lag", "ac", "p", "q"), F.struct("ac", -F.col("lag"))).alias("b")).select(*keys, "b.*")
    bend = F.col("p") - 2 * F.col("ac") + F.col("q")
    shift = F.when(bend != 0, 0.5 * (F.col("p") - F.col("q")) / bend).otherwise(0.0)
    return best.select(*keys, "lag", F.col("ac").alias("ac_peak"), (F.col("lag") + F.coalesce(shift, F.lit(0.0))).alias("refined"))


def phase(frames: DataFrame, periods: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, offset, score): the whole-frame offset below the period with the largest sum at rint(offset + m * period);
    the first of equals; positions beyond the track don't count."""
    last = frames.groupBy(*keys).agg(F.max("f").alias("_last"))
    grid = periods.join(last, keys).withColumn("offset", F.explode(F.sequence(F.lit(0), F.ceil("period").cast("int") - 1)))
    grid = grid.withColumn("m", F.explode(F.sequence(F.lit(0), F.floor((F.col("_last") - F.col("offset")) / F.col("period")).cast("int"))))
    at = grid.withColumn("f", F.rint(F.col("offset") + F.col("m") * F.col("period")).cast("int"))
    score = at.join(frames, [*keys, "f"]).groupBy(*keys, "offset").agg(F.sum(x).alias("score"))
    return score.groupBy(*keys).agg(F.max_by(F.struct("offset", "score"), F.struct("score", -F.col("offset"))).alias("b")).select(*keys, "b.*")


def beats(grid: DataFrame, keys: list[str], duration: float) -> DataFrame:
    """(keys, k, t) from columns phase and period: every multiple before `duration`."""
    n = F.greatest(F.ceil((F.lit(duration) - F.col("phase")) / F.col("period")).cast("int"), F.lit(0))
    out = grid.withColumn("k", F.explode(F.slice(F.sequence(F.lit(0), n), F.lit(1), n)))
    return out.select(*keys, "k", (F.col("phase") + F.col("k") * F.col("period")).alias("t"))
