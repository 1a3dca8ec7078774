"""Regularly sampled tracks: (track keys..., f INT, x DOUBLE), one row per frame.

Every operator takes the key columns and partitions by them; frames of one track are one ordered sequence. Where a
window needs a running state beyond SQL's frames, the track is folded as an ordered array (short tracks) or block by
block in an Arrow worker (long ones); see operators.folds.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def n_frames(n: Column, sample_rate: float, fps: float) -> Column:
    """Frames of n samples, halves to the even number."""
    return F.bround(n / F.lit(sample_rate) * F.lit(fps), 0).cast("long")


def resample(events: DataFrame, keys: list[str], t: str, value: Column, step: float, frames: int) -> DataFrame:
    """Irregular events -> sums per frame of `step` seconds, empty frames 0. Keys with any event get all frames."""
    spine = events.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("f"))
    sums = events.groupBy(*keys, F.floor(F.col(t) / F.lit(step)).cast("int").alias("f")).agg(F.sum(value).alias("x"))
    return spine.join(sums, [*keys, "f"], "left").withColumn("x", F.coalesce(F.col("x").cast("double"), F.lit(0.0)))


def frame_rms(samples: DataFrame, keys: list[str], i: str, x: str, win: int, hop: int) -> DataFrame:
    """RMS of `win` samples around every hop-th one: from win/2 before to win/2-1 after, the divisor always win."""
    w = Window.partitionBy(*keys).orderBy(i).rowsBetween(-(win // 2), win // 2 - 1)
    out = samples.withColumn("rms", F.sqrt(F.sum(F.col(x) * F.col(x)).over(w) / win)).filter(F.col(i) % hop == 0)
    return out.select(*keys, (F.col(i) / hop).cast("int").alias("f"), "rms")


def norm01(frames: DataFrame, keys: list[str], x: str = "x", pct: float = 0.99) -> DataFrame:
    """x over its percentile (linear interpolation), cut to 0..1; one small aggregate joined back, no sort of the track."""
    top = frames.groupBy(*keys).agg(F.percentile(x, pct).alias("_top"))
    scaled = F.col(x) / (F.col("_top") + F.lit(EPS))
    return frames.join(top, keys).withColumn("y", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_top")


def median_filter(frames: DataFrame, keys: list[str], order: str, x: str, taps: int, out: str = "med") -> DataFrame:
    """Running median of an odd number of taps; beyond the ends the end values repeat."""
    half, w = taps // 2, Window.partitionBy(*keys)
    ends = frames.withColumn("_lo", F.min(order).over(w)).withColumn("_hi", F.max(order).over(w))
    low = ends.filter(F.col(order) == F.col("_lo")).select(*keys, F.explode(F.sequence(F.col("_lo") - half, F.col("_lo") - 1)).alias(order), x)
    high = ends.filter(F.col(order) == F.col("_hi")).select(*keys, F.explode(F.sequence(F.col("_hi") + 1, F.col("_hi") + half)).alias(order), x)
    real = frames.withColumn("_real", F.lit(True))
    pads = low.unionByName(high).withColumn("_real", F.lit(False))
    around = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    return real.unionByName(pads, allowMissingColumns=True).withColumn(out, F.percentile(x, F.lit(0.5)).over(around)).filter("_real").drop("_real")


def soft_masks(spec: DataFrame, keys: list[str], taps: int = 17, axis: str = "time") -> DataFrame:
    """(keys, f, bin, s) -> mask H^2 / (H^2 + P^2 + eps): H the median along `axis`, P along the other one."""
    time = median_filter(spec, [*keys, "bin"], "f", "s", taps, "_t")
    both = median_filter(time, [*keys, "f"], "bin", "s", taps, "_b")
    h, p = (F.col("_t"), F.col("_b")) if axis == "time" else (F.col("_b"), F.col("_t"))
    return both.withColumn("mask", h * h / (h * h + p * p + F.lit(EPS))).drop("_t", "_b")


def spectral_features(spec: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f, bin, s) -> per frame: presence sqrt(sum s^2), flux (mean rise of log s, first frame 0), flatness."""
    before = Window.partitionBy(*keys, "bin").orderBy("f")
    logs = F.ln(F.col("s") + 1e-10)
    rise = F.greatest(logs - F.lag(logs).over(before), F.lit(0.0))
    x = spec.withColumn("_rise", F.coalesce(rise, F.lit(0.0)))
    return x.groupBy(*keys, "f").agg(
        F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("presence"),
        F.avg("_rise").alias("flux"),
        (F.exp(F.avg(F.ln(F.col("s") + 1e-10))) / (F.avg("s") + 1e-10)).alias("flatness"),
    )


def voice_features(spec: DataFrame, bank: DataFrame, keys: list[str], low: int, high: int, taps: int = 17) -> DataFrame:
    """(keys, f, bin, s) -> (keys, f, presence, strength, flatness): energy of the bins low..high-1 under their harmonic
    mask, the mean rise of the log band energies of all bins, and flatness of the bins low..high-1."""
    voice = soft_masks(spec.filter((F.col("bin") >= low) & (F.col("bin") < high)), keys, taps)
    harmonic = F.col("s") * F.col("mask")
    voice = voice.groupBy(*keys, "f").agg(F.sqrt(F.sum(harmonic * harmonic)).alias("presence"), (F.exp(F.avg(F.ln(F.col("s") + 1e-10))) / (F.avg("s") + 1e-10)).alias("flatness"))
    logs = F.ln(F.col("e") + 1e-10)
    rise = F.greatest(logs - F.lag(logs).over(Window.partitionBy(*keys, "band").orderBy("f")), F.lit(0.0))
    flux = mel_bands(spec, bank, keys).withColumn("_rise", F.coalesce(rise, F.lit(0.0))).groupBy(*keys, "f").agg(F.avg("_rise").alias("strength"))
    return voice.join(flux, [*keys, "f"]).select(*keys, "f", "presence", "strength", "flatness")


def gate_level(rel: Column) -> Column:
    """A relative level as 0..1: log10(rel) over 0.4 around one half."""
    return F.least(F.greatest(F.log10(rel + F.lit(EPS)) / 0.4 + 0.5, F.lit(0.0)), F.lit(1.0))


def masked(gate: Column, floor: float, strength: Column) -> Column:
    return F.when(gate > floor, strength).otherwise(F.lit(0.0))


def activity(frames: DataFrame, keys: list[str], x: str, levels: list[int], step: float) -> DataFrame:
    """Level in dB re the track's peak -> per level: first and last second above it, and seconds above."""
    peak = Window.partitionBy(*keys)
    db = frames.withColumn("db", 20 * F.log10(F.greatest(F.col(x), F.lit(EPS)) / F.greatest(F.max(x).over(peak), F.lit(EPS))))
    long = db.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]))).filter(F.col("db") > F.col("level"))
    return long.groupBy(*keys, "level").agg((F.min("f") * step).alias("first_s"), (F.max("f") * step).alias("last_s"), (F.count("*") * step).alias("seconds"))


def slide(frames: DataFrame, keys: list[str], k: int, n: int, x: str = "x") -> DataFrame:
    """The track moved k frames later (earlier if k < 0) on a spine of n frames, gaps 0."""
    spine = frames.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("f"))
    moved = frames.select(*keys, (F.col("f") + k).alias("f"), x)
    return spine.join(moved, [*keys, "f"], "left").withColumn(x, F.coalesce(x, F.lit(0.0)))


def dft(frames: DataFrame, keys: list[str], size: int, hop: int, x: str = "x") -> DataFrame:
    """Magnitudes of Hann-windowed blocks of `size` frames as joins with a small basis table: (keys, block, bin, mag)."""
    spark = frames.sparkSession
    basis = spark.range(size // 2 + 1).select(F.col("id").cast("int").alias("bin")).crossJoin(spark.range(size).select(F.col("id").cast("int").alias("j")))
    angle = 2 * F.acos(F.lit(-1.0)) * F.col("bin") * F.col("j") / size
    hann = 0.5 - 0.5 * F.cos(2 * F.acos(F.lit(-1.0)) * F.col("j") / (size - 1))
    basis = F.broadcast(basis.select("bin", "j", (hann * F.cos(angle)).alias("c"), (hann * F.sin(angle)).alias("s")))
    # a frame lies in size / hop blocks
    first = F.greatest(F.ceil((F.col("f") - (size - 1)) / hop), F.lit(0))
    placed = frames.withColumn("block", F.explode(F.sequence(first.cast("int"), F.floor(F.col("f") / hop).cast("int"))))
    placed = placed.withColumn("j", F.col("f") - F.col("block") * hop)
    out = placed.join(basis, "j").groupBy(*keys, "block", "bin")
    out = out.agg(F.sum(F.col(x) * F.col("c")).alias("re"), F.sum(F.col(x) * F.col("s")).alias("im"), F.count("*").alias("n")).filter(F.col("n") == size)
    return out.select(*keys, "block", "bin", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("mag"))


def hz_to_mel(f: Column) -> Column:
    return 2595 * F.log10(1 + f / 700)


def mel_to_hz(m: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), m / 2595) - 1)


def mel_bank(spark, bands: int, bins: int, bin_hz: float, low: float, high: float) -> DataFrame:
    """(band, bin, w): triangles with equally spaced mel corners, not normalised by area."""
    lo, hi = hz_to_mel(F.lit(low)), hz_to_mel(F.lit(high))

    def corner(k):
        return mel_to_hz(lo + (hi - lo) * k / (bands + 1))

    grid = spark.range(bands).select(F.col("id").cast("int").alias("band")).crossJoin(spark.range(bins).select(F.col("id").cast("int").alias("bin")))
    a, b, c, f = corner(F.col("band")), corner(F.col("band") + 1), corner(F.col("band") + 2), F.col("bin") * F.lit(bin_hz)
    w = F.greatest(F.least((f - a) / (b - a), (c - f) / (c - b)), F.lit(0.0))
    return grid.withColumn("w", w).filter("w > 0")


def mel_bands(spec: DataFrame, bank: DataFrame, keys: list[str]) -> DataFrame:
    return spec.join(F.broadcast(bank), "bin").groupBy(*keys, "f", "band").agg(F.sum(F.col("w") * F.col("s")).alias("e"))
