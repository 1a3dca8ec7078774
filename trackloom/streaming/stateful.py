"""Streaming forms: event-time windows with a watermark, and two sequential gates as keyed state.

The reference's own operators are batch only; these carry the same rules over micro-batches. State per key is a few
numbers, whatever the length of the track.
"""

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_sums(events: DataFrame, keys: list[str], ts: str, value: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Sums and counts per event-time window; rows later than the watermark are left out, as Spark defines it."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = events.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "n")


def sessions(events: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Event-time sessions closed by a gap."""
    w = F.session_window(ts, gap)
    out = events.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def hysteresis_gate(frames: DataFrame, key: str, x: str, on: float, off: float) -> DataFrame:
    """(key, f, active): opens above `on`, stays while above `off`; the state is carried from batch to batch.
    Frames of a key must arrive in order of f from one batch to the next."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active = bool(state.get[0]) if state.exists else False
        rows = pd.concat(list(parts)).sort_values("f")
        out = []
        for v in rows[x]:
            active = v > on or active and v > off
            out.append(active)
        state.update((active,))
        yield pd.DataFrame({key: k[0], "f": rows["f"].to_numpy(), "active": out})

    kind = frames.schema[key].dataType.simpleString()
    return frames.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, f int, active boolean", "active boolean", "append", GroupStateTimeout.NoTimeout)


def follower(frames: DataFrame, key: str, x: str, *, fps: float = 100.0, attack: float = 0.010, release: float = 0.090) -> DataFrame:
    """(key, f, y): the one-pole follower of operators.folds over a stream; the state is the last value. It also
    serves long batch tracks, whose whole array wouldn't fit a row."""
    up, down = math.exp(-1 / (attack * fps)), math.exp(-1 / (release * fps))

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y = float(state.get[0]) if state.exists else 0.0
        rows = pd.concat(list(parts)).sort_values("f")
        out = []
        for v in rows[x]:
            a = up if v > y else down
            y = a * y + (1 - a) * v
            out.append(y)
        state.update((y,))
        yield pd.DataFrame({key: k[0], "f": rows["f"].to_numpy(), "y": out})

    kind = frames.schema[key].dataType.simpleString()
    return frames.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, f int, y double", "y double", "append", GroupStateTimeout.NoTimeout)
