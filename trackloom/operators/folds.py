"""Ordered folds: operators whose next value depends on the last result, which window frames can't say."""

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def follower(frames: DataFrame, keys: list[str], x: str = "x", *, fps: float = 100.0, attack: float = 0.010, release: float = 0.090) -> DataFrame:
    """(keys, f, y): a one-pole follower with y0 = 0 whose coefficient is that of the attack while x is above y. Linear
    in the frames of a track, which one Arrow group holds; longer tracks go through streaming.stateful."""
    up, down = math.exp(-1 / (attack * fps)), math.exp(-1 / (release * fps))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("f")
        y, out = 0.0, []
        for v in part.column(x).to_pylist():
            a = up if v > y else down
            y = a * y + (1 - a) * v
            out.append(y)
        return part.select([*keys, "f"]).append_column("y", pa.array(out, pa.float64()))

    schema = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in [*keys, "f"]) + ", y double"
    return frames.select(*keys, "f", F.col(x).cast("double").alias(x)).groupBy(*keys).applyInArrow(run, schema)
