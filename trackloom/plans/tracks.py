"""Test tracks made from the shared tables, and the same as DuckDB SQL to start an oracle with."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import frames as fr
from trackloom.sources.tables import events, table

HOURS = 720


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, f, x): event values per event type and hour of January 2024, summed in whole cents."""
    cents = F.round(F.col("value") * 100).cast("long")
    out = fr.resample(events(spark, sf_dir).withColumnRenamed("event_type", "track"), ["track"], "t", cents, 3600.0, HOURS)
    return out.withColumn("x", F.col("x") / 100)


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hourly with y, x normalised by its 99th percentile and rounded to 6 digits."""
    return fr.norm01(hourly(spark, sf_dir), ["track"]).withColumn("y", F.round("y", 6))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, f, bin, s): embeddings as magnitudes, label as track, order of vec_id as frame."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings")
    e = e.withColumn("f", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("int"))
    return e.select(F.col("label").alias("track"), "f", F.posexplode("embedding").alias("bin", "v")).select("track", "f", "bin", F.abs(F.col("v").cast("double")).alias("s"))


EV = "ev AS (SELECT event_id, user_id, event_type AS track, value, (epoch_us(ts)::DOUBLE / 1000000.0::DOUBLE) - 1704067200.0::DOUBLE AS t FROM events)"
FR = EV + """,
fr AS (SELECT s.track, s.f::INT AS f, coalesce(sum(round(value * 100)::BIGINT), 0)::DOUBLE / 100 AS x
  FROM (SELECT track, f FROM (SELECT DISTINCT track FROM ev), range(720) r(f)) s LEFT JOIN ev ON ev.track = s.track AND floor(ev.t / 3600)::INT = s.f GROUP BY s.track, s.f)"""
NR = FR + """,
nr AS (SELECT track, f, x, round(least(greatest(x / (quantile_cont(x, 0.99) OVER (PARTITION BY track) + 1e-12::DOUBLE), 0), 1), 6) AS y FROM fr)"""
SP = """sp AS (SELECT label AS track, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS f, embedding FROM embeddings),
sx AS (SELECT track, f, unnest(range(64))::INT AS bin, abs(unnest(embedding)::DOUBLE) AS s FROM sp)"""
#: Frames of hysteresis state, runs and joined runs of nr.y with on .35, off .2, one frame an hour.
RUNS = NR + """,
st AS (SELECT *, coalesce(last_value(CASE WHEN y > 0.35 THEN 1 WHEN y <= 0.2 THEN 0 END IGNORE NULLS) OVER (PARTITION BY track ORDER BY f ROWS UNBOUNDED PRECEDING), 0) AS a FROM nr),
i1 AS (SELECT track, f, f - row_number() OVER (PARTITION BY track ORDER BY f) AS g FROM st WHERE a = 1),
r1 AS (SELECT track, min(f) AS a, max(f) AS b FROM i1 GROUP BY track, g),
r2 AS (SELECT *, sum(CASE WHEN a - pb < 2 THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY a) AS g FROM (SELECT *, lag(b) OVER (PARTITION BY track ORDER BY a) AS pb FROM r1)),
r3 AS (SELECT track, min(a) AS a, max(b) AS b FROM r2 GROUP BY track, g HAVING max(b) - min(a) + 1 >= 2),
runs AS (SELECT r3.track, (row_number() OVER (PARTITION BY r3.track ORDER BY r3.a) - 1)::INT AS run_id, r3.a::DOUBLE AS "start", (r3.b + 1)::DOUBLE AS "end", r3.a AS a, r3.b AS b FROM r3)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hysteresis runs of normal(), times in hours."""
    from trackloom.operators.gating import phrase_runs

    return phrase_runs(normal(spark, sf_dir), ["track"], "y", fps=1.0, on=0.35, off=0.2, min_run=2.0, merge=2.0)
