"""Text and JSON sources and sinks: lines, syllable readings, grids, timed documents, raw samples."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])
WORD = T.StructType([T.StructField("w", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("conf", T.DoubleType()), T.StructField("syl", T.ArrayType(SPAN))])
LINE = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("words", T.ArrayType(WORD))])
DOCUMENT = T.StructType([T.StructField("lines", T.ArrayType(LINE)), T.StructField("extras", T.ArrayType(T.StringType())), T.StructField("notes", T.StringType()), T.StructField("source", T.StringType()), T.StructField("method", T.MapType(T.StringType(), T.StringType()))])


def read_lines(spark: SparkSession, path: str, trim: bool = True) -> DataFrame:
    """(file, i, text): the non-blank lines of text files in order, right ends trimmed if asked; whole files, so the
    order is the file's."""
    x = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "text"))
    x = x.withColumn("text", F.rtrim(F.regexp_replace("text", r"\s+$", "")) if trim else F.regexp_replace("text", "\r$", "")).filter(F.trim("text") != "")
    dense = F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1
    return x.select("file", dense.cast("int").alias("i"), "text")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Timed documents; a syllable may be {start, end} or [start, end], one shape in a file."""
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in DOCUMENT.fields if f.name != "lines"] + [T.StructField("lines", T.StringType())])
    raw = spark.read.json(path, schema=loose, multiLine=True).withColumn("file", F.input_file_name())
    # [a, b] -> {"start": a, "end": b}
    lines = F.regexp_replace("lines", r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)\s*\]", '{"start":$1,"end":$2}')
    return raw.withColumn("lines", F.from_json(lines, T.ArrayType(LINE)))


def write_documents(docs: DataFrame, path: str, keep_nulls: bool = False) -> None:
    """One JSON object per row; absent fields are left out unless their nulls are meant."""
    docs.select(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": str(not keep_nulls).lower()}).alias("value")).write.text(path)


def write_features(features: DataFrame, path: str, by: str = "track") -> None:
    """Named tracks as Parquet, a folder for each name, so that a reader opens only those it asks for."""
    features.write.partitionBy(by).parquet(path)


def read_features(spark: SparkSession, path: str, names: list[str] | None = None, columns: list[str] | None = None, by: str = "track") -> DataFrame:
    """What write_features() wrote: the named tracks (all by default) and only the columns asked for."""
    x = spark.read.parquet(path)
    x = x if names is None else x.filter(F.col(by).isin(names))
    return x if columns is None else x.select(by, *columns)


def reading_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, tokens): the non-blank lines of a reading, their tokens between white space, none empty."""
    return read_lines(spark, path).select("file", "i", F.filter(F.split(F.trim("text"), r"\s+"), lambda t: t != "").alias("tokens"))


MAP = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("words", T.ArrayType(T.StructType([T.StructField("w", T.StringType()), T.StructField("syl", T.ArrayType(T.StringType()))])))]))


def load_map(spark: SparkSession, path: str | None, rebuilt: DataFrame) -> DataFrame:
    """(i, text, words, tokens) of a syllable map: the file at path if it is there and fits, else `rebuilt`, the map made
    from the lines and readings. A file fits if it has the same lines, words and sung tokens; one that doesn't raises."""
    from trackloom.operators.checks import check_map

    if path is None:
        return rebuilt
    lines = spark.read.json(path, schema=T.StructType([T.StructField("lines", MAP)]), multiLine=True).select(F.inline("lines"))
    found = lines.select("i", "text", F.col("words.w").alias("words"), F.flatten("words.syl").alias("tokens"), F.col("words").alias("map"))
    wrong = check_map(found.drop("map"), rebuilt, ["i"]).orderBy("i").take(3)
    if wrong:
        raise ValueError(f"the map doesn't fit: {', '.join(f'line {r.i}: {r.rule}' for r in wrong)}")
    return found


def read_samples(spark: SparkSession, path: str, channels: int = 2) -> DataFrame:
    """(file, i, x): raw little-endian float32 files, channels averaged."""

    def run(batches):
        for part in batches:
            for name, content in zip(part["path"], part["content"], strict=True):
                x = np.frombuffer(content, "<f4")
                x = x[: len(x) // channels * channels].reshape(-1, channels).mean(1)
                for at in range(0, len(x), 100_000):
                    yield pd.DataFrame({"file": name, "i": np.arange(at, at + len(x[at : at + 100_000])), "x": x[at : at + 100_000].astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, i long, x double")


@dataclass(frozen=True)
class GridSpec:
    """A beat grid; tempo sets the period and the period the tempo, the period wins, the phase stands alone."""

    bpm: float
    period: float
    phase: float

    def override(self, bpm: float | None = None, period: float | None = None, phase: float | None = None) -> "GridSpec":
        if period is None and bpm is not None:
            period = 60.0 / bpm
        period = self.period if period is None else period
        return GridSpec(60.0 / period, period, self.phase if phase is None else phase)
