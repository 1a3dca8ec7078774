"""A training corpus from the documents table: quality, near-duplicates, decontamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
docs of the next one. All but the last return the columns of documents, whatever further ones there are.

Null and empty texts are documents like any other: the classifier draws them by their chance, they are nobody's copy,
hold no benchmark words, take no words of the mixture (so it leaves them as drawn by its sums) and 16 bytes of a shard.
Null ids and sources are values of their own. Repeated rows (one id, one text) are one document after the second stage.
Empty tables give empty results: without labels half of the documents are drawn, without benchmark none is dropped.
"""

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import decontamination, importance, mixing, neardup, sharding
from trackloom.llm.common import fresh_path, remove, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling toward documents labelled as good; those not drawn go."""
    return importance.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return neardup.keep_one(docs, width=5, num=80, den=100, depth=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or all words of a shorter one) go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the systematic sample draws it for its source's target."""
    return mixing.emit(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, 0 to 39, of nearly equal bytes; copies of a text share one."""
    return sharding.shard_rows(docs)


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("decontamination", decontaminate), ("mixture", mix), ("shards", shards)]

#: Resampling and the search for near-duplicates can't be told in SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, every stage written to and read from the shared folder. What a stage has read is
    removed once its own rows are written."""
    docs, read = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if read:
            remove(spark, read)
        read = path
    return docs
