"""The registered queries over the operators of this folder, with their DuckDB SQL where SQL can express them."""

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import decontamination, html_text, importance, lm_scoring, media, mixing, neardup, sharding, toxicity, warc
from trackloom.llm.common import table


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_lexicon_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bfd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100, depth=4)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents"))


def op7_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.load(media.store(table(spark, sf_dir, "documents")))


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (op1_importance_resampling, op2_block_rules, op3_lexicon_automata, op4_bfd_sharding, op5_lsh_forest, op6_source_mixing, op7_lossless_webp, op8_arc_to_warc, op9_decontamination, op10_bloom_lm, pipeline)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict:
    return {"op6_source_mixing": mixing.ORACLE, "op8_arc_to_warc": warc.ORACLE, "op9_decontamination": decontamination.ORACLE}
