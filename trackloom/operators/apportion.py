"""Apportionment and ordered expansion of weights."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest_remainder(rows: DataFrame, keys: list[str], order: str, weight: str, total: Column, out: str = "n") -> DataFrame:
    """Whole shares of `total` (constant per key) in proportion to weights: one each first if the total reaches, then
    floors, then the largest remainders (earlier rows first). All weights 0 count as equal; nothing of a total <= 0."""
    w = Window.partitionBy(*keys)
    x = rows.withColumn("_t", total.cast("long")).withColumn("_n", F.count("*").over(w)).withColumn("_s", F.sum(weight).over(w))
    share = F.when(F.col("_s") > 0, F.col(weight) / F.col("_s")).otherwise(F.lit(1.0) / F.col("_n"))
    x = x.withColumn("_base", F.when(F.col("_t") >= F.col("_n"), 1).otherwise(0)).withColumn("_left", F.col("_t") - F.col("_base") * F.col("_n"))
    x = x.withColumn("_q", share * F.col("_left")).withColumn("_f", F.floor("_q"))
    x = x.withColumn("_rest", F.col("_left") - F.sum("_f").over(w))
    rank = F.row_number().over(w.orderBy(F.desc(F.round(F.col("_q") - F.col("_f"), 9)), order))
    extra = F.when(rank <= F.col("_rest"), 1).otherwise(0)
    n = F.when(F.col("_t") <= 0, 0).otherwise(F.col("_base") + F.col("_f") + extra)
    return x.withColumn(out, n.cast("long")).drop("_t", "_n", "_s", "_base", "_left", "_q", "_f", "_rest")


def prefix_sum(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(value).over(w))


def slots(units: DataFrame, morae: str) -> DataFrame:
    """Each row once per mora, with its place k."""
    return units.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.col(morae), F.lit(1))))).withColumn("k", F.col("k") - 1)


def flatten_units(units: DataFrame, cls: str, morae: str) -> DataFrame:
    """Latin units of several morae as that many of one; others one row of at least one whole mora."""
    n = F.greatest(F.bround(F.col(morae), 0).cast("int"), F.lit(1))
    many = (F.col(cls) == "latin") & (n > 1)
    x = units.withColumn("_times", F.when(many, n).otherwise(1)).withColumn("flat_morae", F.when(many, 1).otherwise(n))
    return x.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_times") - 1))).drop("_times")
