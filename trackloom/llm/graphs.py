"""Connected components of an edge table. Up to SMALL_EDGES edges are joined up by one executor task, which holds one
entry for each vertex; more by alternating large-star and small-star steps, in which only aggregates meet at a vertex
(a minimum), never its list of neighbours. Nothing of the graph is collected to the driver."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import cut, lean

SMALL_EDGES = 300_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    rest = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest).distinct()


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges -> (node, root) by union-find, the smallest vertex as root."""
    root: dict = {}
    kind = None

    def find(v):
        while (up := root.setdefault(v, v)) != v:
            root[v] = root[up]
            v = up
        return v

    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    moved = [(v, r) for v in list(root) if (r := find(v)) != v]
    for at in range(0, len(moved), 50_000):
        node, to = zip(*moved[at : at + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(node, kind), pa.array(to, kind)], ["node", "root"])


def components(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """edges (u, v) of any ordered type -> (node, root) for every vertex that is not its component's smallest."""
    now = cut(edges.select("u", "v").filter("u <> v").distinct())
    if now.count() <= small:
        kind = now.schema["u"].dataType.simpleString()
        return cut(now.coalesce(1).mapInArrow(lean(_one_task), f"node {kind}, root {kind}"))
    mark = None
    while True:
        # a step over a star leaves it as it is, so equal sums of hashes mean that only stars are left
        now = cut(_small_star(_large_star(now)))
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or new[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = new
