"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source every row has the same expected number of copies, target / size of the source (2 at most).
Rows stand in a fixed order (length class, then a hash), the expected copies are summed along it, one offset
per source is added, and a row is emitted once for each whole number that the running sum crosses. As rows of
like length are neighbours, the words taken stay within about one long row of the target.

The prefix sum never puts a source into one task: rows are ranked inside small cells (source, length class,
hash class), and only the cells' counts, at most classes x 64 for a source, are summed in order.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import all_columns, cut, free

WORDS = r"[^\x20\x09-\x0D]+"
SUB = 64


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(src, source_size) -> with target. Sources by code point, null last, take the weights in turn and share
    `share` times all sizes; a target stops at `most` times its source's size and the excess is dealt out again
    by weight until none is above. That is the level L with sum(min(most * size, L * weight)) = share * total,
    found from prefix sums over the sources in the order of most * size / weight. One row per source: a catalogue."""
    by_name = Window.orderBy(F.col("src").isNull(), F.col("src"))
    by_ratio = Window.orderBy("ratio", F.col("src").isNull(), "src")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("w", weight).withColumn("stop", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("stop") / F.col("w"))
    full = F.coalesce(F.sum("stop").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything).cast("double") * share
    x = x.withColumn("level", (total - full) / open_w).withColumn("rank", F.row_number().over(by_ratio))
    # the first source, in order, that its level doesn't fill, and all after it stay below their stops
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(everything)["level"]
    return x.withColumn("target", F.least("stop", F.coalesce(level, F.lit(float("inf"))) * F.col("w"))).select("src", "source_size", "target")


def copies(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """id, size, source_size, target, n_copies, taken for every row.

    Null ids and sources are values of their own (they sort last); a null or wordless text has size 0 and takes 0
    words; rows with the same id are separate rows; an empty table gives no rows; further columns are not read."""
    return _drawn(docs, id_col, source_col, text_col, weights, share, most, seed).drop("src")


def _drawn(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """What copies() returns, with the source as src."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    hexed = lambda c, a, n: F.conv(F.substring(c, a, n), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"), key.alias("h"))
    rows = rows.select("*", F.floor(F.sqrt(F.col("size").cast("double"))).cast("long").alias("length_class"), (hexed(F.col("h"), 1, 4) % SUB).alias("sub"))
    rows = cut(rows)  # a few numbers for each document: texts are read, and their words counted, once
    cell = Window.partitionBy("src", "length_class", "sub")
    before = Window.partitionBy("src").orderBy("length_class", "sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("src", "length_class", "sub").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    goals = targets(cells.groupBy("src").agg(F.sum("words").alias("source_size")), weights, share, most)
    offset = hexed(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("s"), "src"), F.lit("")))), 1, 12) / F.lit(float(16**12))
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(goals.withColumnRenamed("src", "src2"), F.col("src").eqNullSafe(F.col("src2")))
    cells = cells.select(F.struct("src", "length_class", "sub").alias("cell"), "before", "source_size", "target", offset.alias("offset"))
    ranked = rows.withColumn("r", F.row_number().over(cell.orderBy("size", "h", "doc_id"))).withColumn("cell", F.struct("src", "length_class", "sub"))
    out = ranked.join(cells, "cell")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("before") + F.col("r")
    n = F.floor(F.col("offset") + each * place) - F.floor(F.col("offset") + each * (place - 1))
    # no row crosses more whole numbers than ceil(expected); guards against rounding of large sums
    out = out.withColumn("n_copies", F.least(n, F.ceil(each)).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"), "n_copies", F.col("cell.src").alias("src"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves: each row as often as it was drawn, with the columns of docs, whatever their names.
    Rows that share an id and a size share what was drawn for them, dealt out evenly."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    key, size, n, copy, place = (free(docs, name) for name in ("key", "size", "n", "copy", "place"))
    columns = all_columns(docs)
    # source and length class are functions of the row, so rows with equal (id, size, source) are exchangeable
    source_col = options.get("source_col", "source")
    drawn = _drawn(docs, **options).groupBy("doc_id", "size", "src").agg(F.sum("n_copies").alias("n_copies"), F.count("*").alias("rows"))
    drawn = drawn.select(F.struct("doc_id", "size", "src").alias(key), F.col("n_copies").alias(n), "rows").filter(F.col(n) > 0)
    out = docs.withColumn(size, word_count(F.col(text_col)))
    out = out.withColumn(key, F.struct(F.col(id_col).alias("doc_id"), F.col(size).alias("size"), F.col(source_col).alias("src")))
    drawn, rows = drawn.withColumnRenamed("rows", place), place
    out = out.join(drawn, key)
    single = out.filter(F.col(rows) == 1).withColumn(copy, F.col(n))
    # the rows of one key take floor or ceil of n / rows each, n in all
    several = out.filter(F.col(rows) > 1)
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*[c for c, f in zip(columns, docs.schema, strict=True) if "map<" not in f.dataType.simpleString()])))
    several = several.withColumn(copy, F.floor(k * F.col(n) / F.col(rows)) - F.floor((k - 1) * F.col(n) / F.col(rows)))
    out = single.unionByName(several)
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copy).cast("int")))).select(*columns)


ORACLE = """
WITH r AS (SELECT doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, floor(sqrt(size::DOUBLE))::BIGINT AS lc, ('0x' || substr(h, 1, 4))::BIGINT % 64 AS sub FROM r),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM k GROUP BY src),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS stop FROM s),
x AS (SELECT *, stop / w AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM w),
e AS (SELECT min(a.ratio) AS ratio FROM x a WHERE (SELECT sum(least(b.stop, a.ratio * b.w)) FROM x b) >= a.total),
l AS (SELECT (max(total) - coalesce(sum(stop) FILTER (x.ratio < e.ratio), 0)) / sum(w) FILTER (x.ratio >= e.ratio) AS level FROM x, e),
t AS (SELECT src, source_size, least(stop, coalesce(level, 'inf'::DOUBLE) * w) AS target FROM x, l),
p AS (SELECT k.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS each_row, ('0x' || substr(md5('mix|' || coalesce('s' || k.src, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u,
  row_number() OVER (PARTITION BY k.src ORDER BY lc, sub, size, h, doc_id) AS place FROM k JOIN t ON k.src IS NOT DISTINCT FROM t.src)
SELECT doc_id, size::BIGINT AS size, source_size, target, (least(floor(u + each_row * place) - floor(u + each_row * (place - 1)), ceil(each_row)) * size)::BIGINT AS taken,
  least(floor(u + each_row * place) - floor(u + each_row * (place - 1)), ceil(each_row))::BIGINT AS n_copies FROM p
"""
