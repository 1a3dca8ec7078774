"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

Every item is cut into windows of `n` consecutive words (an item of fewer words is one window). A window occurs in
a document only if each of its words does, so one necessary word is enough to find candidates: the rarest, by its
count over all documents' words. Documents' words, with their positions, are joined with those words; the word's
place in the window gives the only possible start (positional bound), and starts before the first word or ends
after the last are dropped (length bound). A candidate is then verified word by word against the document.

Documents are joined as rows of words, never as pairs of documents; a window that occurs in very many documents
adds one candidate for each occurrence. Copies of a text are looked up as often as they occur.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import cut, free, lower_ascii, small_or_not

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows go to the executors in blocks of about this many windows, and bytes of words and items, at most; the documents
#: are read once for each block.
BLOCK_WINDOWS, BLOCK_BYTES = 400_000, 64 << 20


def words_of(text: Column) -> Column:
    """Digits, small ASCII letters and everything beyond ASCII, A-Z lowered; no words for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows_of(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(window, items): n consecutive words, or all words of a shorter item, and the items that hold it."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    w = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("window"))
    return w.groupBy("window").agg(F.collect_set("item").alias("items"))


def occurrences(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """texts (k, w), windows of one block -> (k, start, len, items) of every verified occurrence."""
    # rarity of the windows' words over all documents
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    rarity = texts.select(F.explode("w").alias("word")).join(F.broadcast(vocabulary), "word").groupBy("word").count()
    places = windows.select("window", "items", F.posexplode("window").alias("offset", "word")).join(rarity, "word")
    # a word may stand twice in a window; one of its places will do, as each occurrence of the window has it there
    rarest = F.min_by(F.struct("word", "offset", "items"), F.struct("count", "word", "offset")).alias("rarest")
    # a word of the window that no document has rules the window out
    prefix = places.groupBy("window").agg(rarest, F.count("*").alias("n")).filter(F.col("n") == F.size("window"))
    prefix = cut(prefix.select("rarest.*", "window", F.size("window").alias("len")))
    # w stays beside its words up to the check, so nothing but verified starts leaves the stage
    at = texts.select("k", "w", F.posexplode("w").alias("at", "word")).join(F.broadcast(prefix), "word")
    at = at.withColumn("start", F.col("at") - F.col("offset")).filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.size("w")))
    return at.filter(F.slice("w", F.col("start") + 1, F.col("len")) == F.col("window")).select("k", "start", "len", "items")


def covered(spans: Column) -> Column:
    """How many positions the (start, len) spans cover together."""

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _search(texts: DataFrame, items: DataFrame, item_id_col: str, item_text_col: str, n: int) -> DataFrame | None:
    """texts (k, w) -> (k, start, len, items) of every occurrence in them; None if there is no window at all."""
    windows = cut(windows_of(items, item_id_col, item_text_col, n))
    size = F.octet_length(F.concat_ws(" ", "window")) + F.aggregate("items", F.lit(0), lambda acc, x: acc + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
    count, volume = windows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    blocks = max(-(-count // BLOCK_WINDOWS), -(-volume // BLOCK_BYTES))
    found = None
    for b in range(blocks):
        part = windows if blocks == 1 else cut(windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b))
        part = occurrences(texts, part)
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 10) -> DataFrame:
    """The rows of docs, with their columns of any name, whose texts hold no window of any item."""
    texts = docs.select(_key(F.col(text_col)).alias("k"), words_of(F.col(text_col)).alias("w"))
    found = _search(texts, items, item_id_col, item_text_col, n)
    if found is None:
        return docs
    gone = free(docs, "gone")
    keys = cut(found.select(F.col("k").alias(gone)).distinct())
    return docs.join(small_or_not(keys), _key(F.col(text_col)) == F.col(gone), "left_anti")


def hits(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs.

    Null and wordless texts have no words and no hits; rows with equal ids are rows of their own, and equal texts
    get equal results; items with null or wordless texts have no windows, and items with null ids mark words as hit
    but are not counted; empty tables on either side give no hits or no rows; further columns are not read."""
    # the key of a row is its id and its text, so copies of a text, and null texts, don't meet in one task
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.col(id_col).isNull().cast("string"), F.length(name).cast("string"), F.lit(":"), name, F.coalesce(F.col(text_col), F.lit("")))))
    words = words_of(F.col(text_col))
    found = _search(docs.select(key.alias("k"), words.alias("w")), items, item_id_col, item_text_col, n)
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("k"), F.size(words).cast("long").alias("n_words"))
    if found is None:
        rows = rows.withColumn("n_hit", F.lit(None).cast("long")).withColumn("item_ids", F.lit(None).cast("array<string>"))
    else:
        per_row = found.groupBy("k").agg(F.collect_set(F.struct("start", "len")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("item_ids"))
        rows = rows.join(per_row.select("k", covered(F.col("spans")).cast("long").alias("n_hit"), "item_ids"), "k", "left")
    ids, n_hit = F.coalesce("item_ids", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0)).cast("long")
    digest = F.sha2(F.concat_ws(",", F.array_sort(ids)), 256)
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = """
WITH low AS (SELECT doc_id, text, row_number() OVER () AS u FROM documents),
d AS (SELECT doc_id, u, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 9], ' ') AS g, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM v),
g AS (SELECT u, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT u, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
h AS (SELECT g.u, g.p, g.n, v.item_id FROM g JOIN v USING (g, n)),
c AS (SELECT u, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT u, unnest(range(p, p + n)) AS q FROM h) GROUP BY u),
t AS (SELECT u, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY u)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (u) LEFT JOIN t USING (u)
"""
