"""Sharding by best-fit-decreasing bin packing.

Groups of rows (equal texts by default) are indivisible. Sorted by size they enter the bin with the least room
that still holds them, found through a balanced tree of (room, bin). All groups at once would be one task, so:

* groups are dealt by hash into chunks of about `chunk_groups`; a chunk packs its groups into its own share of
  every bin's room. Groups larger than an eighth of a chunk's share of a bin don't belong there: they go up a
  level. A level has at most 8 x bins x chunks such groups, about a 300th of it at 40 bins, so a few levels end
  in a single chunk at any input size. Levels are packed from the largest groups down.
* a group larger than a whole bin can't stay whole: it is cut into the fewest equal pieces.

Sizes of the bins differ by the smallest groups of each chunk only.
"""

import random
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import all_columns, cut, free


class RoomTree:
    """A treap of (room, bin): insert, take the least room of at least x, take the most room."""

    def __init__(self, items: Iterable[tuple[int, int]] = ()):
        self._root, self._rng = None, random.Random(1)
        for item in items:
            self.insert(item)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            left, right = self._split(node[3], key)
            node[3] = left
            return node, right
        left, right = self._split(node[2], key)
        node[2] = right
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def insert(self, item: tuple[int, int]) -> None:
        left, right = self._split(self._root, item)
        self._root = self._merge(self._merge(left, [item, self._rng.random(), None, None]), right)

    def take_at_least(self, room: int) -> tuple[int, int] | None:
        left, right = self._split(self._root, (room, -1))
        if right is None:
            self._root = left
            return None
        above, node = None, right
        while node[2] is not None:
            above, node = node, node[2]
        if above is None:
            right = node[3]
        else:
            above[2] = node[3]
        self._root = self._merge(left, right)
        return node[0]

    def take_most(self) -> tuple[int, int] | None:
        if self._root is None:
            return None
        above, node = None, self._root
        while node[3] is not None:
            above, node = node, node[3]
        if above is None:
            self._root = node[2]
        else:
            above[3] = node[2]
        return node[0]


def best_fit_decreasing(sizes: list[int], room: list[int] | None = None, capacity: int | None = None) -> list[int]:
    """The bin of each size. With room (bins given): what fits nowhere enters the bin with the most room. With
    capacity: a new bin is opened for it. Ties in size keep their order."""
    tree = RoomTree((r, b) for b, r in enumerate(room or []))
    bins, out = len(room or []), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take_at_least(sizes[i])
        if found is None:
            if capacity is not None:
                found, bins = (capacity, bins), bins + 1
            else:
                found = tree.take_most()
        out[i] = found[1]
        tree.insert((found[0] - sizes[i], found[1]))
    return out


def text_bytes(text: Column, overhead: int = 16) -> Column:
    """UTF-8 bytes (null: none) plus an overhead for each row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)


def _pack_level(level: DataFrame, chunks: int, room: list[float], all_bytes: int) -> DataFrame:
    """Groups (key, piece, bytes) -> with shard; chunk c has its part bytes(c) / all_bytes of every bin's room."""
    bins = len(room)

    def chunk(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bytes", "key", "piece"], ascending=[False, True, True])
        share = int(part.bytes.sum()) / max(all_bytes, 1)
        turn = int(key[0]) * 7919 % bins  # chunks break ties at different bins
        shard = best_fit_decreasing(part.bytes.tolist(), [int(room[(b + turn) % bins] * share) for b in range(bins)])
        return pd.DataFrame({"key": part.key, "piece": part.piece, "shard": [(b + turn) % bins for b in shard]})

    dealt = level.withColumn("chunk", F.pmod(F.xxhash64("key", "piece"), F.lit(chunks)).cast("int"))
    return dealt.groupBy("chunk").applyInPandas(chunk, "key binary, piece int, shard int")


def pack_groups(groups: DataFrame, n_shards: int, chunk_groups: int = 100_000) -> DataFrame:
    """(key, piece, bytes) -> (key, piece, shard): the levels described above. Chunks hold 64 groups a bin at least, so
    fewer than an eighth of a level's groups can go up."""
    chunk_groups = max(chunk_groups, 64 * n_shards)
    groups = cut(groups)
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    levels, now, now_bytes, room = [], groups, total, [total / n_shards] * n_shards
    while n > chunk_groups:
        chunks = -(-n // chunk_groups)
        bound = max(1, now_bytes // (n_shards * chunks * 8))
        light, heavy = now.filter(F.col("bytes") < bound), now.filter(F.col("bytes") >= bound)
        up, up_bytes = heavy.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        levels.append((light, chunks, now_bytes - up_bytes))
        n, now, now_bytes = up, heavy, up_bytes
    if n or not levels:
        levels.append((now, 1, now_bytes))
    packed, below = None, total
    for k, (level, chunks, size) in reversed(list(enumerate(levels))):
        # a chunk's part of the room still left is its part of the bytes still to come; the top level may fill bins
        part = _pack_level(level, chunks, [max(0.0, r) for r in room], size if chunks == 1 else below)
        if k:
            part = cut(part)
            for shard, used in part.join(level, ["key", "piece"]).groupBy("shard").agg(F.sum("bytes")).collect():
                room[shard] -= used
            below -= size
        packed = part if packed is None else packed.unionByName(part)
    return packed


def assign(rows: DataFrame, *, key: Column, size: Column, n_shards: int, order: Column, out: str = "packed", chunk_groups: int = 100_000) -> DataFrame:
    """rows with one column more, `out`, which holds the shard. Groups are rows of equal key; order tells rows of a
    group apart, and rows that it doesn't tell apart must be equal."""
    k, size_, piece, pieces_, n_, cell_, start_ = (free(rows, name) for name in ("p_key", "p_size", "p_piece", "p_pieces", "p_n", "p_cell", "p_start"))
    rows = rows.withColumn(k, key).withColumn(size_, size)
    groups = cut(rows.groupBy(F.col(k).alias("key")).agg(F.sum(size_).alias("bytes"), F.count("*").alias("n")))
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    # at most n_shards groups are larger than total / n_shards
    large = groups.filter(F.col("bytes") > max(1, total // n_shards)).withColumn("p", F.ceil(F.col("bytes") * n_shards / total).cast("int"))
    cells = 256
    tagged = rows.join(F.broadcast(large.select(F.col("key").alias(k), F.col("p").alias(pieces_), F.col("n").alias(n_))), k, "left")
    hot = tagged.filter(F.col(pieces_).isNotNull()).withColumn(cell_, F.pmod(F.xxhash64(order), F.lit(cells)).cast("int"))
    starts = hot.groupBy(k, cell_).agg(F.count("*").alias(start_))
    starts = starts.withColumn(start_, F.coalesce(F.sum(start_).over(Window.partitionBy(k).orderBy(cell_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col(start_) + F.row_number().over(Window.partitionBy(k, cell_).orderBy(order)) - 1
    hot = hot.join(starts, [k, cell_]).withColumn(piece, F.floor(place * F.col(pieces_) / F.col(n_)).cast("int")).drop(cell_, start_)
    tagged = tagged.filter(F.col(pieces_).isNull()).withColumn(piece, F.lit(0)).unionByName(hot).drop(pieces_, n_, size_)
    pieces = groups.join(F.broadcast(large.select("key", "p")), "key", "left").withColumn("p", F.coalesce("p", F.lit(1)))
    pieces = pieces.select("key", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("piece"), "bytes", "n", "p")
    # rows j*n/p up to (j+1)*n/p of n equal rows
    count = F.ceil((F.col("piece") + 1) * F.col("n") / F.col("p")) - F.ceil(F.col("piece") * F.col("n") / F.col("p"))
    pieces = pieces.select("key", "piece", (count * F.col("bytes") / F.col("n")).cast("long").alias("bytes"))
    packed = pack_groups(pieces, n_shards, chunk_groups).select(F.col("key").alias(k), F.col("piece").alias(piece), F.col("shard").alias(out))
    return tagged.join(packed, [k, piece]).drop(k, piece)


def with_slots(rows: DataFrame, order: Column, cells: int = 256) -> DataFrame:
    """A gapless number from 0 within each shard, in the order of (hash cell, order): cells are counted, summed and
    numbered apart, so no task gets a shard as a whole."""
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(order), F.lit(cells)).cast("int"))
    starts = rows.groupBy("shard", "_cell").count().withColumn("_start", F.sum("count").over(Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.select("shard", "_cell", F.coalesce("_start", F.lit(0)).alias("_start"))
    number = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy(order)) - 1
    return rows.withColumn("_number", number).join(starts, ["shard", "_cell"]).withColumn("slot", (F.col("_start") + F.col("_number")).cast("long")).drop("_cell", "_start", "_number")


def shard_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 40, chunk_groups: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, by the law `bytes`.

    A null text counts as the empty one (no bytes, crc32 0) and shares its group; null ids and repeated rows are
    rows like any other; an empty table gives no rows; further columns are not read. Copies of a text share a
    shard, unless they are larger than total / n_shards together: sizes could not be near equal then, so such a
    group is cut into ceil(bytes * n_shards / total) pieces of equal counts, the fewest that fit."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text).alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("k"))
    order = F.struct("doc_id", "k")
    out = assign(rows, key=F.col("k"), size=F.col("size"), n_shards=n_shards, order=order, chunk_groups=chunk_groups)
    out = with_slots(out.withColumnRenamed("packed", "shard"), order)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_rows(docs: DataFrame, *, text_col: str = "text", n_shards: int = 40, chunk_groups: int = 100_000) -> DataFrame:
    """docs with a column shard, the texts themselves kept (one shuffle of them). Groups are cut as in
    shard_documents(). Columns of any name stay as they are, but a column shard of docs gives way to the new one."""
    docs = docs.drop("shard")
    columns = all_columns(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # rows of one group that agree in these hashes agree in all that can be hashed
    hashed = [c for c, f in zip(columns, docs.schema, strict=True) if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    order = F.struct(F.xxhash64(*hashed), F.hash(*hashed))
    packed = free(docs, "packed")
    out = assign(docs, key=F.unhex(F.sha2(text, 256)), size=text_bytes(text), n_shards=n_shards, order=order, out=packed, chunk_groups=chunk_groups)
    return out.select(*columns, F.col(packed).cast("int").alias("shard"))
