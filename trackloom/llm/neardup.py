"""Near-duplicate documents by an LSH forest, links confirmed on full shingle sets.

A document is the set of its distinct word shingles (64-bit hashes). Documents with equal sets form a class and go
on as one. Each class gets TREES labels: sequences of DEPTH min-hash values of 16 bits. In a sorted order of labels,
classes with a long common prefix are neighbours; a region is all classes that share a prefix. Regions start at a
depth that pairs at the threshold share with probability `threshold ** depth` in each of the TREES orders.

Candidates are drawn only between classes not yet in one component:
* a region of at most SMALL classes gives all its pairs;
* in a larger (dense) one, the sorted orders give each class with the NEXT classes after it, its neighbours by longest
  common prefix (the orders are dealt by ranges of tree, label and class, so no region is one task's); each class is
  also paired with one leader; then the region is divided by the next label value (a depth of its own for each
  region: as deep as it stays dense) and treated likewise, down to the full depth;
* what is then still apart in a dense region is compared by differences: B holds the shingles that most of the
  region's classes have (counted in chunks of about CHUNK classes, where most of a chunk have them; any B gives the same
  links, so one that barely most classes have may be missing), D(x) is what x has beyond B or lacks of it. Since
  |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|, a pair far from B is linked only if its D share enough elements: a join on
  them, with bounds on how many can still follow (rarest first), gives the candidates; each class is compared with the
  one nearest to B for its size, which is linked with both classes of any linked pair whose D share nothing.
In dense regions pairs that can't be linked are left out by an exact bound: a shingle that only one class of all
dense regions has is private to it, and what two classes share is at most either one's shingles that aren't. The
class with the fewest private shingles, the middle of its region, leads.
After each depth the candidates are verified on the full sets (sizes first), and components grow by the links found.
A pair inside a component adds nothing to components, so leaving it out loses no component.

Chance that a pair at 0.85 shares no region: (1 - 0.85 ** 4) ** 16 = 7e-6; closer pairs less.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import BROADCAST_IDS, cut, free, lean, small_or_not
from trackloom.llm.graphs import components

TREES, DEPTH, SMALL, NEXT, CHUNK = 16, 6, 32, 3, 64


class WordHashes(dict):
    """word -> 64-bit hash, remembered for up to 100,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str) -> np.ndarray:
        """Hashes of the words `[^\\x20\\x09-\\x0D]+` with A-Z lowered: bytes.lower and bytes.split know only ASCII."""
        words = text.encode().lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of `width` consecutive words; of all words if they are fewer; empty without words."""
    if not len(words):
        return words
    width = min(width, len(words))
    mix = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        mix = (mix ^ words[k : k + len(mix)]) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    return np.unique(mix + np.uint64(width))


_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 2**32, (TREES * DEPTH, 1), np.uint32)
_MUL = _RNG.integers(0, 2**31, (TREES * DEPTH, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def labels(shingles: np.ndarray) -> bytes:
    """TREES x DEPTH min-hash values as big-endian 16-bit numbers, tree by tree."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = None
    for at in range(0, len(low), 4096):
        x = low[at : at + 4096] ^ _XOR
        x *= _MUL
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        now = x.min(axis=1)
        least = now if least is None else np.minimum(least, now)
    least = least * np.uint32(0x9E3779B1)
    return ((least ^ (least >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(16)).astype(">u2").tobytes()


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch.column(1):
                s = shingle_set(hashes.of(text.as_py() or ""), width)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(labels(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n", "key", "sig"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(hashes.of(t.as_py() or ""), width).tobytes() for t in batch.column(0).slice(at, 256)]
                keys = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "set"])

    return run


def _linked(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _neighbours(depth: int, num: int, den: int):
    """(tree, label, key, n) in order -> (a, b): each class with the NEXT ones after it in its tree, as far as they share
    a prefix of `depth` values and sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for batch in batches:
            rows = last + list(zip(batch.column(0).to_pylist(), [x[: 2 * depth] for x in batch.column(1).to_pylist()], batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            a, b = [], []
            for at in range(len(last), len(rows)):
                tree, prefix, key, n = rows[at]
                for t, p, other, m in rows[max(0, at - NEXT) : at]:
                    if t == tree and p == prefix and den * min(n, m) >= num * max(n, m):
                        a.append(min(key, other))
                        b.append(max(key, other))
            last = rows[-NEXT:]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose sets, 8 bytes for each shingle, have about `most` bytes together (a row at least), so
    what is made of a slice stays small however long texts are."""
    for batch in batches:
        sizes = np.cumsum([len(x.as_buffer()) for x in batch.column(column)])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, 1):
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        keys = pa.array(np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keys), pa.array(np.concatenate(sets))], ["key", "shingle"])


def _private(sets: DataFrame) -> DataFrame:
    """(key, u): how many shingles of a class no other class has; classes without any are left out."""
    once = sets.select("key", "set").mapInArrow(lean(_exploded), "key binary, shingle long").groupBy("shingle").agg(F.count("*").alias("c"), F.min("key").alias("key")).filter("c = 1")
    return once.groupBy("key").agg(F.count("*").alias("u"))


def _majorities(batches: Iterator[pa.RecordBatch], most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """(c, chunk, set) in order -> (c, shingle, seen): the shingles that more than half of a chunk's classes have, and how
    many have them. A chunk is taken in parts of about `most` bytes."""
    held: list[np.ndarray] = []
    at, size = (None, None), 0

    def told() -> pa.RecordBatch:
        shingles, seen = np.unique(np.concatenate(held), return_counts=True)
        common = 2 * seen > len(held)
        return pa.RecordBatch.from_arrays([pa.array([at[0]] * int(common.sum()), pa.binary()), pa.array(shingles[common]), pa.array(seen[common])], ["c", "shingle", "seen"])

    for batch in batches:
        for c, chunk, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if held and ((c, chunk) != at or size >= most):
                yield told()
                held, size = [], 0
            at = (c, chunk)
            held.append(np.frombuffer(x.as_buffer(), np.int64).copy())
            size += held[-1].nbytes
    if held:
        yield told()


def _counted(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """groups (c, key, m), m the number of c's classes -> (c, shingle, seen): in how many classes a shingle was counted
    that most classes of some chunk have. Sets are read as they are: a class is in up to TREES groups, and a row for each
    shingle in each of them would be many."""
    chunk = F.pmod(F.xxhash64("key"), F.ceil(F.col("m") / CHUNK)).alias("chunk")
    rows = groups.select("c", "key", chunk).join(sets, "key").select("c", "chunk", "set").repartition("c", "chunk").sortWithinPartitions("c", "chunk")
    return rows.mapInArrow(lean(_majorities), "c binary, shingle long, seen long").groupBy("c", "shingle").agg(F.sum("seen").alias("seen"))


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, key, n, u, root, set, common) -> the elements of set ^ common, each with their number."""
    for batch in _slices(batches, 5):
        diffs = [np.setxor1d(np.frombuffer(x.as_buffer(), np.int64), np.array(y.as_py(), np.int64)) for x, y in zip(batch.column(5), batch.column(6), strict=True)]
        at = pa.array(np.repeat(np.arange(len(diffs), dtype=np.int32), [max(1, len(d)) for d in diffs]))
        nd = pa.array([len(d) for d in diffs], pa.int64()).take(at)
        # a class without any difference still counts: it gets one row of a null element
        elements = pa.concat_arrays([pa.array(d) if len(d) else pa.nulls(1, pa.int64()) for d in diffs]) if diffs else pa.nulls(0, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(5)), nd, elements], ["c", "key", "n", "u", "root", "nd", "shingle"])


def _pairs_by_difference(groups: DataFrame, sets: DataFrame, num: int, den: int, bound) -> DataFrame:
    """groups (c, key, n, u, root) -> (a, b) pairs between components that may be linked, none of those left out."""
    # what is known of a group is one row, joined so that the classes of a large group don't meet in one task
    apart = groups.groupBy("c").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("m")).filter("r0 <> r1")
    apart = small_or_not(cut(apart.select("c", "m")))
    groups = cut(groups.join(apart, "c"))
    common = _counted(groups, sets).join(apart, "c").filter(2 * F.col("seen") > F.col("m"))
    common = cut(common.groupBy("c").agg(F.collect_list("shingle").alias("common")))
    n_common = common.agg(F.coalesce(F.sum(F.size("common")), F.lit(0))).first()[0]
    # a group whose classes have no shingle in common has an empty B
    rows = groups.join(sets, "key").join(F.broadcast(common) if n_common <= BROADCAST_IDS else common, "c", "left")
    rows = rows.select("c", "key", "n", "u", "root", "set", F.coalesce("common", F.array().cast("array<long>")).alias("common"))
    diffs = cut(rows.mapInArrow(lean(_differences), "c binary, key binary, n long, u long, root binary, nd long, shingle long"))
    # x and y whose D share nothing are linked only if off(x) + off(y) <= 0. The class with the least off has no more
    # than either, so then it is linked with both, and one hub is enough
    off = (den + num) * F.col("nd") - (den - num) * F.col("n")
    nearest = small_or_not(cut(diffs.groupBy("c").agg(F.min_by(F.struct("key", "root"), F.struct(off, "key")).alias("y0"))))
    major = small_or_not(cut(groups.groupBy("c", "root").count().groupBy("c").agg(F.max_by("root", F.struct("count", "root")).alias("major"))))
    pairs = groups.join(nearest, "c").filter(F.col("root") != F.col("y0.root")).select(F.least("key", "y0.key").alias("a"), F.greatest("key", "y0.key").alias("b")).distinct()
    # elements that two classes at least have, rarest first; from the first one that a pair shares on, it can share
    # no more than either has left
    shared = diffs.groupBy("c", "shingle").count().filter("count > 1")
    listed = diffs.join(shared, ["c", "shingle"])
    own = Window.partitionBy("c", "key")
    listed = listed.withColumn("left", F.count("*").over(own) - F.row_number().over(own.orderBy("count", "shingle")) + 1).drop("count")
    listed = cut(listed.join(major, "c"))
    x, y = listed.filter("root <> major").alias("x"), listed.alias("y")
    most = F.least(F.col("x.left"), F.col("y.left"))
    enough = 2 * (den + num) * most >= (den + num) * (F.col("x.nd") + F.col("y.nd")) - (den - num) * (F.col("x.n") + F.col("y.n"))
    on = (F.col("x.c") == F.col("y.c")) & (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root")) & enough & bound("x.", "y.")
    on = on & ((F.col("y.root") == F.col("y.major")) | (F.col("x.key") < F.col("y.key")))
    met = x.join(y, on).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))
    return pairs.unionByName(met).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, depth: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; documents are linked if den * common >= num * union.

    A null or wordless text has an empty set, is linked with nothing and is its own component. Rows with equal ids
    are rows of one document each; equal texts share a component and only the rows with the smallest id are kept.
    Null ids count as larger than others. An empty table gives no rows; further columns are not read."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    feats = cut(texts.mapInArrow(lean(_features(width)), f"doc_id {id_type}, n long, key binary, sig binary"))
    classes = cut(feats.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n").alias("n")))

    def at(d: int):
        return F.substring("label", 1, 2 * d).alias("prefix")

    step = 2 * DEPTH
    cuts = F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("sig", t * step + 1, step).alias("label")) for t in range(TREES)])
    forest = classes.select("key", "n", F.inline(cuts))
    # only classes that share a region with another go on; those of dense regions don't meet in one task for that
    shared = cut(forest.groupBy("tree", at(depth)).agg(F.count("*").alias("m")).filter("m > 1"))
    dense = small_or_not(shared.filter(F.col("m") > SMALL).drop("m"))
    placed, cell = forest.withColumn("prefix", at(depth)), ["tree", "prefix"]
    hot = placed.join(dense, cell, "left_semi")
    cold = placed.join(dense, cell, "left_anti").join(shared.filter(F.col("m") <= SMALL).drop("m"), cell, "left_semi")
    forest = cut(hot.withColumn("dense", F.lit(True)).unionByName(cold.withColumn("dense", F.lit(False))).select("tree", "label", "key", "n", "dense"))
    members = forest.select("key").distinct().join(classes.select("key", "rep"), "key")
    sets = texts.join(small_or_not(cut(members.select("rep").distinct())), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    sets = sets.select("text").mapInArrow(lean(_sets(width)), "key binary, set binary")
    sets = cut(sets.join(members.select("key"), "key", "left_semi").groupBy("key").agg(F.first("set").alias("set")))
    crowd = cut(forest.filter("dense").select("key").distinct())
    private = cut(_private(sets.join(small_or_not(crowd), "key", "left_semi")))
    roots = None  # (node, root): classes that aren't their component's smallest
    live = forest.drop("dense").join(private, "key", "left").withColumn("u", F.coalesce("u", F.lit(0))).withColumn("root", F.col("key"))

    def fits(n1, n2):  # sizes too unlike can't be linked
        return den * F.least(n1, n2) >= num * F.greatest(n1, n2)

    def bound(x: str, y: str):  # within dense regions
        both = F.least(F.col(f"{x}n") - F.col(f"{x}u"), F.col(f"{y}n") - F.col(f"{y}u"))
        return den * both >= num * (F.col(f"{x}n") + F.col(f"{y}n") - both)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("set_b")), "b")
        links = cut(pairs.select("a", "b", "set_a", "set_b").mapInArrow(lean(_linked(num, den)), "a binary, b binary"))
        return links.select(F.col("a").alias("u"), F.col("b").alias("v"))

    def joined(edges: DataFrame) -> DataFrame:
        return components(edges if roots is None else edges.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))

    def rooted(rows: DataFrame) -> DataFrame:
        return cut(rows.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))

    groups = None
    for d in range(depth, DEPTH + 1):
        live = live.withColumn("prefix", at(d))
        leader = F.min_by(F.struct("key", "n", "u", "root"), F.struct(F.col("u") / F.col("n"), F.xxhash64("key"))).alias("leader")
        regions = cut(live.groupBy(cell).agg(F.count("*").alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1"), leader).filter("r0 <> r1"))
        crowded = small_or_not(regions.filter(F.col("m") > SMALL).select(*cell, "leader"))
        dense_rows = cut(live.join(crowded, cell))
        few = live.join(crowded, cell, "left_anti")
        x, y = few.alias("x"), few.alias("y")
        same = (F.col("x.tree") == F.col("y.tree")) & (F.col("x.prefix") == F.col("y.prefix")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root"))
        same = same & fits(F.col("x.n"), F.col("y.n"))
        pairs = x.join(y, same & bound("x.", "y.") if d > depth else same).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
        stars = dense_rows.filter((F.col("root") != F.col("leader.root")) & fits(F.col("n"), F.col("leader.n")) & bound("", "leader."))
        pairs = pairs.unionByName(stars.select(F.least("key", "leader.key").alias("a"), F.greatest("key", "leader.key").alias("b")))
        if d == depth:
            order = dense_rows.select("tree", "label", "key", "n").repartitionByRange("tree", "label", "key").sortWithinPartitions("tree", "label", "key")
            pairs = pairs.unionByName(order.mapInArrow(lean(_neighbours(depth, num, den)), "a binary, b binary"))
        roots = joined(verified(pairs.distinct()))
        # on go dense regions, without classes whose private shingles rule out any link
        dense_rows = dense_rows.filter(den * (F.col("n") - F.col("u")) >= num * F.col("n"))
        if d == depth:
            # a class is in the group of each dense region it is in, so two of one region always meet
            groups = cut(dense_rows.select(F.col("leader.key").alias("c"), "key", "n", "u").distinct())
        if d == DEPTH:
            break
        live = rooted(dense_rows.select("tree", "label", "key", "n", "u"))
        if live.isEmpty():
            break
    if not groups.isEmpty():
        roots = joined(verified(_pairs_by_difference(rooted(groups), sets, num, den, bound)))
    named = classes.select("key", "rep").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("key", "component_id")
    none = feats.filter("key IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = feats.filter("key IS NOT NULL").select("doc_id", "n", "key").join(cut(named), "key").select("doc_id", "n", "component_id").unionByName(none)
    component = F.col("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the near-duplicates: of each component one row stays, that with the smallest id.

    Rows without words stay all; of rows with one id and one text, too, one stays; further columns, whatever their
    names, stay as they are."""
    id_col, text_col, other = options.get("id_col", "doc_id"), options.get("text_col", "text"), free(docs, "other")
    marked = cut(near_duplicates(docs, **options))
    dropped = cut(marked.filter("NOT kept").select(F.col("doc_id").alias(other)).distinct())
    same = F.col(id_col).eqNullSafe(F.col(other))
    out = docs.join(small_or_not(dropped), same, "left_anti")
    again = cut(marked.filter("kept AND n_shingles > 0").groupBy(F.col("doc_id").alias(other)).count().filter("count > 1").select(other))
    if again.isEmpty():
        return out
    hint = small_or_not(again)
    once = out.join(hint, same, "left_semi").dropDuplicates([id_col, text_col])
    return out.join(hint, same, "left_anti").unionByName(once)
