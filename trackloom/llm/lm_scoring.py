"""Language-model scoring with a log-frequency Bloom filter.

Counts of all pairs and triples of neighbouring tokens in the training texts are quantised on a logarithmic scale of
base BASE: q(c) = 1 + floor(log_BASE(c)). An n-gram goes into the filter together with each of the numbers 1..q.
Scoring probes with 1, 2, ... until a probe misses; the last hit gives the count, as the lower end of its step in
numerators and the upper end in denominators, so quantisation alone never makes a ratio too large. A false hit can
only overstate a count; it takes HASHES set bits by chance.

Counting and filter are dealt by the leading bits of the hashes: tasks send sorted (hash, count) blocks to buckets,
one shuffle; a bucket merges them and sets the bits of its own slice of the filter. The filter's size follows the
n-grams counted (BITS for each, which no number of entries exceeds) without a bound, so the rate of false hits,
(1 - exp(-HASHES * entries / bits)) ** HASHES, doesn't grow with the input. Up to BROADCAST_BITS the filter is
broadcast. A larger one is never put together: blocks of texts send their hashes to the slices, in the shuffle that
counts them, and get back one byte for each, in the order of the hashes.

The probability of a token interpolates triples, pairs and single tokens:
p(w | u v) = m3 * c(u v w) / c(u v) + (1 - m3) * p(w | v), m3 = SEEN3 * c(u v) / (c(u v) + DAMP),
p(w | v) = SEEN * c(v w) / c(v) + (1 - SEEN) * (c(w) + 1) / (N + 1 * (V + 1)); after a token never seen in training the
second part has all the weight. The single tokens' counts are exact.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import cut, fold_of, fresh_path, lean

BASE, HASHES, BITS, BROADCAST_BITS, LEAST_BITS = 2.0, 4, 12, 1 << 26, 1 << 20
SEEN3, DAMP, SEEN = 0.6, 4.0, 0.4
#: Single-token counts (12 bytes each, 16 from 2 ** 32 training tokens) are broadcast up to this many tokens; beyond it blocks of texts fetch them like filter values.
BROADCAST_TOKENS = 10_000_000
#: Characters of a block of texts, about.
BLOCK = 4_000_000
START, END = 0x9D5354415254, 0x7B9C5354454E44F1


class TokenHashes(dict):
    """word -> 64-bit hash, remembered for up to 150,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str) -> np.ndarray:
        """The words `[^\\x20\\x09-\\x0D]+`, A-Z lowered (bytes.lower and bytes.split know only ASCII), then the end."""
        words = text.encode().lower().split()
        out = np.empty(len(words) + 1, np.uint64)
        out[: len(words)] = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        out[-1] = END
        return out


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h * np.uint64(0xD6E8FEB86659FD93)


def ngrams(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of texts laid end to end, the hash of each token with the one before it, then that of each with the two before
    it; starts marks the texts' first tokens."""
    v, u = np.roll(tokens, 1), np.roll(tokens, 2)
    v[starts] = START
    second = starts + 1
    u[second[second < len(tokens)]] = START
    u[starts] = START + 1
    return np.concatenate([_mix(v, tokens), _mix(u, v, tokens)])


def _lay(hashes: TokenHashes, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [hashes.of(t) for t in texts]
    starts = np.cumsum([0, *map(len, parts[:-1])]) if parts else np.zeros(0, int)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), starts.astype(np.int64)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    heads = np.nonzero(np.r_[True, k[1:] != k[:-1]])[0] if len(k) else np.zeros(0, np.int64)
    return k[heads], (np.add.reduceat(c, heads) if len(k) else c)


def _blocks(bucket_bits: int, two: bool, most: int = 1_500_000):
    """Training texts -> (bucket, keys, counts): sorted distinct hashes of tokens, or of pairs and triples, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, waiting, n = TokenHashes(), [], 0

        def give() -> pa.RecordBatch:
            k, c = np.unique(np.concatenate(waiting), return_counts=True)
            bucket = (k >> np.uint64(64 - bucket_bits)).astype(np.int64)
            heads = np.nonzero(np.r_[True, bucket[1:] != bucket[:-1]])[0]
            ends = [*heads[1:], len(k)]
            columns = [pa.array(bucket[heads], pa.int32())] + [pa.array([x[i:j].tobytes() for i, j in zip(heads, ends, strict=True)], pa.binary()) for x in (k, c.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "counts"])

        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(0)]
            for at in range(0, len(texts), 256):
                tokens, starts = _lay(hashes, texts[at : at + 256])
                waiting.append(ngrams(tokens, starts) if two else tokens)
                n += len(tokens)
                if n >= most:
                    yield give()
                    waiting, n = [], 0
        if n:
            yield give()

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The buckets of one task, each merged."""
    found: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for bucket, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            k, c = found.setdefault(bucket, ([], []))
            k.append(np.frombuffer(keys.as_py(), np.uint64))
            c.append(np.frombuffer(counts.as_py(), np.int64))
    for bucket in list(found):
        yield bucket, *_merged(*found.pop(bucket))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, k, c in _by_bucket(batches):
        row = [[bucket], [k.tobytes()], [c.tobytes()], [len(k)], [int(c.sum())]]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["bucket", "keys", "counts", "v", "n"])


def _places(keys: np.ndarray, level: int, slice_mask: int) -> np.ndarray:
    """HASHES x keys bit positions of (key, level) in a slice."""
    a = _mix(keys, np.full(len(keys), level, np.uint64))
    b = (a >> np.uint64(32)) | np.uint64(1)
    return (a + np.arange(HASHES, dtype=np.uint64)[:, None] * b) & np.uint64(slice_mask)


def quantised(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def _slice(k: np.ndarray, c: np.ndarray, slice_bits: int) -> tuple[bytes, int]:
    """The filter's slice of one bucket, and the largest number in it."""
    q, bits = quantised(c), np.zeros(slice_bits, bool)
    most = int(q.max(initial=0))
    for level in range(1, most + 1):
        bits[_places(k[q >= level], level, slice_bits - 1).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes(), most


def _slices(slice_bits: int):
    """(bucket, keys, counts) blocks -> (bucket, bits, most): the filter's slice of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, k, c in _by_bucket(batches):
            bits, most = _slice(k, c, slice_bits)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([bits], pa.binary()), pa.array([most], pa.int32())], ["bucket", "bits", "most"])

    return run


class Filter:
    """The log-frequency Bloom filter, or with bucket_bits = 0 one slice of it, read-only; most: the largest number in it."""

    def __init__(self, bits: bytes, bucket_bits: int, most: int = 64):
        self.bytes, self.bucket_bits, self.most = np.frombuffer(bits, np.uint8), bucket_bits, most
        self.slice_bits = len(bits) * 8 >> bucket_bits

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """q of each key: 0 if unseen."""
        q, alive, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        while len(alive) and level <= self.most:
            k = keys[alive]
            offset = (k >> np.uint64(64 - self.bucket_bits)) * np.uint64(self.slice_bits) if self.bucket_bits else np.uint64(0)
            hit = np.ones(len(alive), bool)
            for at in _places(k, level, self.slice_bits - 1):
                at = at + offset
                hit &= (self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive = alive[hit]
            q[alive] = level
            level += 1
        return q


def log_probabilities(q: np.ndarray, starts: np.ndarray, c: np.ndarray, c_before: np.ndarray, n: int, v: int, texts: int) -> np.ndarray:
    """log10 p of each token. q: the filter's numbers of the pairs, then of the triples; c, c_before: exact counts of
    the tokens and of those before them; texts: the number of training texts."""
    q2, q3 = q[: len(c)], q[len(c) :]
    low = lambda q: np.where(q > 0, BASE ** (q - 1.0), 0.0)
    # the pair before a token is the pair that ends there; before a text's first token stands the start of all texts
    q_before = np.roll(q2, 1)
    high = np.where(q_before > 0, BASE**q_before.astype(float), 0.0)
    high[starts] = texts
    p3 = np.minimum(1.0, low(q3) / np.maximum(high, 1.0))
    p2 = np.minimum(1.0, low(q2) / np.maximum(c_before, 1))
    m3 = SEEN3 * high / (high + DAMP)
    m2 = np.where(c_before > 0, SEEN, 0.0)
    return np.log10(m3 * p3 + (1 - m3) * (m2 * p2 + (1 - m2) * (c + 1) / (n + 1 * (v + 1))))


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held_out: int = 2, broadcast_tokens: int = BROADCAST_TOKENS, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    A null or wordless text has one token, its end; null ids fall into the fold of the empty text; rows with equal
    ids are rows of their own; without training texts N and V are 0; an empty table gives no rows; further columns
    are not read."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select(F.col(id_col).alias("doc_id"), (fold_of(id_col, modulus) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    train = texts.filter("NOT held_out").select("text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = "bucket int, keys binary, counts binary"
    # buckets enough that one of them, merged, stays small in a task
    bucket_bits = max(8, (16 * train.rdd.getNumPartitions()).bit_length())
    single = train.mapInArrow(lean(_blocks(bucket_bits, False)), block).repartition(tasks, "bucket").mapInArrow(lean(_tables), block + ", v long, n long")
    single = cut(single)
    v, n = single.agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = LEAST_BITS
    while size < 2 * n * BITS:  # pairs and triples
        size *= 2
    ends = single.filter(F.col("bucket") == END >> (64 - bucket_bits)).select("keys", "counts").first()
    n_texts = int(_lookup(np.frombuffer(ends[0], np.uint64), np.frombuffer(ends[1], np.int64), np.array([END], np.uint64))[0]) if ends else 0
    gram_bits = max(8, min((n >> 22).bit_length() + 6, size.bit_length() - 11))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    known = None
    if v <= broadcast_tokens:
        # buckets are the leading bits, so their tables in order are one sorted table
        tables = sorted(single.select("bucket", "keys", "counts").toLocalIterator())
        narrow = np.uint32 if n < 1 << 32 else np.int64  # no count exceeds N
        known = sc.broadcast((b"".join(t[1] for t in tables), b"".join(np.frombuffer(t[2], np.int64).astype(narrow).tobytes() for t in tables), narrow))
        del tables
    if known is not None and size <= broadcast_bits:
        slices = train.mapInArrow(lean(_blocks(gram_bits, True)), block).repartition(tasks, "bucket").mapInArrow(lean(_slices(size >> gram_bits)), "bucket int, bits binary, most int")
        bitmap, each, most = bytearray(size // 8), size >> gram_bits >> 3, 0
        for bucket, bits, largest in slices.toLocalIterator():
            bitmap[bucket * each : (bucket + 1) * each] = bits
            most = max(most, largest)
        bloom = sc.broadcast((bytes(bitmap), gram_bits, most))
        del bitmap
        return texts.mapInArrow(lean(_score_all(bloom, known, n, v, n_texts)), schema)
    # too much to broadcast: blocks of texts fetch the filter's numbers, and the tokens' counts if they are too many
    deal_bits = max(8, min((4 * tasks).bit_length(), size.bit_length() - 11))  # a few buckets for each task
    width = _dealt_bytes(2 * n, deal_bits)
    path = fresh_path(spark, "lm-blocks")
    texts.mapInArrow(lean(_packed(BLOCK)), "rows binary").withColumn("block", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    wanted = rows.select("block", "rows").mapInArrow(lean(_wanted(deal_bits, width, known is None)), "block long, kind int, bucket int, keys binary, counts binary")
    found = wanted.repartition(tasks, "bucket").mapInArrow(lean(_answers(size >> deal_bits, deal_bits, width)), "block long, kind int, bucket int, found binary")
    found = found.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "found")).alias("found"))
    return rows.join(found, "block").select("rows", "found").mapInArrow(lean(_score_blocks(deal_bits, width, known, n, v, n_texts)), schema)


def _packed(most: int):
    """doc_id, held_out, text -> blocks of rows, each a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def give() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(pa.concat_batches(waiting))
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["rows"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                waiting.append(part)
                size += part.column(2).nbytes
                if size >= most:
                    yield give()
                    waiting, size = [], 0
        if waiting:
            yield give()

    return run


def _unpacked(hashes: TokenHashes, rows: pa.Scalar) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """A block's rows, their tokens and starts."""
    part = pa.ipc.open_stream(rows.as_buffer()).read_next_batch()
    return part, *_lay(hashes, [t.as_py() or "" for t in part.column(2)])


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, all first bytes first: planes of like bytes compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def _dealt_bytes(grams: int, bucket_bits: int) -> int:
    """Bytes of a hash that are dealt beside the bits of its bucket, 4 at least: with them it is longer by 8 bits than the
    number of n-grams, so of 256 n-grams one at most shares its hash with another, less than the filter's false hits."""
    return min(-(-max(32, grams.bit_length() + 8 - bucket_bits) // 8), (64 - bucket_bits) // 8)


def _dealt(keys: np.ndarray, bucket_bits: int, width: int) -> np.ndarray:
    """Hashes without the bits that aren't dealt."""
    return keys & ~np.uint64((1 << (64 - bucket_bits - 8 * width)) - 1)


def _wanted(bucket_bits: int, width: int, tokens_too: bool):
    """Blocks of texts -> (block, kind, bucket, keys, counts): sorted distinct hashes of pairs and triples (kind 1), or of tokens
    (kind 0), as planes of their differences, and their counts in the block's training texts, which may be 0."""
    drop = np.uint64(64 - bucket_bits - 8 * width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part, tokens, starts = _unpacked(hashes, rows)
                train = ~np.repeat(part.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff([*starts, len(tokens)]))
                for kind in (0, 1) if tokens_too else (1,):
                    all_keys = _dealt(ngrams(tokens, starts) if kind else tokens, bucket_bits, width)
                    k, at = np.unique(all_keys, return_inverse=True)
                    c = np.bincount(at[np.tile(train, len(all_keys) // len(train))], minlength=len(k))
                    bucket = (k >> np.uint64(64 - bucket_bits)).astype(np.int64)
                    heads = np.nonzero(np.r_[True, bucket[1:] != bucket[:-1]])[0]
                    rest = (k << np.uint64(bucket_bits) >> np.uint64(bucket_bits)) >> drop
                    cuts = list(zip(heads, [*heads[1:], len(k)], strict=True))
                    columns = [pa.array(np.full(len(heads), block), pa.int64()), pa.array(np.full(len(heads), kind), pa.int32()), pa.array(bucket[heads], pa.int32())]
                    columns += [pa.array([_planes(np.diff(rest[i:j], prepend=np.uint64(0)), width) for i, j in cuts], pa.binary()), pa.array([_planes(c[i:j], max(1, (int(c[i:j].max()).bit_length() + 7) // 8)) for i, j in cuts], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "kind", "bucket", "keys", "counts"])

    return run


def _answers(slice_bits: int, bucket_bits: int, width: int):
    """What _wanted() gives -> (block, kind, bucket, found): a filter number (1 byte) or a count (8 bytes) for each key."""
    drop = np.uint64(64 - bucket_bits - 8 * width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[tuple[int, int], list] = {}
        for batch in batches:
            for block, kind, bucket, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), batch.column(4), strict=True):
                asked.setdefault((kind, bucket), []).append((block, keys.as_py(), counts.as_py()))
        for kind, bucket in list(asked):
            rows = []
            for block, keys, counts in asked.pop((kind, bucket)):
                k = np.cumsum(_from_planes(keys, width), dtype=np.uint64) << drop
                rows.append((block, k | np.uint64(bucket << 64 - bucket_bits), _from_planes(counts, len(counts) // len(k)).view(np.int64)))
            k, c = _merged([x[1] for x in rows], [x[2] for x in rows])
            k, c = k[c > 0], c[c > 0]
            if kind:
                bits, most = _slice(k, c, slice_bits)
                filter_ = Filter(bits, 0, most)
                found = [filter_.levels(x[1]).astype(np.uint8).tobytes() for x in rows]
            else:
                found = [_lookup(k, c, x[1]).tobytes() for x in rows]
            columns = [pa.array([x[0] for x in rows], pa.int64()), pa.array([kind] * len(rows), pa.int32()), pa.array([bucket] * len(rows), pa.int32()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "kind", "bucket", "found"])

    return run


def _lookup(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0).astype(np.int64)


def _scored(ids: pa.Array, held_outs: pa.Array, starts: np.ndarray, q: np.ndarray, c: np.ndarray, n: int, v: int, n_texts: int) -> pa.RecordBatch:
    before = np.roll(c, 1)
    before[starts] = n_texts
    base = np.log10((c + 1) / (n + 1 * (v + 1)))
    each = log_probabilities(q, starts, c, before, n, v, n_texts)
    add = lambda x: np.add.reduceat(x, starts)
    sizes = np.diff([*starts, len(c)])
    columns = [ids, held_outs, pa.array(sizes, pa.int64()), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(starts), n), pa.int64()), pa.array(add(base)), pa.array(add(each))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _counts_of(known, tokens: np.ndarray) -> np.ndarray:
    unique, back = np.unique(tokens, return_inverse=True)
    return _lookup(np.frombuffer(known.value[0], np.uint64), np.frombuffer(known.value[1], known.value[2]), unique)[back]


def _score_all(bloom, known, n: int, v: int, n_texts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, filter_ = TokenHashes(), Filter(*bloom.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens, starts = _lay(hashes, [t.as_py() or "" for t in part.column(2)])
                unique, back = np.unique(ngrams(tokens, starts), return_inverse=True)
                yield _scored(part.column(0), part.column(1), starts, filter_.levels(unique)[back], _counts_of(known, tokens), n, v, n_texts)

    return run


def _score_blocks(bucket_bits: int, width: int, known, n: int, v: int, n_texts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            for rows, got in zip(batch.column(0), batch.column(1), strict=True):
                part, tokens, starts = _unpacked(hashes, rows)
                # buckets are the leading bits, so what they gave, in their order, is in the order of the sorted hashes
                found = sorted((x["kind"], x["bucket"], x["found"]) for x in got.as_py())

                def given(kind: int, keys: np.ndarray, dtype, found=found) -> np.ndarray:
                    return np.frombuffer(b"".join(x[2] for x in found if x[0] == kind), dtype).astype(np.int64)[np.unique(_dealt(keys, bucket_bits, width), return_inverse=True)[1]]

                c = given(0, tokens, np.int64) if known is None else _counts_of(known, tokens)
                yield _scored(part.column(0), part.column(1), starts, given(1, ngrams(tokens, starts), np.uint8), c, n, v, n_texts)

    return run
