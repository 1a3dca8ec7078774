"""The operators against brute force, round trips and exact results on small inputs."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackloom.llm import graphs, html_text, importance, lm_scoring, media, mixing, neardup, sharding, toxicity, warc, webp


def variants(n=240, seed=5):
    """Texts in families of near copies, some in chains, some with large crowds."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for family in range(6):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(n // 6):
            x = list(base)
            for _ in range(rng.randint(0, 5)):
                x[rng.randrange(60)] = rng.choice(words)
            out.append(" ".join(x))
    return [(k, t) for k, t in enumerate(out)]


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


@pytest.mark.parametrize(("width", "num", "depth"), [(3, 85, 4), (5, 80, 3)])
def test_components(spark, width, num, depth):
    rows = variants()
    sets = {k: shingles(t, width) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, width=width, num=num, depth=depth).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: find(k) for k in sets}
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_a_crowd_with_several_leaders(spark, monkeypatch, seed):
    """Pairs at the threshold inside one crowd, most classes far from most others; the difference lists must find them."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(120)]
    rows, serial = [], itertools.count()
    for _ in range(150):
        text = list(base)
        for k in rng.sample(range(4, 116), rng.randint(2, 6)):
            text[k] = f"x{rng.randrange(12)}"
        rows.append(text)
        if rng.random() < 0.5:
            near = list(text)
            near[rng.randrange(120)] = f"y{next(serial)}"
            rows.append(near)
    rows = [(k, " ".join(t)) for k, t in enumerate(rows)]
    groups_of = []
    inner = neardup._pairs_by_difference
    monkeypatch.setattr(neardup, "_pairs_by_difference", lambda groups, *a: (groups_of.extend(groups.select("c", "key").collect()), inner(groups, *a))[1])
    sets = {k: shingles(t, 3) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=85, den=100, depth=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: find(k) for k in sets}
    assert len({g.c for g in groups_of}) > 1 and max(Counter(g.key for g in groups_of).values()) > 1


@pytest.mark.parametrize(("num", "lacks", "own"), [(85, 84, 85), (80, 123, 124)])
def test_linked_pairs_whose_differences_share_nothing(spark, num, lacks, own):
    """The class with the fewest differences from the common set is too small to link two larger ones with each other."""
    common = set(range(1000))
    members = {b"y0": common - set(range(lacks)), b"x": common | set(range(2000, 2000 + own)), b"y": common | set(range(4000, 4000 + own))}
    rng = random.Random(1)
    members |= {b"z%02d" % k: common - set(rng.sample(range(1000), 300)) for k in range(40)}
    groups = spark.createDataFrame([(b"c", k, len(m), 0, k) for k, m in members.items()], "c binary, key binary, n long, u long, root binary")
    sets = spark.createDataFrame([(k, np.array(sorted(m), np.int64).tobytes()) for k, m in members.items()], "key binary, set binary")
    met = neardup._pairs_by_difference(groups, sets, num, 100, lambda x, y: F.lit(True)).collect()
    root = {k: k for k in members}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in ((bytes(r.a), bytes(r.b)) for r in met):
        if 100 * len(members[a] & members[b]) >= num * len(members[a] | members[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert 100 * len(common) >= num * len(members[b"x"] | members[b"y"]) and find(b"x") == find(b"y")


@pytest.mark.parametrize("families", [1, 4])
def test_differences_in_a_group_without_a_common_shingle(spark, families):
    """One group of several families: no shingle is in most of its classes, so the differences are the whole sets."""
    rng, members = random.Random(families), {}
    for f in range(families):
        base = set(range(1000 * f, 1000 * f + 200))
        for k in range(12):
            members[b"%d-%02d" % (f, k)] = base - set(rng.sample(sorted(base), 8)) | {10**6 + 100 * f + k}
    groups = spark.createDataFrame([(b"c", k, len(m), 0, k) for k, m in members.items()], "c binary, key binary, n long, u long, root binary")
    sets = spark.createDataFrame([(k, np.array(sorted(m), np.int64).tobytes()) for k, m in members.items()], "key binary, set binary")
    met = {(bytes(r.a), bytes(r.b)) for r in neardup._pairs_by_difference(groups, sets, 85, 100, lambda x, y: F.lit(True)).collect()}
    root = {k: k for k in members}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in met:
        if 100 * len(members[a] & members[b]) >= 85 * len(members[a] | members[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    linked = [(a, b) for a, b in itertools.combinations(sorted(members), 2) if 100 * len(members[a] & members[b]) >= 85 * len(members[a] | members[b])]
    assert linked and all(find(a) == find(b) for a, b in linked)


def test_a_groups_common_shingles_are_told_in_few_rows(spark, monkeypatch):
    """1,000 classes in two groups, each of 40 common shingles, 10 that half of the classes have and 30 of its own: not a
    row for each shingle of a class, though all classes are counted."""
    rng = np.random.default_rng(5)
    half = rng.random((1000, 10)) < 0.5
    of = [np.sort(np.r_[np.arange(40), 100 + np.nonzero(half[k])[0], 1000 + 30 * k + np.arange(30)]).astype(np.int64) for k in range(1000)]
    key = [k.to_bytes(16, "big") for k in range(1000)]
    groups = spark.createDataFrame([(c, x, 1000) for c in (b"c", b"d") for x in key], "c binary, key binary, m long")
    sets = spark.createDataFrame([(x, v.tobytes()) for x, v in zip(key, of, strict=True)], "key binary, set binary")
    total = spark.sparkContext.accumulator(0)
    inner = neardup._majorities

    def watched(batches):
        for out in inner(batches):
            total.add(out.num_rows)
            yield out

    monkeypatch.setattr(neardup, "_majorities", watched)
    seen = {(bytes(r.c), r.shingle): r.seen for r in neardup._counted(groups, sets).collect()}
    assert {k: n for k, n in seen.items() if k[1] < 40} == {(c, k): 1000 for c in (b"c", b"d") for k in range(40)}
    assert all(n <= half[:, k - 100].sum() for (_, k), n in seen.items() if k >= 40)
    assert 0 < total.value <= 2 * 20 * 50 < 0.02 * 2 * sum(map(len, of))


@pytest.mark.parametrize("small", [0, 10**6])
def test_connected_components(spark, small):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "u int, v int"), small).collect()}
    assert got == {v: find(v) for v in root if find(v) != v}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40))
def test_best_fit_decreasing(sizes):
    rooms, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = min(((r, b) for b, r in enumerate(rooms) if r >= sizes[i]), default=None)
        if fit is None:
            rooms.append(50)
            fit = (50, len(rooms) - 1)
        rooms[fit[1]] -= sizes[i]
        want[i] = fit[1]
    assert sharding.best_fit_decreasing(sizes, capacity=50) == want


@pytest.mark.parametrize("chunk", [320, 100_000])
def test_shards(spark, chunk):
    rng = random.Random(4)
    texts = ["x" * rng.randint(0, 400) + str(rng.randrange(60)) for _ in range(1500)] + ["copy " * 100] * 600
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.shard_documents(docs, n_shards=5, chunk_groups=chunk).collect()
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode()))
    assert len(load) == 5 and max(load.values()) - min(load.values()) < 1200
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    homes = defaultdict(set)
    for r in got:
        homes[texts[r.doc_id]].add(r.shard)
    total = sum(load.values())
    assert all(len(h) == 1 for t, h in homes.items() if texts.count(t) * (len(t) + 16) <= total // 5)


def test_targets_and_taken(spark):
    rng = random.Random(6)
    sizes = {"a": 200, "b": 3, "c": 40, "é": 90, None: 10}
    rows = [(k, " ".join(["w"] * rng.randint(0, 60)), s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(docs).collect()
    total, by = Counter(), {k: s for k, _, s in rows}
    for k, t, s in rows:
        total[s] += len(t.split())
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, goal, open_ = 1.5 * sum(total.values()), {}, set(order)
    while True:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 2 * total[s]]
        if not over:
            goal |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            goal[s] = 2.0 * total[s]
            left -= goal[s]
            open_.discard(s)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(goal[by[r.doc_id]]) and r.source_size == total[by[r.doc_id]] and r.taken <= 2 * r["size"]
        taken[by[r.doc_id]] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 120 for s in goal)
    assert sorted(mixing.copies(docs.repartition(3)).collect()) == sorted(got)
    drawn = Counter(r.doc_id for r in mixing.emit(docs).collect())
    assert drawn == Counter({r.doc_id: r.n_copies for r in got if r.n_copies})


def lm_rows():
    rng = random.Random(8)
    words = [f"t{k}" for k in range(60)]
    return [(k, " ".join(rng.choice(words[: 5 + k % 55]) for _ in range(rng.randint(0, 80)))) for k in range(160)]


@pytest.mark.parametrize("most", [10**7, 0])
def test_language_model(spark, most):
    rows = lm_rows()
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    tokens = {k: [*t.split(), None] for k, t in rows}
    c = Counter(w for k, _ in rows if not held[k] for w in tokens[k])
    n, v = sum(c.values()), len(c)
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_tokens=most).collect()
    for r in got:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 1.1 * sum(r.base_score for r in out)


@pytest.mark.parametrize("bits", [1 << 26, 0])
def test_language_model_counts_triples(spark, bits):
    """Scores against dictionaries of exact counts, quantised as the filter does."""
    rows = lm_rows()
    padded = {k: ["<<", "<", *t.split(), None] for k, t in rows}
    train = [t for k, t in padded.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    grams = [Counter(tuple(t[i - m : i + 1]) for t in train for i in range(2, len(t))) for m in range(3)]
    n, v = sum(grams[0].values()), len(grams[0])
    q = lambda g, m: grams[m][g].bit_length()

    def log_p(t, i):
        u, b, w = t[i - 2 : i + 1]
        ahead = len(train) if i == 2 else grams[0][(b,)]
        high = len(train) if i == 2 else 2 ** q((u, b), 1) if q((u, b), 1) else 0
        low = lambda x: 2 ** (x - 1) if x else 0
        m3, m2 = 0.6 * high / (high + 4), 0.4 if ahead else 0.0
        p3, p2 = min(1, low(q((u, b, w), 2)) / (high or 1)), min(1, low(q((b, w), 1)) / (ahead or 1))
        return math.log10(m3 * p3 + (1 - m3) * (m2 * p2 + (1 - m2) * (grams[0][(w,)] + 1) / (n + v + 1)))

    for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_bits=bits).collect():
        t = padded[r.doc_id]
        assert r.score == pytest.approx(sum(log_p(t, i) for i in range(2, len(t)))), r.doc_id


@pytest.mark.parametrize(("tokens", "bits"), [(10**7, 0), (0, 10**12), (0, 0)])
def test_language_model_beyond_broadcasts(spark, monkeypatch, tokens, bits):
    monkeypatch.setattr(lm_scoring, "BLOCK", 500)
    docs = spark.createDataFrame([*lm_rows(), (None, None), (7, "t1 t2")], "doc_id long, text string").repartition(3)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    want = sorted(lm_scoring.score(docs).collect(), key=key)
    got = sorted(lm_scoring.score(docs, broadcast_tokens=tokens, broadcast_bits=bits).collect(), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(a.score == pytest.approx(b.score) and a.base_score == pytest.approx(b.base_score) for a, b in zip(got, want, strict=True))


def test_filter_of_a_large_bucket_keeps_its_rate(spark):
    """One filter for each side of the former bound: the same rate of false hits; levels end at the largest number stored."""
    rng = np.random.default_rng(5)
    for n in (1 << 14, 1 << 17):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        bits, most = lm_scoring._slice(keys, np.ones(n, np.int64), n * 16)
        found = lm_scoring.Filter(bits, 0, most)
        other = keys | np.uint64(1 << 63)
        assert most == 1 and (found.levels(keys) == 1).all() and (found.levels(other) > 0).mean() < 0.01
    assert (lm_scoring.Filter(b"\xff" * 1024, 0, 3).levels(keys) == 3).all()


def test_bloom_filter_never_understates():
    keys = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
    counts = np.random.default_rng(2).integers(1, 500, 3000)
    bits, pair_bits = bytearray((1 << 18) // 8), 4
    each = len(bits) >> pair_bits
    import pyarrow as pa

    buckets = keys >> np.uint64(60)
    batch = pa.RecordBatch.from_arrays([pa.array([int(b) for b in range(16)], pa.int32())] + [pa.array([x[buckets == b].tobytes() for b in range(16)], pa.binary()) for x in (keys, counts.astype(np.int64))], ["bucket", "keys", "counts"])
    for out in lm_scoring._slices((1 << 18) >> pair_bits)(iter([batch])):
        b = out.column(0)[0].as_py()
        bits[b * each : (b + 1) * each] = out.column(1)[0].as_py()
    found = lm_scoring.Filter(bytes(bits), pair_bits)
    assert (found.levels(keys) >= lm_scoring.quantised(counts)).all()
    assert (found.levels(keys) == lm_scoring.quantised(counts)).mean() > 0.9
    assert (found.levels(keys + np.uint64(1)) > 0).mean() < 0.1


IMAGES = [np.random.default_rng(1).integers(0, 256, (9, 13, 4), np.uint8), np.tile(np.random.default_rng(2).integers(0, 256, (3, 5, 4), np.uint8), (4, 4, 1)), np.zeros((1, 1, 4), np.uint8), np.random.default_rng(3).integers(0, 256, (12, 4), np.uint8)[np.random.default_rng(4).integers(0, 12, (10, 11))]]


@pytest.mark.parametrize("transforms", [t for k in range(4) for t in itertools.permutations(["predictor", "cross", "green", "palette"], k)])
def test_webp_round_trip(transforms):
    for n, image in enumerate(IMAGES):
        for cache, tile in ((0, 0), (3, 2), (8, 0)):
            try:
                data = webp.write(image, transforms, cache_bits=cache, tile=tile, seed=n)
            except ValueError:
                assert "palette" in transforms
                continue
            assert (webp.read(data) == image).all()


def by_hand(*fields):
    """A file from (value, bits) fields, lowest bit first, as the specification of the bit stream lists them."""
    bits = "".join(format(v, f"0{n}b")[::-1] for v, n in fields)
    body = bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk + bytes(8)


def start(width, height):
    return [(0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)]


def one(symbol):
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]  # simple, one symbol, of 8 bits


NO_DISTANCE = [(1, 1), (0, 1), (0, 1), (0, 1)]
# a normal code: the lengths' code gives 1 and 18 a bit each, symbols 11 and 258 get one bit
ELEVEN_AND_COPY_3 = [(0, 1), (0, 4), (0, 3), (1, 3), (0, 3), (1, 3), (0, 1), (1, 1), (0, 7), (0, 1), (1, 1), (127, 7), (1, 1), (97, 7), (0, 1), (1, 1), (10, 7)]


@pytest.mark.parametrize(("fields", "want"), [
    # no transform, no cache, one group; a pixel without bits
    ([*start(1, 1), (0, 1), (0, 1), (0, 1), *one(20), *one(10), *one(30), *one(40), *NO_DISTANCE], [[10, 20, 30, 40]]),
    # two green symbols 7 and 9: bits 1 0 0 1
    ([*start(4, 1), (0, 1), (0, 1), (0, 1), (1, 1), (1, 1), (1, 1), (7, 8), (9, 8), *one(1), *one(2), *one(255), *NO_DISTANCE, (0b1001, 4)], [[1, 9, 2, 255], [1, 7, 2, 255], [1, 7, 2, 255], [1, 9, 2, 255]]),
    # a literal, then length 3 at distance code 2, the pixel to the left
    ([*start(4, 1), (0, 1), (0, 1), (0, 1), *ELEVEN_AND_COPY_3, *one(1), *one(2), *one(3), (1, 1), (0, 1), (0, 1), (1, 1), (0, 1), (1, 1)], [[1, 11, 2, 3]] * 4),
    # subtract-green: red and blue are differences
    ([*start(1, 1), (1, 1), (2, 2), (0, 1), (0, 1), (0, 1), *one(200), *one(100), *one(56), *one(255), *NO_DISTANCE], [[44, 200, 0, 255]]),
    # palette of 2 colours, the second by its difference, eight pixels in a green sample; its own image has no group bit
    ([*start(3, 1), (1, 1), (3, 2), (1, 8), (0, 1), (1, 1), (1, 1), (1, 1), (5, 8), (6, 8), *one(1), *one(2), *one(128), *NO_DISTANCE, (0b10, 2), (0, 1), (0, 1), (0, 1), *one(0b101), *one(0), *one(0), *one(255), *NO_DISTANCE], [[2, 11, 4, 0], [1, 5, 2, 128], [2, 11, 4, 0]]),
    # predictor 1 (left) in one tile of 4 x 4, after the first pixel, whose guess is opaque black
    ([*start(3, 1), (1, 1), (0, 2), (0, 3), (0, 1), *one(1), *one(0), *one(0), *one(255), *NO_DISTANCE, (0, 1), (0, 1), (0, 1), *one(5), *one(3), *one(250), *one(0), *NO_DISTANCE], [[3, 5, 250, 255], [6, 10, 244, 255], [9, 15, 238, 255]]),
])
def test_webp_by_hand(fields, want):
    assert webp.read(by_hand(*fields)).reshape(-1, 4).tolist() == want


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=700), st.integers(1, 40), st.sampled_from([1, 3, 17, 256]))
def test_grey_pictures(data, times, values):
    x = np.frombuffer(data * times, np.uint8) % values if values < 256 else np.frombuffer(data * times, np.uint8)
    payload = x.astype(np.uint8).tobytes().ljust(-(-max(1, len(x)) // 64) * 64, b"\0")
    assert media.decode(media.encode(payload)).tobytes() == payload


def test_chains_of_pictures():
    payload = np.random.default_rng(7).integers(0, 40, 64 * webp.MOST + 128).astype(np.uint8).tobytes()
    assert media.encode(payload).count(b"WEBPVP8L") == 2 and media.decode(media.encode(payload)).tobytes() == payload


def test_media_of_all_documents(spark):
    """Every column of the query against hashlib, zlib and a reader of its own choice for each row."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    stored = {r.doc_id: bytes(r.media) for r in media.store(docs).collect()}
    for r in media.load(media.store(docs)).collect():
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        x = np.frombuffer(padded, np.uint8)
        assert r.feature == f"64x{len(x) // 64};{x.mean():.4f},{x.std():.4f},{(x > 127).mean():.4f}"


def test_webp_refuses_broken_files():
    data = webp.write(IMAGES[0], ("green",))
    grey = webp.write_grey(np.frombuffer(b"All the world is a stage and all of us are players. " * 32, np.uint8), 64)
    with pytest.raises(ValueError):
        webp.read(grey[: len(grey) * 2 // 3])
    for broken in (b"", data[:20], b"RIFF" + data[4:8] + b"WAVE" + data[12:], data[: len(data) // 2]):
        with pytest.raises(ValueError):
            webp.read(broken)


@pytest.mark.parametrize("version", ["1", "2"])
@pytest.mark.parametrize("packed", [True, False])
def test_archives(version, packed):
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    records = [("http://a.example/x y", "1.2.3.4", "20010203040506", "text/html", body + b"<p>one\n\n</p>"), ("dns:a.example", "0.0.0.0", "2001", "text/dns", b"1.2.3.4"), ("http://a.example/2", "1.2.3.4", "20011399000000", "text/html", body)]
    got = list(warc.read_warc(warc.convert(warc.write_arc(records, version), "x.arc", packed=packed)))
    assert [r.head["warc-type"] for r in got] == ["warcinfo", "response", "resource", "response"]
    assert got[1].block == records[0][4] and got[1].head["warc-target-uri"] == "http://a.example/x%20y"
    assert [r.head["warc-date"] for r in got[1:]] == ["2001-02-03T04:05:06Z", "2001-01-01T00:00:00Z", "2001-01-01T00:00:00Z"]
    assert warc.timestamp("20010231") == "2001-02-01T00:00:00Z" and warc.timestamp("20000229120000") == "2000-02-29T12:00:00Z"
    assert warc.payload_facts(got[3]) == (0, "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ")
    with pytest.raises(ValueError):
        list(warc.read_arc(warc.write_arc(records, version)[:-20]))


def test_revisits_point_to_records_that_exist(spark):
    pages = spark.createDataFrame([(k, f"http://a.example/{k}", f"<p>{k % 3}</p>") for k in range(12)], "page_id long, url string, html string")
    records = [r for row in warc.archive(pages).collect() for r in warc.read_warc(bytes(row.content)) if r.head["warc-type"] != "warcinfo"]
    ids = [r.head["warc-record-id"] for r in records]
    by_id = dict(zip(ids, records, strict=True))
    assert len(by_id) == len(records) == 12
    for r in records:
        if r.head["warc-type"] == "revisit":
            first = by_id[r.head["warc-refers-to"]]
            assert first.head["warc-type"] == "response" and first.head["warc-payload-digest"] == r.head["warc-payload-digest"]
    assert {r.page_id: r.refers_to for r in warc.round_trip(pages).collect()} == {k: k % 3 if k > 2 else None for k in range(12)}


def test_levenshtein_trie():
    rng = random.Random(3)
    terms = {"".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))): rng.random() for _ in range(40)}
    trie = toxicity.LexiconTrie(terms)

    def distance(a, b):
        above, row = None, list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                cost = min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y))
                if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                    cost = min(cost, above[j - 2] + 1)
                new.append(cost)
            above, row = row, new
        return row[-1]

    for _ in range(1500):
        word = rng.choice(list(terms))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(word) + 1)
            swapped = word[:k] + word[k : k + 2][::-1] + word[k + 2 :]
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("abcd") + word[k:], word[:k] + rng.choice("abcd") + word[k + 1 :], swapped])
        near = [(distance(word, t), -terms[t], t) for t in terms if (len(t) >= 5 and distance(word, t) <= 1) or word == t]
        want = min(near, default=None)
        assert trie.find(word) == ((want[2], want[0]) if want else None), word


def plain_learn(rows):
    """The lexicon's rules over Python lists."""
    toxic, clean = [t for t, y in rows if y], [t for t, y in rows if not y]
    contexts = defaultdict(set)
    for t in toxic:
        w = ["", *toxicity.WORD.findall(t.lower()), ""]
        for word in set(w[1:-1]):
            k = w.index(word, 1)
            contexts[word].add((w[k - 1], w[k + 1]))
    weights, share = {}, len(toxic) / len(rows)
    for word, found in contexts.items():
        a, b = len(found), sum(word in toxicity.WORD.findall(t.lower()) for t in clean)
        if a < 3:
            continue
        g = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0))
        weight = math.log((a / len(toxic)) / ((b + 0.5) / len(clean)))
        if weight >= math.log(8) and g >= 18 and not word.isdigit():
            weights[word] = weight
    return weights


def test_lexicon_and_scores(spark):
    """Lexicon, curve and scores against plain versions."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(400):
        text = [rng.choice(words) for _ in range(30)]
        if k % 4 == 0:
            text[rng.randrange(30)] = rng.choice(["scoundrel", "moronic", "scoundrel"])
        rows.append((" ".join(text), int(k % 4 == 0)))
    weights, own, slope, intercept = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    assert weights == pytest.approx(plain_learn(rows)) and set(weights) == {"scoundrel", "moronic"} and not own
    docs = spark.createDataFrame([(0, "you scoundrel and scoundrel"), (1, "w1 w2"), (2, "a moornic one"), (3, None)], "doc_id int, text string")
    labels = spark.createDataFrame([(k + 10, y) for k, (_, y) in enumerate(rows)], "doc_id int, toxic int")
    both = docs.unionByName(spark.createDataFrame([(k + 10, t) for k, (t, _) in enumerate(rows)], "doc_id int, text string"))
    got = {r.doc_id: r for r in toxicity.score(both, labels).collect()}
    learned = plain_learn([(t, y) for k, (t, y) in enumerate(rows) if zlib.crc32(str(k + 10).encode()) % 3 != 1])
    evidence = {0: learned["scoundrel"] * 1.5, 1: 0.0, 2: learned["moronic"] * toxicity.FUZZY, 3: 0.0}
    assert {k: got[k].evidence for k in range(4)} == pytest.approx(evidence)
    assert got[0].score > got[2].score > got[1].score == got[3].score and got[0].predicted == 1 and got[1].predicted == 0


def test_toxicity_of_held_out_rows(spark):
    """Precision, recall and ranking on the fold that nothing is learned from."""
    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = toxicity.score(spark.read.parquet(f"{data}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert toxic and sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean)) >= 0.95
    hits = [r.toxic for r in got if r.predicted]
    assert sum(hits) >= 0.9 * len(hits) and sum(hits) >= 0.8 * len(toxic)


def test_quotation_counts_less():
    m = toxicity.Matcher({"scoundrel": 3.0})
    plain, quoted, reported, misspelled = (m.evidence(t)[0] for t in ("You scoundrel there", "The “scoundrel” there", "She said scoundrel", "You scoundrol there"))
    assert plain > misspelled > quoted == reported > 0
    assert m.evidence("sc*undrel")[0] == m.evidence("$coundrel")[0] == misspelled and m.evidence("scoundrel***")[0] == plain


PAGE = """<html><head><title>T</title><script>var a="</p><p>no";</script><style>p{}</style></head><body><header><h2>Site</h2></header><nav><a href=/>Home</a></nav>
<aside class="sidebar"><p>side</p></aside><article><h1>Big &amp; small</h1><p>This is the first of the paragraphs and it is about the way in which we were to be with that.<br>More
 of it</p><div class="ad-slot ad">Buy</div><form><p>Sign up</p></form><ul><li>one point</li><li>two</li></ul><p>Short end.</p><section id="comments"><p>I was here first and it is the best.</p></section></article>
<div class="cookie-notice">We use cookies</div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    want = ["Big & small", "This is the first of the paragraphs and it is about the way in which we were to be with that. More of it", "one point", "two", "Short end."]
    assert html_text.main_text(PAGE) == "\n\n".join(want)
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("just plain text") == "just plain text"


def test_main_text_without_article():
    good = "<p>" + "This is a long paragraph of the text that we have to read and that is about it, and so on for all of us. " * 3 + "</p>"
    page = f"<div><a href=1>Home</a> <a href=2>News</a></div>{good}<h2>Next</h2>{good}<p>ok then</p>{good}<div>All rights</div>"
    text = html_text.main_text(page)
    assert "Next" in text and "ok then" in text and "Home" not in text and "All rights" not in text


SAID = "This is a long paragraph of the text that we have to read and that is about it, and so on for all of us. " * 3


def test_main_text_of_links_inside_an_article():
    """Link-dense blocks inside an article are bad and take short neighbours of their own element with them."""
    page = f"<article><h1>Title</h1><p>{SAID}</p><p>Short line.</p><p>{SAID}</p><div><p><a href=1>One of our other stories</a></p><p>See also</p><p><a href=2>And another one of them</a></p></div></article>"
    assert html_text.main_text(page) == "\n\n".join(["Title", SAID.strip(), "Short line.", SAID.strip()])


def test_main_text_without_article_and_classes():
    """With article elements and class names taken away, most pages give the same text."""
    import duckdb

    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    bare = [re.sub(r'\sclass="[^"]*"', "", re.sub(r"<(/?)article\b", r"<\1div", p)) for p in pages]
    assert sum(html_text.main_text(a) == html_text.main_text(b) for a, b in zip(pages, bare, strict=True)) >= 0.9 * len(pages)


def test_main_text_without_any_good_block():
    assert html_text.main_text("<nav><a href=1>Home</a></nav><div><h2>Quux</h2><p>Foo bar.</p></div><footer>end</footer>") == "Quux\n\nFoo bar."
    assert html_text.main_text("<nav><a href=1>Home</a></nav><form>name</form>") == ""


def test_unclosed_elements_take_linear_time():
    began = time.process_time()
    html_text.main_text("<svg>" * 40_000 + "<p>" + SAID)
    assert time.process_time() - began < 3


def test_pages_of_many_elements_without_article_take_linear_time():
    page = "".join(f"<div><p>{SAID}</p></div><div>x{k}</div>" for k in range(4000))
    began = time.process_time()
    assert html_text.main_text(page).count(SAID.strip()) == 4000
    assert time.process_time() - began < 3


def test_importance_against_plain_counts(spark):
    """Log-ratios and the drawn rows against dictionaries of n-gram counts."""
    rng = random.Random(13)
    rows = [(k, None if k == 5 else " ".join(rng.choice(["The", "house", "runs", "42", "!!", "x9", "over"]) for _ in range(rng.randint(0, 30)))) for k in range(120)]
    labels = [(k, k % 2) for k in range(0, 120, 2)] + [(k, 1) for k in range(1, 120, 4)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), share=0.25).collect()

    def grams(text):
        import xxhash

        tokens = re.findall(r"\w+|[^\w\s]+", text or "")
        h, o = [xxhash.xxh3_64_intdigest(t) >> 16 for t in tokens], [importance._outline(t) for t in tokens]
        keys = h + [1 if a == b else a * 31 + b for a, b in itertools.pairwise(h)] + [(a * 16 + b) * 16 + c + (1 << 50) for a, b, c in zip(o, o[1:], o[2:], strict=False)]
        return [((k * 0x9E3779B97F4A7C15) % (1 << 64)) >> 51 for k in keys]

    good = {k for k, q in labels if q == 1 and zlib.crc32(str(k).encode()) % 2 == 0}
    raw, target = Counter(), Counter()
    for k, t in rows:
        raw.update(grams(t))
        if k in good:
            target.update(grams(t))
    n, m = sum(raw.values()) + 8192, sum(target.values()) + 8192
    for r in got:
        g = grams(rows[r.doc_id][1])
        want = sum(math.log((target[x] + 1) / m) - math.log((raw[x] + 1) / n) for x in g)
        assert r.n_grams == len(g) and r.log_ratio == pytest.approx(want, abs=1e-9) and r.importance == pytest.approx(want * 200 / (len(g) + 10), abs=1e-9)
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    assert sum(r.kept for r in got) == 30 and all(r.kept == (r.gumbel_key >= keys[29] - 1e-6) for r in got)


def test_resampling_separates_and_counts(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["the", "house", "runs", "over", "green", "hills", "and", "sleeps"]) for _ in range(40)) + "."
    bad = lambda: " ".join(rng.choice(["XX", "YY", "ZZ"]) + "!!" for _ in range(40))
    rows = [(k, good() if k % 5 else bad()) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 > 0)) for k in range(0, 400, 3)], "doc_id long, quality int")
    got = importance.resample(docs, labels).collect()
    wrong = sum(r.kept != (r.doc_id % 5 > 0) for r in got)
    assert wrong <= 4
    half = importance.resample(docs, labels, share=0.5).collect()
    assert sum(r.kept for r in half) == 200
    keys = sorted((r.gumbel_key for r in half), reverse=True)
    assert all(r.kept == (r.gumbel_key >= keys[199] - 2e-6) for r in half)
