"""Lossless WebP (the VP8L bit stream, as its public specification describes it): a reader of everything the format
has, and two writers.

read(): prefix codes (simple, normal, several groups chosen by an entropy image), back-references, colour cache, and
the four transforms (predictor, cross-colour, subtract-green, palette with bundled pixels). Where only the green
channel takes bits, as in grey pictures after subtract-green and in palette pictures, prefix codes are decoded as
arrays: the symbol and the length of a token are looked up at every bit of a block as if one began there, and the
tokens that do begin are found by following the lengths, with doubled steps.
write_grey(): samples for bulk storage, as a grey picture: subtract-green, or a palette with bundled pixels for few
values; back-references; prefix codes of the picture's own counts; all but the choice of matches in array operations.
A colour cache is never shorter there: a sample's own code is as short as that of its place in the cache.
write(): literals, back-references and colour cache under prefix codes of any shape, after any of the transforms; it
serves small images and tests.
"""

from functools import lru_cache

import numpy as np

# fixed values of the format
SIGNATURE, LENGTH_CODES, DISTANCE_CODES, CODE_ORDER = 0x2F, 24, 40, (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR, MOST = 0x1E35A7BD, 16384
#: Distance codes 1-120 stand for near pixels (x to the left, y above), nearest first, then by |x|, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class Bits:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, len(data) * 8

    def read(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > self.end:
            raise ValueError("the bit stream ends early")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[first:last], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        """The next n <= 15 bits, zeros after the end."""
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 3], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def rest(self, n: int) -> int:
        """The next n bits or more as one number, zeros after the end."""
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + n // 8 + 2], "little") >> (self.at & 7)


class Code:
    """A canonical prefix code: symbols by (length, code), codes read with their first bit lowest."""

    def __init__(self, lengths: dict[int, int]):
        self.symbols = sorted((n, s) for s, n in lengths.items() if n) or [(0, 0)]
        self.single, self.widest = None, self.symbols[-1][0]
        if len(self.symbols) == 1:
            self.single, self.widest = self.symbols[0][1], 0
        elif sum(1 << (self.widest - n) for n, _ in self.symbols) != 1 << self.widest:
            raise ValueError("a prefix code isn't complete")
        self._table = None

    def table(self) -> np.ndarray:
        """symbol << 4 | length, by the next `widest` bits."""
        if self._table is None:
            n, symbols = (np.array(x, np.int64) for x in zip(*self.symbols, strict=True))
            if self.single is not None:
                n = n * 0
            # codes in their order fill the numbers of `widest` bits in order; their first bit is the highest there
            self._table = np.repeat(symbols << 4 | n, 1 << (self.widest - n)).astype(np.int32)[_reversed(self.widest)]
        return self._table

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        entry = int(self.table()[bits.peek(self.widest)])
        bits.at += entry & 15
        if bits.at > bits.end:
            raise ValueError("the bit stream ends early")
        return entry >> 4


@lru_cache(maxsize=16)
def _reversed(width: int) -> np.ndarray:
    """The numbers of `width` bits, each with its bits in reverse order."""
    out = np.zeros(1, np.int64)
    for k in range(width):
        out = np.concatenate([out, out | 1 << (width - 1 - k)]) if k else np.array([0, 1 << (width - 1)])
    return out


@lru_cache(maxsize=256)
def _code(lengths: tuple[int, ...]) -> Code:
    return Code({s: n for s, n in enumerate(lengths) if n})


def _read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths = {bits.read(8 if wide else 1): 1}
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    short = {CODE_ORDER[k]: bits.read(3) for k in range(4 + bits.read(4))}
    code = _code(tuple(short.get(k, 0) for k in range(19)))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    table, mask = code.table().tolist(), (1 << code.widest) - 1
    rest, used = bits.rest(size * 14), 0
    lengths, s, last = {}, 0, 8
    while s < size and left > 0:
        left -= 1
        entry = table[rest & mask]
        n, w = entry >> 4, entry & 15
        rest >>= w
        used += w
        if n < 16:
            if n:
                lengths[s] = last = n
            s += 1
            continue
        base, extra = ((3, 2), (3, 3), (11, 7))[n - 16]
        times = base + (rest & ((1 << extra) - 1))
        rest >>= extra
        used += extra
        if s + times > size:
            raise ValueError("more code lengths than symbols")
        if n == 16:
            lengths.update(dict.fromkeys(range(s, s + times), last))
        s += times
    bits.at += used
    if bits.at > bits.end:
        raise ValueError("the bit stream ends early")
    return Code(lengths)


def _extended(bits: Bits, prefix: int) -> int:
    """The number that a length or distance prefix and its extra bits stand for."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


#: Bytes of the stream that are decoded at once.
BLOCK = 1 << 14
_EXTRA = np.array([max(0, (p - 2) >> 1) for p in range(DISTANCE_CODES)], np.uint64)
_FIRST = np.array([p + 1 if p < 4 else ((2 + (p & 1)) << ((p - 2) >> 1)) + 1 for p in range(DISTANCE_CODES)], np.int64)


def _low(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n lowest bits."""
    return x & ((np.uint64(1) << n) - np.uint64(1))


def _copies(x: np.ndarray, distance: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix of the length, then the bits after it) -> length, distance code and bits used, for each token."""
    prefix, x = x
    more = _EXTRA[prefix]
    length = _FIRST[prefix] + _low(x, more).astype(np.int64)
    x = x >> more
    entry = distance.table()[_low(x, np.uint64(distance.widest)).astype(np.int64)]
    width = (entry & 15).astype(np.uint64)
    x = x >> width
    last = _EXTRA[entry >> 4]
    return length, _FIRST[entry >> 4] + _low(x, last).astype(np.int64), (more + width + last).astype(np.int64)


def _read_green(bits: Bits, green: Code, distance: Code, n: int, width: int) -> np.ndarray:
    """n green samples, of literals and back-references, where the other channels take no bits."""
    if green.single is not None:
        if green.single > 255:
            raise ValueError("a back-reference leaves the image")
        return np.full(n, green.single, np.uint8)
    table, mask = green.table(), np.uint64((1 << green.widest) - 1)
    data = bits.data + bytes(16)
    symbols, lengths, codes, done = [], [], [], 0
    while done < n:
        if bits.at >= bits.end:
            raise ValueError("the bit stream ends early")
        first = bits.at >> 3
        count = min(BLOCK, len(bits.data) - first)
        # the next 57 bits or more at each bit
        ahead = (np.ndarray((count,), "<u8", data, first, (1,))[:, None] >> np.arange(8, dtype=np.uint64)).reshape(-1)
        entry = table[(ahead & mask).astype(np.int64)]
        step, symbol, size = entry & 15, entry >> 4, count * 8
        far = np.nonzero(symbol > 255)[0]
        if len(far):
            step[far] += _copies((symbol[far] - 256, ahead[far] >> step[far].astype(np.uint64)), distance)[2].astype(np.int32)
        # where the token after this one begins, and the 2nd, 4th, 8th after it; all ends of the block are one place
        after = np.full(size + 1, size, np.int32)
        np.minimum(np.arange(size, dtype=np.int32) + step, size, out=after[:size])
        jumps = [after]
        for _ in range(3):
            jumps.append(jumps[-1][jumps[-1]])
        at, found, jump = bits.at - first * 8, [], memoryview(jumps[-1])
        while at < size:
            found.append(at)
            at = jump[at]
        found = np.array(found, np.int32)
        for jump in reversed(jumps[:-1]):
            found = np.stack([found, jump[found]], 1).reshape(-1)
        found = found[found < size]
        new, length, code = symbol[found], np.ones(len(found), np.int64), np.zeros(len(found), np.int64)
        far = np.nonzero(new > 255)[0]
        if len(far):
            at = found[far]
            length[far], code[far], _ = _copies((new[far] - 256, ahead[at] >> (table[(ahead[at] & mask).astype(np.int64)] & 15).astype(np.uint64)), distance)
        ends = np.cumsum(length)
        keep = int(np.searchsorted(ends, n - done)) + 1  # tokens up to the one that fills the image
        symbols.append(new[:keep])
        lengths.append(length[:keep])
        codes.append(code[:keep])
        last = min(keep, len(found)) - 1
        done += int(ends[last])
        bits.at = first * 8 + int(found[last]) + int(step[found[last]])
    if done > n:
        raise ValueError("a back-reference leaves the image")
    if bits.at > bits.end:
        raise ValueError("the bit stream ends early")
    symbol, length, code = map(np.concatenate, (symbols, lengths, codes))
    start = np.cumsum(length) - length
    out = bytearray(n)
    view, plain = np.frombuffer(out, np.uint8), symbol < 256
    view[start[plain]] = symbol[plain]
    for k in np.nonzero(~plain)[0].tolist():
        a, size, d = int(start[k]), int(length[k]), _distance(int(code[k]), width)
        if d > a:
            raise ValueError("a back-reference leaves the image")
        out[a : a + size] = out[a - d : a - d + size] if d >= size else (out[a - d : a] * (size // d + 1))[:size]
    return view


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as (height, width, 4) RGBA."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("too large a colour cache")
    tile, which, groups = 0, None, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        meta = _read_pixels(bits, (width + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile, False)
        which = meta[..., 0].astype(np.int64) << 8 | meta[..., 1]
        groups = int(which.max()) + 1
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    codes = [[_read_code(bits, size) for size in sizes] for _ in range(groups)]
    n = width * height
    green, red, blue, alpha, distance = codes[0]
    if groups == 1 and not cache_bits and None not in (red.single, blue.single, alpha.single) and green.widest + distance.widest < 30:
        rgba = np.empty((n, 4), np.uint8)
        rgba[:] = red.single, 0, blue.single, alpha.single
        rgba[:, 1] = _read_green(bits, green, distance, n, width)
        return rgba.reshape(height, width, 4)
    out: list[int] = []  # ARGB
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift = 32 - cache_bits
    while len(out) < n:
        at = len(out)
        group = codes[0] if which is None else codes[which[at // width >> tile, at % width >> tile]]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 256 + LENGTH_CODES:
            length, code = _extended(bits, s - 256), 0
            code = _extended(bits, group[4].read(bits))
            distance = _distance(code, width)
            if distance > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            if distance >= length:
                new = out[at - distance : at - distance + length]
            else:
                part = out[at - distance :]
                new = (part * (length // distance + 1))[:length]
        else:
            if cache is None:
                raise ValueError("no colour cache")
            new = [cache[s - 256 - LENGTH_CODES]]
        out += new
        if cache is not None:
            for p in new:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
    argb = np.array(out, np.uint32)
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24], 1).astype(np.uint8).reshape(height, width, 4)


def _average(a, b):
    return (a.astype(np.int64) + b) >> 1


def predict(mode: int, left, top, top_left, top_right) -> np.ndarray:
    """The predicted RGBA of a pixel by one of the 14 modes."""
    l, t, tl, tr = (np.asarray(p, np.int64) for p in (left, top, top_left, top_right))
    if mode == 11:
        # the side whose step from the corner is the smaller one continues
        to_left, to_top = np.abs(t - tl).sum(), np.abs(l - tl).sum()
        return l if to_left < to_top else t
    if mode == 12:
        return np.clip(l + t - tl, 0, 255)
    if mode == 13:
        a = _average(l, t)
        return np.clip(a + ((a - tl) / 2).astype(np.int64), 0, 255)
    plain = {0: lambda: np.array([0, 0, 0, 255]), 1: lambda: l, 2: lambda: t, 3: lambda: tr, 4: lambda: tl, 5: lambda: _average(_average(l, tr), t), 6: lambda: _average(l, tl), 7: lambda: _average(l, t), 8: lambda: _average(tl, t), 9: lambda: _average(t, tr), 10: lambda: _average(_average(l, tl), _average(t, tr))}
    return plain.get(mode, plain[0])()


def _predictor(img: np.ndarray, modes: np.ndarray, tile: int, sign: int) -> np.ndarray:
    """sign 1: residuals -> pixels; sign -1: pixels -> residuals."""
    h, w, _ = img.shape
    out = img.copy()
    known = out if sign == 1 else img
    for y in range(h):
        for x in range(w):
            if not y:
                guess = np.array([0, 0, 0, 255]) if not x else known[y, x - 1]
            elif not x:
                guess = known[y - 1, x]
            else:
                # right of the last column stands the first pixel of the same row
                corner = known[y - 1, x + 1] if x + 1 < w else known[y, 0]
                guess = predict(int(modes[y >> tile, x >> tile]), known[y, x - 1], known[y - 1, x], known[y - 1, x - 1], corner)
            out[y, x] = (img[y, x].astype(np.int64) + sign * np.asarray(guess, np.int64)) & 255
    return out


def _cross_colour(img: np.ndarray, factors: np.ndarray, tile: int, sign: int) -> np.ndarray:
    """factors: RGBA tiles holding red-to-blue, green-to-blue, green-to-red as signed bytes."""
    h, w, _ = img.shape
    f = np.repeat(np.repeat(factors, 1 << tile, 0), 1 << tile, 1)[:h, :w].astype(np.int8).astype(np.int64)
    red_blue, green_blue, green_red = f[..., 0], f[..., 1], f[..., 2]
    signed = img.astype(np.int8).astype(np.int64)
    red = img[..., 0] + sign * (green_red * signed[..., 1] >> 5)
    own_red = (red if sign == 1 else img[..., 0].astype(np.int64)) & 255
    own_red = own_red.astype(np.uint8).astype(np.int8).astype(np.int64)
    blue = img[..., 2] + sign * ((green_blue * signed[..., 1] >> 5) + (red_blue * own_red >> 5))
    out = img.copy()
    out[..., 0], out[..., 2] = red & 255, blue & 255
    return out


def _green(img: np.ndarray, sign: int) -> np.ndarray:
    out = img.copy()
    out[..., 0] += np.uint8(sign & 255) * img[..., 1]
    out[..., 2] += np.uint8(sign & 255) * img[..., 1]
    return out


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _from_palette(img: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    shift = _bundle(len(table))
    each = 8 >> shift
    g = img[..., 1]
    index = np.stack([g >> (k * each) & ((1 << each) - 1) for k in range(1 << shift)], -1).reshape(len(g), -1)[:, :width]
    full = np.zeros((256, 4), np.uint8)
    full[: len(table)] = table
    return full[index]


def read(data: bytes) -> np.ndarray:
    """A lossless WebP file as (height, width, 4) RGBA samples. ValueError if it isn't one or is broken."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image")
        at += 8 + (int.from_bytes(data[at + 4 : at + 8], "little") + 1 & ~1)
    size = int.from_bytes(data[at + 4 : at + 8], "little")
    bits = Bits(data[at + 8 : at + 8 + size])
    if bits.read(8) != SIGNATURE:
        raise ValueError("no lossless image")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("unknown version")
    undo, full = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            tiles = _read_pixels(bits, (width + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile, False)
            if kind == PREDICTOR:
                undo.append(lambda img, tiles=tiles, tile=tile: _predictor(img, tiles[..., 1], tile, 1))
            else:
                undo.append(lambda img, tiles=tiles, tile=tile: _cross_colour(img, tiles, tile, 1))
        elif kind == SUBTRACT_GREEN:
            undo.append(lambda img: _green(img, 1))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(_read_pixels(bits, n, 1, False)[0], 0, dtype=np.uint8)
            undo.append(lambda img, table=table, width=width: _from_palette(img, table, width))
            width = (width + (1 << _bundle(n)) - 1) >> _bundle(n)
    img = _read_pixels(bits, width, height, True)
    for step in reversed(undo):
        img = step(img)
    assert img.shape[1] == full
    return img


class BitWriter:
    """Collects bits, lowest first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def put_code(self, code: int, n: int) -> None:
        """A prefix code: its first bit is its highest."""
        self.put(int(_reversed(n)[code]) if n else 0, n)

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def _container(stream: bytes) -> bytes:
    chunk = b"VP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk


def _put_lengths(out: BitWriter, lengths: list[int]) -> None:
    """A normal code's lengths, runs with the repeat codes."""
    ops, s = [], 0
    while s < len(lengths):
        run = 1
        while s + run < len(lengths) and lengths[s + run] == lengths[s]:
            run += 1
        n, rest = lengths[s], run
        if n:
            ops.append((n, 0, 0))
            rest -= 1
        while rest:
            if n and rest >= 3:
                k = min(rest, 6)
                ops.append((16, k - 3, 2))
            elif not n and rest >= 11:
                k = min(rest, 138)
                ops.append((18, k - 11, 7))
            elif not n and rest >= 3:
                k = min(rest, 10)
                ops.append((17, k - 3, 3))
            else:
                k = 1
                ops.append((n, 0, 0))
            rest -= k
        s += run
    short = _code_lengths({k: sum(o[0] == k for o in ops) for k in range(19)}, 7)
    out.put(0, 1)
    order = [short.get(k, 0) for k in CODE_ORDER]
    while len(order) > 4 and not order[-1]:
        order.pop()
    out.put(len(order) - 4, 4)
    for n in order:
        out.put(n, 3)
    out.put(0, 1)
    codes = _canonical(short)
    for symbol, extra, width in ops:
        out.put_code(*codes[symbol])
        out.put(extra, width)


def _code_lengths(counts: dict[int, int], most: int) -> dict[int, int]:
    """Huffman code lengths of at most `most` bits (counts are halved until they fit)."""
    counts = {s: c for s, c in counts.items() if c}
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    while True:
        leaves = sorted((c, s) for s, c in counts.items())
        n = len(leaves)
        # nodes: the leaves in order, then the sums as they are made, which never become smaller
        weight, parent, leaf, inner = [c for c, _ in leaves], [0] * (2 * n - 1), 0, n
        for made in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if leaf < n and (inner == made or weight[leaf] <= weight[inner]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, inner = inner, inner + 1
                total += weight[k]
                parent[k] = made
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= most:
            return {s: depth[k] for k, (_, s) in enumerate(leaves)}
        counts = {s: (c + 1) // 2 for s, c in counts.items()}


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length); a single symbol takes no bits."""
    symbols = sorted((n, s) for s, n in lengths.items() if n)
    if len(symbols) < 2:
        return {s: (0, 0) for _, s in symbols}
    out, code, last = {}, 0, symbols[0][0]
    for n, s in symbols:
        code <<= n - last
        last = n
        out[s] = (code, n)
        code += 1
    return out


def _put_symbol_code(out: BitWriter, lengths: dict[int, int], size: int) -> None:
    symbols = [s for s, n in sorted(lengths.items()) if n]
    if len(symbols) <= 2 and all(s < 256 for s in symbols):
        symbols = symbols or [0]
        out.put(1, 1)
        out.put(len(symbols) - 1, 1)
        out.put(1, 1)
        for s in symbols:
            out.put(s, 8)
    else:
        _put_lengths(out, [lengths.get(s, 0) for s in range(size)])


#: Back-references of write_grey have SHORTEST samples at least, found where SEED samples in a row repeat.
SHORTEST, SEED, LONGEST = 24, 8, 4096


def _repeats(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, distance) of stretches that repeat what stands `distance` before, none overlapping."""
    n = len(x) - SEED + 1
    if n < SHORTEST:
        return []
    seeds = np.ndarray((n,), "<u8", x.tobytes(), 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort((seeds >> np.uint64(48)).astype(np.uint16) if n <= 1 << 17 else seeds, kind="stable")
    same = seeds[order[1:]] == seeds[order[:-1]]
    distance = np.zeros(n, np.int64)  # to the nearest earlier place with the same samples, 0: none
    distance[order[1:][same]] = (order[1:] - order[:-1])[same]
    heads = np.nonzero(np.diff(distance, prepend=-1))[0]
    ends = np.append(heads[1:], n)
    long = (distance[heads] > 0) & (ends - heads > SHORTEST - SEED)
    out, done = [], 0
    for a, b, d in zip(heads[long].tolist(), (ends[long] + SEED - 1).tolist(), distance[heads[long]].tolist(), strict=True):
        a = max(a, done)
        if b - a >= SHORTEST:
            out.append((a, b, d))
            done = b
    return out


@lru_cache(maxsize=64)
def _near_codes(width: int) -> dict[int, int]:
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}


def _put_green(head: BitWriter, plane: np.ndarray, width: int) -> bytes:
    """head, then the codes and tokens of a picture whose pixels differ in green only (red and blue 0, alpha 255)."""
    literal, near, copies = np.ones(len(plane), bool), _near_codes(width), []
    for start, end, d in _repeats(plane):
        literal[start:end] = False
        for a in range(start, end, LONGEST):
            copies.append((a, _prefix(min(end - a, LONGEST)), _prefix(near.get(d, d + len(NEAR)))))
    at = np.nonzero(literal)[0]
    symbols = plane[at].astype(np.int64)
    counts, far = dict(enumerate(np.bincount(symbols, minlength=256).tolist())), {}
    for _, (length, _, _), (d, _, _) in copies:
        counts[256 + length] = counts.get(256 + length, 0) + 1
        far[d] = far.get(d, 0) + 1
    lengths, far_lengths = _code_lengths(counts, 13), _code_lengths(far, 13)
    head.put(0, 2)  # no colour cache, one group of codes
    _put_symbol_code(head, lengths, 256 + LENGTH_CODES)
    for value in (0, 0, 255):
        _put_symbol_code(head, {value: 1}, 256)
    _put_symbol_code(head, far_lengths, DISTANCE_CODES)
    codes, far_codes = _canonical(lengths), _canonical(far_lengths)
    code, size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, (c, n) in codes.items():
        if s < 256:
            code[s], size[s] = int(_reversed(n)[c]) if n else 0, n
    values, sizes = code[symbols], size[symbols]
    if copies:
        more, wide = [], []
        for _, (length, x, xn), (d, y, yn) in copies:
            token = BitWriter()
            token.put_code(*codes[256 + length])
            token.put(x, xn)
            token.put_code(*far_codes[d])
            token.put(y, yn)
            more.append(token.value)
            wide.append(token.n)
        order = np.argsort(np.concatenate([at, [a for a, _, _ in copies]]), kind="stable")
        values = np.concatenate([values, np.array(more, np.uint64)])[order]
        sizes = np.concatenate([sizes, np.array(wide, np.int64)])[order]
    return _packed(head, values, sizes)


def _packed(head: BitWriter, values: np.ndarray, sizes: np.ndarray) -> bytes:
    """The bits of head, then those of the values, of at most 64 each, as bytes."""
    lead = -(-head.n // 64)
    values = np.concatenate([np.frombuffer(head.value.to_bytes(lead * 8, "little"), "<u8"), values])
    sizes = np.concatenate([np.full(lead, 64), sizes])
    sizes[lead - 1] = head.n - 64 * (lead - 1)
    ends = np.cumsum(sizes)
    start = ends - sizes
    word, shift = start >> 6, (start & 63).astype(np.uint64)
    out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
    heads = np.nonzero(np.diff(word, prepend=-1))[0]
    out[word[heads]] = np.bitwise_or.reduceat(values << shift, heads)
    # what the last value of a word has beyond it
    last = np.append(heads[1:], len(word)) - 1
    over = last[(shift[last] > 0) & (ends[last] > (word[last] + 1) * 64)]
    out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return out.tobytes()[: -(-int(ends[-1]) // 8)]


def write_grey(samples: np.ndarray, width: int) -> bytes:
    """A lossless WebP file of a grey picture; samples: its bytes row by row, a positive multiple of width."""
    out, height = BitWriter(), len(samples) // width
    out.put(SIGNATURE, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 1 + 3)  # alpha isn't used, version
    out.put(1, 1)
    values = np.nonzero(np.bincount(samples, minlength=256))[0]
    if len(values) > 16:
        out.put(SUBTRACT_GREEN, 2)
        plane = samples
    else:
        out.put(PALETTE, 2)
        out.put(len(values) - 1, 8)
        steps = np.zeros((1, len(values), 4), np.uint8)
        steps[0, :, :3] = np.diff(values, prepend=0).astype(np.uint8)[:, None]
        steps[0, 0, 3] = 255
        _put_pixels(out, steps, False)
        shift = _bundle(len(values))
        each, short = 8 >> shift, (width + (1 << shift) - 1) >> shift
        place = np.zeros(256, np.uint8)
        place[values] = np.arange(len(values))
        full = np.zeros((height, short << shift), np.uint8)
        full[:, :width] = place[samples].reshape(height, width)
        bundled = np.zeros((height, short), np.uint8)
        for k in range(1 << shift):
            bundled |= full[:, k :: 1 << shift] << np.uint8(k * each)
        width, plane = short, bundled.reshape(-1)
    out.put(0, 1)
    return _container(_put_green(out, plane, width))


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits, their number) of a length or distance code from 1."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def _tokens(argb: list[int], width: int, cache_bits: int, references: bool) -> list[tuple]:
    """Greedy back-references of at least 3 pixels, cache hits and literals."""
    out, seen, at = [], {}, 0
    cache, shift = ([None] * (1 << cache_bits) if cache_bits else None), 32 - cache_bits
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}
    while at < len(argb):
        length, found = 0, seen.get(tuple(argb[at : at + 3])) if references else None
        if found is not None:
            while at + length < len(argb) and length < 4096 and argb[found + length] == argb[at + length]:
                length += 1
        if length >= 3:
            distance = at - found
            out.append(("copy", length, near.get(distance, distance + len(NEAR))))
        else:
            length, p = 1, argb[at]
            slot = (CACHE_FACTOR * p & 0xFFFFFFFF) >> shift if cache else 0
            out.append(("cache", slot) if cache and cache[slot] == p else ("pixel", p))
        for k in range(at, at + length):
            if cache:
                cache[(CACHE_FACTOR * argb[k] & 0xFFFFFFFF) >> shift] = argb[k]
            if references and k + 3 <= len(argb):
                seen[tuple(argb[k : k + 3])] = k
        at += length
    return out


def _put_pixels(out: BitWriter, img: np.ndarray, main: bool, cache_bits: int = 0, references: bool = True, tile: int = 0) -> None:
    """tile: with it, the image has two groups of codes that take turns from tile to tile."""
    height, width, _ = img.shape
    x = img.astype(np.int64)
    argb = (x[..., 3] << 24 | x[..., 0] << 16 | x[..., 1] << 8 | x[..., 2]).reshape(-1).tolist()
    tokens = _tokens(argb, width, cache_bits, references)
    out.put(1 if cache_bits else 0, 1)
    out.put(cache_bits, 4 if cache_bits else 0)
    which = np.zeros((1, 1), np.int64)
    if main:
        out.put(1 if tile else 0, 1)
        if tile:
            out.put(tile - 2, 3)
            th, tw = (height + (1 << tile) - 1) >> tile, (width + (1 << tile) - 1) >> tile
            which = np.add.outer(np.arange(th), np.arange(tw)) % 2
            _put_pixels(out, np.stack([which * 0, which, which * 0, which * 0], -1).astype(np.uint8), False)
    groups, at, counts = int(which.max()) + 1, 0, [[{} for _ in range(5)] for _ in range(2)]
    placed = []
    for token in tokens:
        g = int(which[at // width >> tile, at % width >> tile]) if tile else 0
        if token[0] == "pixel":
            p = token[1]
            symbols, length = [(0, p >> 8 & 255), (1, p >> 16 & 255), (2, p & 255), (3, p >> 24)], 1
        elif token[0] == "cache":
            symbols, length = [(0, 256 + LENGTH_CODES + token[1])], 1
        else:
            (a, ax, an), (b, bx, bn), length = _prefix(token[1]), _prefix(token[2]), token[1]
            symbols = [(0, 256 + a, ax, an), (4, b, bx, bn)]
        for kind, s, *_ in symbols:
            counts[g][kind][s] = counts[g][kind].get(s, 0) + 1
        placed.append((g, symbols))
        at += length
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    codes = []
    for g in range(groups):
        lengths = [_code_lengths(c, 15) for c in counts[g]]
        for n, size in zip(lengths, sizes, strict=True):
            _put_symbol_code(out, n, size)
        codes.append([_canonical(n) for n in lengths])
    for g, symbols in placed:
        for kind, s, *extra in symbols:
            out.put_code(*codes[g][kind][s])
            out.put(*(extra or (0, 0)))


def write(rgba: np.ndarray, transforms: tuple[str, ...] = (), *, cache_bits: int = 0, references: bool = True, tile: int = 0, seed: int = 0) -> bytes:
    """A lossless WebP file. transforms: any of predictor, cross, green, palette, in the order they are applied;
    predictor modes and cross-colour factors are drawn by the seed."""
    rng, out, img = np.random.default_rng(seed), BitWriter(), rgba
    out.put(SIGNATURE, 8)
    out.put(img.shape[1] - 1, 14)
    out.put(img.shape[0] - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    for name in transforms:
        h, w, _ = img.shape
        out.put(1, 1)
        if name == "green":
            out.put(SUBTRACT_GREEN, 2)
            img = _green(img, -1)
        elif name == "palette":
            colours, index = np.unique(img.reshape(-1, 4), axis=0, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            out.put(PALETTE, 2)
            out.put(len(colours) - 1, 8)
            steps = colours.copy()
            steps[1:] -= colours[:-1]
            _put_pixels(out, steps[None], False)
            shift = _bundle(len(colours))
            each, short = 8 >> shift, (w + (1 << shift) - 1) >> shift
            full = np.zeros((h, short << shift), np.int64)
            full[:, :w] = index.reshape(h, w)
            packed = sum(full.reshape(h, short, 1 << shift)[..., k] << (k * each) for k in range(1 << shift))
            img = np.zeros((h, short, 4), np.uint8)
            img[..., 1], img[..., 3] = packed, 255
        else:
            out.put(PREDICTOR if name == "predictor" else CROSS_COLOUR, 2)
            out.put(0, 3)
            tiles = np.zeros(((h + 3) >> 2, (w + 3) >> 2, 4), np.uint8)
            if name == "predictor":
                tiles[..., 1] = rng.integers(0, 14, tiles.shape[:2])
                img = _predictor(img, tiles[..., 1], 2, -1)
            else:
                tiles[..., :3] = rng.integers(0, 256, (*tiles.shape[:2], 3))
                img = _cross_colour(img, tiles, 2, -1)
            _put_pixels(out, tiles, False)
    out.put(0, 1)
    _put_pixels(out, img, True, cache_bits, references, tile)
    return _container(out.bytes())
