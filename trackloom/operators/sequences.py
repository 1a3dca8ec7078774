"""Sequence operators that are inherently sequential: Arrow workers, one track (or text pair) at a time."""

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StructField, StructType


def common_blocks(a: str, b: str, gram: int = 4) -> list[tuple[int, int, int]]:
    """(place in a, place in b, size) of the longest common block (the first in a, then in b), recursively left and right
    of it, neighbours that touch joined; ends with (len a, len b, 0). Blocks of `gram` characters and more are searched
    as runs of equal grams, which stand in far fewer places than single characters."""
    grams = [[x[i : i + gram] for i in range(len(x) - gram + 1)] for x in (a, b)]
    long = SequenceMatcher(None, *grams, autojunk=False)
    todo, found = [(0, len(a), 0, len(b))], []
    while todo:
        a0, a1, b0, b1 = todo.pop()
        i, j, n = 0, 0, 0
        if min(a1 - a0, b1 - b0) >= gram:
            i, j, n = long.find_longest_match(a0, a1 - gram + 1, b0, b1 - gram + 1)
            n += gram - 1 if n else 0
        if not n:
            i, j, n = SequenceMatcher(None, a[a0:a1], b[b0:b1], autojunk=False).find_longest_match()
            i, j = i + a0, j + b0
        if n:
            found.append((i, j, n))
            todo += [x for x in ((a0, i, b0, j), (i + n, a1, j + n, b1)) if x[0] < x[1] and x[2] < x[3]]
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            i, j, n = out[-1][0], out[-1][1], out.pop()[2] + n
        out.append((i, j, n))
    return [*out, (len(a), len(b), 0)]


@udtf(returnType=StructType([StructField(n, IntegerType()) for n in ("a", "b", "size")]))
class MatchingBlocks:
    """common_blocks() of two texts, a null one being empty."""

    def eval(self, a: str, b: str):
        yield from common_blocks(a or "", b or "")


def peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Strict local maxima (plateaus: the middle) of at least `height`, higher ones suppressing others that are
    nearer than `distance`; of equals the later one wins."""
    if len(x) < 3:
        return np.zeros(0, int)
    heads = np.r_[0, np.nonzero(np.diff(x))[0] + 1]
    tails = np.r_[heads[1:] - 1, len(x) - 1]
    v = x[heads]
    top = np.zeros(len(v), bool)
    top[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]) & (v[1:-1] >= height)
    found = (heads[top] + tails[top]) // 2
    keep = np.ones(len(found), bool)
    for k in np.argsort(x[found], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(found - found[k]) < distance
            near[k] = False
            keep[near] = False
    return found[keep]


def onset_peaks(x: np.ndarray, target: int, floor_pct: float = 85.0, distance: int = 3) -> np.ndarray:
    """Peaks above a percentile of the positive values, thinned to `target`: of the closest pair (the first such) the
    weaker goes, the left one of equals."""
    positive = x[x > 0]
    found = peaks(x, np.percentile(positive, floor_pct) if len(positive) else 1.0, distance).tolist()
    while len(found) > max(target, 1):
        k = int(np.argmin(np.diff(found)))
        del found[k if x[found[k]] <= x[found[k + 1]] else k + 1]
    return np.array(found, int)


def onsets(frames: DataFrame, keys: list[str], x: str, target: int, floor_pct: float = 85.0, distance: int = 3) -> DataFrame:
    """(keys, k, f, strength) with strength over the track's largest."""
    schema = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys) + ", k int, f int, strength double"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("f")
        values = part[x].to_numpy(float)
        found = onset_peaks(values, target, floor_pct, distance)
        top = values[found].max() if len(found) else 1.0
        out = pd.DataFrame({"k": np.arange(len(found)), "f": part["f"].to_numpy()[found], "strength": values[found] / top})
        for name, value in zip(keys, key, strict=True):
            out.insert(0, name, value)
        return out[[*keys, "k", "f", "strength"]]

    return frames.select(*keys, "f", x).groupBy(*keys).applyInPandas(run, schema)


def align(slots: int, strength: np.ndarray, hold: float = 0.9, skip: float = 0.6, weak: float = 0.25, band: float = 0.2, least: int = 60) -> tuple[list[int | None], dict[str, int], float]:
    """(onset of each slot, counts, cost) of the cheapest monotone alignment within a band around the diagonal.

    A slot matches the next onset (weak ones cost up to `weak`), or holds the last note; onsets may be skipped at a
    cost that grows with their strength, also after the last slot. A row is found at once: what a chain of skips
    costs is a difference of prefix sums, so the best way along the row is a running minimum."""
    n, far = len(strength), 1e9
    if not slots:
        return [], {"match": 0, "hold": 0, "skip": n}, float((skip * (1 - strength)).sum())
    width = max(least, int(band * n))
    drop, soft = skip * (1.0 - strength), weak * (1.0 - strength)
    cum = np.concatenate([[0.0], np.cumsum(drop)])
    row = np.full(n + 1, far)
    row[0] = 0.0
    how = np.zeros((slots + 1, n + 1), np.uint8)
    for i in range(1, slots + 1):
        centre = round(i * n / slots)
        a, b = max(1, centre - width), min(n, centre + width)
        new = np.full(n + 1, far)
        if a <= b:
            match, held = row[a - 1 : b] + soft[a - 1 : b], row[a : b + 1] + hold
            best = np.minimum(match, held)
            along = np.minimum.accumulate(best - cum[a : b + 1]) + cum[a : b + 1]
            how[i, a : b + 1] = np.where(along < best - 1e-9, 3, np.where(match <= held, 1, 2))
            new[a : b + 1] = np.minimum(along, best)
        row = new
    ends = row + cum[n] - cum
    j, i, out = int(np.argmin(ends)), slots, [None] * slots
    counts = {"match": 0, "hold": 0, "skip": 0}
    cost = float(ends[j])
    while i or j:
        step = how[i, j]
        if i and j and step == 1:
            i, j = i - 1, j - 1
            out[i] = j
            counts["match"] += 1
        elif i and step == 2:
            i -= 1
            counts["hold"] += 1
        elif j and step == 3:
            j -= 1
            counts["skip"] += 1
        else:
            counts["skip"] += max(0, j)
            break
    return out, counts, cost


def align_tracks(rows: DataFrame, keys: list[str], slots: str, strengths: str) -> DataFrame:
    """One row per track with a slot count and an array of onset strengths -> (keys, slot, onset, cost, n_match)."""
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", slot int, onset int, cost double, n_match int"

    def run(batches):
        for part in batches:
            for r in part.itertuples(index=False):
                found, counts, cost = align(int(getattr(r, slots)), np.asarray(getattr(r, strengths), float))
                out = pd.DataFrame({"slot": range(len(found)), "onset": pd.array(found, dtype="Int32"), "cost": cost, "n_match": counts["match"]})
                for name in reversed(keys):
                    out.insert(0, name, getattr(r, name))
                yield out

    return rows.select(*keys, slots, strengths).mapInPandas(run, schema)


def butterworth(kind: str, order: int, edges: tuple[float, ...], rate: float) -> np.ndarray:
    """Second-order sections of a digital Butterworth filter: analog poles, prewarped edges, bilinear transform.
    kind: low, high or band; edges in Hz."""
    warped = 2 * rate * np.tan(np.pi * np.array(edges) / rate)
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "low":
        poles, zeros, gain = proto * warped[0], np.zeros(0, complex), warped[0] ** order
    elif kind == "high":
        poles, zeros, gain = warped[0] / proto, np.zeros(order, complex), 1.0
    else:
        half, centre = (warped[1] - warped[0]) / 2, warped[0] * warped[1]
        root = np.sqrt((proto * half) ** 2 - centre + 0j)
        poles, zeros, gain = np.concatenate([proto * half + root, proto * half - root]), np.zeros(order, complex), (2 * half) ** order
    fs2 = 2 * rate
    z_poles = (fs2 + poles) / (fs2 - poles)
    z_zeros = np.concatenate([(fs2 + zeros) / (fs2 - zeros), -np.ones(len(poles) - len(zeros))])
    gain = gain * np.real(np.prod(fs2 - zeros) / np.prod(fs2 - poles))
    # pair conjugates, and zeros as they come
    upper = sorted((p for p in z_poles if p.imag > 1e-12), key=abs)
    real = sorted((p.real for p in z_poles if abs(p.imag) <= 1e-12), key=abs)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=False)]
    z = sorted(z_zeros.real)
    lows, highs = z[: len(z) // 2], z[len(z) // 2 :][::-1]
    sos = [[1.0, -(a + b), a * b, 1.0, p1, p2] for (a, b), (p1, p2) in zip(zip(lows, highs, strict=True), pairs, strict=True)]
    sos = np.array(sos)
    sos[0, :3] *= gain
    return sos


def sos_filter(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x through the sections, forward only."""
    y = np.asarray(x, float)
    for b0, b1, b2, _, a1, a2 in sos:
        out, s1, s2 = np.empty_like(y), 0.0, 0.0
        for k, v in enumerate(y):
            o = b0 * v + s1
            s1, s2 = b1 * v - a1 * o + s2, b2 * v - a2 * o
            out[k] = o
        y = out
    return y


def band_rms(frames: DataFrame, keys: list[str], x: str, kind: str, edges: tuple[float, ...], rate: float, win: int, hop: int) -> DataFrame:
    """(keys, f, rms): zero-phase (forward and backward) band filter, then framed RMS; one track per worker call."""
    sos = butterworth(kind, 4, edges, rate)
    schema = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys) + ", f int, rms double"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        y = part.sort_values("f")[x].to_numpy(float)
        y = sos_filter(sos, sos_filter(sos, y)[::-1])[::-1]
        sums = np.concatenate([[0.0], np.cumsum(y * y)])
        at = np.arange(0, len(y), hop)
        a, b = np.clip(at - win // 2, 0, len(y)), np.clip(at + win // 2, 0, len(y))
        out = pd.DataFrame({"f": np.arange(len(at)), "rms": np.sqrt((sums[b] - sums[a]) / win)})
        for name, value in zip(reversed(keys), reversed(key), strict=True):
            out.insert(0, name, value)
        return out

    return frames.select(*keys, "f", x).groupBy(*keys).applyInPandas(run, schema)


def stft(frames: DataFrame, keys: list[str], x: str, size: int, hop: int, kind: str = "float") -> DataFrame:
    """(keys, block, mag array<kind>): Hann-windowed magnitudes, the track padded by half a window at both ends."""
    window, dtype = np.hanning(size), {"float": np.float32, "double": np.float64}[kind]
    schema = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys) + f", block int, mag array<{kind}>"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        y = np.pad(part.sort_values("f")[x].to_numpy(float), size // 2)
        blocks = np.lib.stride_tricks.sliding_window_view(y, size)[::hop]
        out = [np.abs(np.fft.rfft(blocks[k : k + 4096] * window)).astype(dtype) for k in range(0, len(blocks), 4096)]
        mags = np.concatenate(out) if out else np.zeros((0, size // 2 + 1), dtype)
        table = pd.DataFrame({"block": np.arange(len(mags)), "mag": list(mags)})
        for name, value in zip(reversed(keys), reversed(key), strict=True):
            table.insert(0, name, value)
        return table

    return frames.select(*keys, "f", x).groupBy(*keys).applyInPandas(run, schema)
