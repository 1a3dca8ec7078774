"""Media columns: payloads stored as lossless WebP images and read back as arrays of samples.

A payload is the samples, 8 bits each, of grey pictures WIDTH wide. One picture has at most the height that the format
allows, 1 MiB; a longer payload is a chain of pictures, file after file."""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import webp
from trackloom.llm.common import lean

UNIT = WIDTH = 64


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled up with zeros to a positive multiple of UNIT, and their number before."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT or (UNIT if not raw else 0)), len(raw)


def encode(payload: bytes) -> bytes:
    """A payload as one grey picture after another."""
    x, most = np.frombuffer(payload, np.uint8), WIDTH * webp.MOST
    return b"".join(webp.write_grey(x[at : at + most], WIDTH) for at in range(0, len(x), most))


def decode(media: bytes) -> np.ndarray:
    """The rows of samples of the pictures, which have to be grey and without transparency."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        image = webp.read(media[at : at + size])
        grey = np.ascontiguousarray(image[..., 1])
        if not ((image[..., 0] == grey).all() and (image[..., 2] == grey).all() and (image[..., 3] == 255).all()):
            raise ValueError("the picture isn't grey")
        out.append(grey)
        at += size
    return np.concatenate(out) if len(out) > 1 else out[0]


def features(rows: np.ndarray) -> str:
    """Width, height, mean, standard deviation and share of samples above 127."""
    return f"{rows.shape[1]}x{rows.shape[0]};{rows.mean():.4f},{rows.std():.4f},{(rows > 127).mean():.4f}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            rows = [payload_of(t.as_py()) for t in part.column(1)]
            media = [encode(p) for p, _ in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in rows], pa.int64()), pa.array([len(p) for p, _ in rows], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "payload_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for size, media in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            data = media.as_buffer().to_pybytes()
            rows = decode(data)
            payload = rows.tobytes()
            if len(payload) != size:
                raise ValueError("a payload isn't as long as it was")
            out.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), features(rows)))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        more = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *more], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, media: every text as lossless pictures, whole.

    A null text is stored like an empty one, as 64 zero bytes; null ids and repeated rows stay as they are; an empty
    table gives no rows; further columns are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(_store), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, media binary")


def load(media: DataFrame) -> DataFrame:
    """What store() returns -> digests of payload and stored form, and the features of the pixel array, all from the
    stored bytes. Broken media raise."""
    id_type = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(lean(_read), f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
