"""Legacy web archives: ARC files (both versions of their header line) converted to WARC, and WARC read back.

An ARC file starts with a version block and holds records of one header line, whose last field declares the length,
and that many bytes. The converter splits lines by the file's version, reads the declared lengths, and makes up what
WARC asks for: record ids (UUIDs derived from url, date, place and digest, so that reruns agree), W3C timestamps from
digits, record and content types, block and payload digests.

On the cluster archives are rows (archive, content); they are written to and read from the shared folder by Spark's
own writer, so a lost executor's part is written again.
"""

import base64
import calendar
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import cut, fresh_path, lean, small_or_not

# fixed values: the fields of the header line by the version of the file, as its version block announces them
FIELDS = {
    "1": ("url", "ip", "date", "type", "length"),
    "2": ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "file", "length"),
}
TITLES = {"1": "URL IP-address Archive-date Content-type Archive-length", "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:trackloom:legacy-archive")
ARCHIVE_BYTES = 8 << 20
EPOCH = "20000101000000"


@dataclass(slots=True)
class Record:
    """A record of either format: header fields by lower-case name, and the block."""

    head: dict[str, str]
    block: bytes
    offset: int = 0
    extra: dict = field(default_factory=dict)


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _plain(data: bytes) -> bytes:
    """data, unpacked if it is a chain of gzip members."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(out)


# ---- ARC

def write_arc(records: list[tuple[str, str, str, str, bytes]], version: str = "1", name: str = "legacy.arc") -> bytes:
    """An ARC file of (url, ip, 14-digit date, content type, block) records."""
    inner = f"{version} 0 trackloom\n{TITLES[version]}\n\n".encode()
    lead = f"filedesc://{name} 0.0.0.0 {EPOCH} text/plain"
    out = [f"{lead} {len(inner)}\n".encode() if version == "1" else f"{lead} 200 - - 0 {name} {len(inner)}\n".encode(), inner, b"\n"]
    size = sum(map(len, out))
    for url, ip, date, kind, block in records:
        url, kind = quote(url, safe="%/:=&?~#+!$,;'@()*[]") or "-", kind.replace(" ", "") or "-"
        more = "" if version == "1" else f" 200 - - {size} {name}"
        part = f"{url} {ip} {date} {kind}{more} {len(block)}\n".encode() + block + b"\n"
        size += len(part)
        out.append(part)
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[Record]:
    """The records after the version block. ValueError where a line or a declared length can't be right."""
    data = _plain(data)
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"a header line at byte {at} doesn't end")
        words = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not words[-1].isdigit():
            raise ValueError(f"no length in the header line at byte {at}")
        size, start = int(words[-1]), end + 1
        if start + size > len(data):
            raise ValueError(f"the record at byte {at} declares {size} bytes, {len(data) - start} are left")
        block = data[start : start + size]
        if names is None:
            if not words[0].startswith("filedesc:"):
                raise ValueError("no version block")
            found = re.match(rb"\s*(\d+)", block)
            names = FIELDS.get(found[1].decode() if found else "")
            if names is None:
                raise ValueError("unknown version of the format")
        else:
            if len(words) < len(names):
                raise ValueError(f"{len(words)} fields in the header line at byte {at}")
            # an url with blanks has more words: what is over belongs to it
            over = len(words) - len(names)
            yield Record(dict(zip(names, [" ".join(words[: over + 1]), *words[over + 1 :]], strict=True)), block, at)
        at = start + size


# ---- WARC

def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its empty line) and payload of an HTTP message."""
    for mark in (b"\r\n\r\n", b"\n\n"):
        if (k := block.find(mark)) >= 0:
            return block[: k + len(mark)], block[k + len(mark) :]
    return block, b""


def timestamp(digits: str) -> str:
    """20010203040506 -> 2001-02-03T04:05:06Z; what is missing or out of range (also the 31st of a shorter month) is
    taken as the earliest."""
    parts = [digits[0:4], digits[4:6], digits[6:8], digits[8:10], digits[10:12], digits[12:14]]
    low, high, found = (1, 1, 1, 0, 0, 0), (9999, 12, 31, 23, 59, 59), []
    for k, (p, a, b) in enumerate(zip(parts, low, high, strict=True)):
        n, last = int(p) if p.isdecimal() else a, calendar.monthrange(*found)[1] if k == 2 else b
        found.append(n if a <= n <= last else a)
    return "{:04d}-{:02d}-{:02d}T{:02d}:{:02d}:{:02d}Z".format(*found)


def warc_record(head: list[tuple[str, str]], block: bytes, packed: bool = True) -> bytes:
    """One record, a gzip member of its own if packed."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head), f"Content-Length: {len(block)}", "", ""]
    whole = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    return gzip.compress(whole, 1, mtime=0) if packed else whole


def place_id(name: str, record: Record, sha: str) -> str:
    """A record's id from its place in a file."""
    return str(uuid.uuid5(NAMESPACE, f"{name} {record.offset} {record.head['url']} {record.head['date']} {sha}"))


def convert(arc: bytes, name: str, *, identify: Callable[[Record, str], tuple[str | None, str | None]] = lambda record, sha: (None, None), packed: bool = True) -> bytes:
    """The WARC file of an ARC file. identify: for a record and the digest of its payload, its id (None: made up from
    its place) and the id of the record that already has this payload (None: there is none); a record with the latter
    becomes a revisit, which keeps its HTTP head only."""
    info = f"software: trackloom\r\nformat: WARC File Format 1.1\r\ndescription: converted from {name}\r\n".encode()
    out = [warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"), ("WARC-Date", timestamp(EPOCH)), ("Content-Type", "application/warc-fields")], info, packed)]
    for record in read_arc(arc):
        is_http = record.block[:5] == b"HTTP/"
        head, payload = http_parts(record.block) if is_http else (b"", record.block)
        sha = digest(payload)
        (own, first), block = identify(record, sha), record.block
        kind = "revisit" if first else "response" if is_http else "resource"
        lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{own or place_id(name, record, sha)}>"), ("WARC-Date", timestamp(record.head["date"])), ("WARC-Target-URI", record.head["url"])]
        if re.fullmatch(r"[0-9a-fA-F:.]+", record.head["ip"]) and record.head["ip"] != "0.0.0.0":
            lines.append(("WARC-IP-Address", record.head["ip"]))
        if first:
            block = head
            lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{first}>"), ("X-Payload-Length", str(len(payload)))]
        lines += [("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response" if is_http else record.head["type"])]
        out.append(warc_record(lines, block, packed))
    return b"".join(out)


def read_warc(data: bytes) -> Iterator[Record]:
    """The records of a WARC file, packed or not. ValueError where it is broken."""
    data = _plain(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(end, at)].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size, start = int(head["content-length"]), end + 4
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where it says")
        yield Record(head, data[start : start + size], at)
        at = start + size + 4


def payload_facts(record: Record) -> tuple[int, str]:
    """Bytes and digest of a record's full payload; those of a response are measured and must agree."""
    stated = record.head["warc-payload-digest"].removeprefix("sha1:")
    if record.head["warc-type"] == "revisit":
        return int(record.head["x-payload-length"]), stated
    payload = http_parts(record.block)[1] if record.head["content-type"].startswith("application/http") else record.block
    if digest(payload) != stated:
        raise ValueError("a payload isn't what its digest says")
    return len(payload), stated


# ---- pages as archives

KEY = re.compile(rb"X-Record-Key: (\S*)\r\n")


def _token(key: str | None) -> str:
    """A key as one word without blanks: null is empty."""
    return "" if key is None else "k" + quote(key, safe="")


def _key(block: bytes) -> str | None:
    token = KEY.search(block)[1].decode()
    return unquote(token[1:]) if token else None


def record_id(token: str, sha: str) -> str:
    """The id of the page with this key and payload: what a revisit of it has to point to."""
    return str(uuid.uuid5(NAMESPACE, f"page {token} {sha}"))


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, url, html, refers_to), keys as text -> converted archives of about ARCHIVE_BYTES."""
    waiting: list[tuple] = []
    refers: dict[tuple[str, str], str] = {}
    size = 0

    def close() -> pa.RecordBatch:
        name = f"part-{digest(b''.join(w[4][:200] for w in waiting))}.arc"

        def identify(record: Record, sha: str) -> tuple[str | None, str | None]:
            token = KEY.search(record.block)[1].decode()
            first = refers.get((token, sha))
            return (record_id(token, sha), None) if first is None else (None, record_id(first, sha))

        content = convert(write_arc(waiting, "1", name), name, identify=identify)
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["archive", "content"])

    for batch in batches:
        for key, url, page, first in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            payload, token = (page or "").encode(), _token(key)
            if first is not None:
                refers[token, digest(payload)] = _token(first)
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Record-Key: {token}\r\nContent-Length: {len(payload)}\r\n\r\n"
            waiting.append((url or "about:blank", "0.0.0.0", EPOCH, "text/html", head.encode() + payload))
            size += len(payload)
            if size >= ARCHIVE_BYTES:
                yield close()
                waiting, refers, size = [], {}, 0
    if waiting:
        yield close()


INDEX = {"key": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "record_id": pa.binary(), "refers_id": pa.binary()}


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def raw(name: str | None) -> bytes | None:
        return uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).bytes if name else None

    for batch in batches:
        for content in batch.column(0):
            rows = []
            for record in read_warc(content.as_buffer().to_pybytes()):
                head = record.head
                if head["warc-type"] in ("response", "revisit"):
                    rows.append((_key(record.block), *payload_facts(record), head["warc-type"], raw(head["warc-record-id"]), raw(head.get("warc-refers-to"))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(INDEX.values())], list(INDEX))


def archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages -> (archive, content): every page as a record of an ARC file, converted to WARC. Of pages with equal
    payloads those with the smallest id are responses, the others revisits of it."""
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    sha = F.unhex(F.sha1("html"))
    ids = rows.select("key", sha.alias("sha"))
    first = ids.groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = ids.join(first, "sha").filter((F.col("key") > F.col("first")) | F.col("key").isNull() & F.col("first").isNotNull()).select(F.col("key").alias("_key"), F.col("sha").alias("_sha"), "first").distinct()
    told = rows.join(small_or_not(later), F.col("key").eqNullSafe(F.col("_key")) & (sha == F.col("_sha")), "left")
    return told.select(F.col("key").cast("string").alias("key"), "url", "html", F.col("first").cast("string").alias("first")).mapInArrow(lean(_archives), "archive string, content binary")


def index(archives: DataFrame) -> DataFrame:
    """(archive, content) -> key, payload_bytes, payload_digest, record_type, record_id, refers_id of every page record,
    keys as text, ids as the 16 bytes of their UUIDs."""
    return archives.select("content").mapInArrow(lean(_index), "key string, payload_bytes long, payload_digest string, record_type string, record_id binary, refers_id binary")


def round_trip(pages: DataFrame, *, id_col: str = "page_id", **names: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from archives in the
    shared folder; refers_to is the key of the record that WARC-Refers-To names.

    Null and empty pages have an empty payload, which is deduplicated like any other; null urls become about:blank;
    a null id sorts after all others; ids of any type that casts to text and back may hold any characters; rows that
    repeat an id and a payload are one record stored again, with its id, and all responses, or all revisits; an empty
    table gives no rows; further columns are not read."""
    spark = pages.sparkSession
    path = fresh_path(spark, "archives")
    archive(pages, id_col=id_col, **names).write.parquet(path)
    id_type = pages.schema[id_col].dataType.simpleString()
    out = cut(index(spark.read.schema("archive string, content binary").parquet(path)))
    # only records that are pointed to are looked up: one row for each payload that occurs again
    wanted = out.filter("refers_id IS NOT NULL").select(F.col("refers_id").alias("id")).distinct()
    found = cut(out.filter("record_type = 'response'").join(small_or_not(wanted), F.col("record_id") == F.col("id")).groupBy("id").agg(F.min("key").alias("refers_to")))
    out = out.join(small_or_not(found), F.col("refers_id") == F.col("id"), "left")
    return out.select(F.col("key").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::INT >> (5 * (3 - i % 4))::INT) & 31) + 1)::INT, 1)) AS chars FROM p)
SELECT page_id, payload_bytes, array_to_string(chars, '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM b
"""
