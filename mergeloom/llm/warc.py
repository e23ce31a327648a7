"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with some whole records,
followed by a skippable frame with the seek table of the public seekable format
(compressed and decompressed size of every frame).  ``zstd -d`` therefore yields a
plain WARC file, and a reader reaches any frame from the footer alone.  The index
maps a record's identifier to bundle, frame, and offset within the frame.

Pages with equal payloads are stored once: the smallest id is a response, the
others revisit it (WARC 1.1, identical-payload-digest) and keep its HTTP header.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _sizes, slices
from .shared import filesystem, materialize, ship, workspace

#: Of the seekable format: skippable frame with the seek table, and its last bytes.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in a frame; bytes of a bundle after which the next begins; frames that a task reads.
FRAME_BYTES, BUNDLE_BYTES, READ_FRAMES = 512 << 10, 512 << 20, 32
LEVEL = 3


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; with ``refers_to`` a revisit without the payload."""
    header = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = header if refers_to is not None else header + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        lines.insert(3, "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def page_of(value: bytes | None) -> int | None:
    return int(digits) if value is not None and (digits := value.strip(b"<>").rpartition(b":")[2]) else None


def records(data: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes], bytes]]:
    """(offset, length, headers, block) of the records in a frame's data."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
        start = end + 4
        stop = start + int(headers[b"content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut off")
        yield at, stop + 4 - at, headers, data[start:stop]
        at = stop + 4


class BundleWriter:
    """Frames, then the seek table; a frame in memory at a time."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        import zstandard

        self.out, self.most = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame, self.table, self.written = bytearray(), [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset in it) of the record."""
        if self.frame and len(self.frame) + len(data) > self.most:
            self.flush()
        place = len(self.table), len(self.frame)
        self.frame += data
        return place

    def flush(self) -> None:
        if self.frame:
            packed = self.zstd.compress(bytes(self.frame))
            self.out.write(packed)
            self.table.append((len(packed), len(self.frame)))
            self.written += len(packed)
            self.frame = bytearray()

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *entry) for entry in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class BundleReader:
    """Frames of a bundle by number: ``source`` has seek and read."""

    def __init__(self, source, size: int) -> None:
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags & 0x7C:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        source.seek(size - 9 - n * width)
        table = source.read(n * width)
        self.sizes = [struct.unpack_from("<II", table, i * width) for i in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, i: int) -> bytes:
        self.source.seek(self.starts[i])
        return self.zstd.decompress(self.source.read(self.sizes[i][0]), max_output_size=self.sizes[i][1])


def write(pages: DataFrame, to: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of ``pages`` to bundles in the folder ``to``; returns the index.

    Index rows: page_id, bundle, frame, at (offset in the frame), bytes.  Payloads
    are the column in UTF-8 (or binary as it is), null ones empty.  Of equal
    payloads of at least ``min_bytes`` the smallest id is the response, the rest
    revisit it; rows that repeat that id are responses each.  Rows with a null id
    are responses with an empty identifier.  An empty table writes no bundle.
    """
    spark = pages.sparkSession
    ship(spark)
    schema = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int64()), ("at", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        store, folder = filesystem(to)
        writer, path = None, ""
        for batch in batches:
            for part in slices(batch, _sizes(batch.column(2)), 8 << 20):
                rows = []
                for page_id, url, payload, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if writer is None:
                        store.create_dir(folder, recursive=True)
                        path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                        writer = BundleWriter(store.open_output_stream(path, compression=None))
                    data = record(page_id, url, payload, base32_sha1(payload), first, date)
                    rows.append((page_id, path, *writer.add(data), len(data)))
                    if writer.written > BUNDLE_BYTES:
                        writer.close()
                        writer = None
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        if writer is not None:
            writer.close()

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    # Ids and digests alone are shuffled to find the copies; bodies only to meet what was found.
    keys = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", F.unhex(F.sha1("payload")).alias("digest"))
    copied = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("count")).where("count > 1")
    revisits = keys.join(copied, "digest").where("page_id > first").select("page_id", "digest", "first")
    # An id may repeat with other payloads, so the digest takes part; equal rows are one revisit.
    joined = rows.withColumn("digest", F.unhex(F.sha1("payload"))).join(revisits.distinct(), ["page_id", "digest"], "left")
    index = joined.select("page_id", "url", "payload", "first").mapInArrow(run, "page_id long, bundle string, frame long, at long, bytes long")
    return materialize(index, f"{to}/index")


def read(index: DataFrame, root: str, payload: bool = True) -> DataFrame:
    """All records of the bundles that ``index`` names, whole frames at a time.

    Rows (page_id, url, record_type, payload_bytes, payload_digest, refers_to,
    payload); payload is null for revisits, and for all without ``payload``.
    Responses are held against their digest; a mismatch raises ValueError.
    """
    ship(index.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        store, _ = filesystem(root)
        for batch in batches:
            for path, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(path) as source:
                    bundle = BundleReader(source, source.size())
                    for f in range(first, last + 1):
                        rows = [parsed(h, b, payload) for _, _, h, b in records(bundle.frame(f))]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    frames = index.groupBy("bundle").agg(F.max("frame").alias("last"))
    starts = frames.select("bundle", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(READ_FRAMES))).alias("first"), "last")
    parts = starts.select("bundle", "first", F.least("last", F.col("first") + READ_FRAMES - 1).alias("last"))
    return parts.repartition("bundle", "first").mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def parsed(headers: dict[bytes, bytes], block: bytes, payload: bool) -> tuple:
    """A record's row, checked."""
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
    digest = headers[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
    kind = headers[b"warc-type"].decode()
    if kind == "response" and (len(body) != size or base32_sha1(body) != digest):
        raise ValueError(f"record {headers[b'warc-record-id'].decode()} doesn't have the payload it names")
    url = headers.get(b"warc-target-uri")
    return page_of(headers[b"warc-record-id"]), url and url.decode(), kind, size, digest, page_of(headers.get(b"warc-refers-to")), body if payload and kind == "response" else None


def fetch(index: DataFrame, root: str, ids: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records of some ids, by random access: only their frames are read; repeated ids come back once for each record."""
    ship(index.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("record", pa.binary())])

    def run(batches):
        store, _ = filesystem(root)
        for batch in batches:
            held, bundle, source, frame, data = "", None, None, -1, b""
            for page_id, path, f, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != held:
                    if source is not None:
                        source.close()
                    source = store.open_input_file(path)
                    held, bundle, frame = path, BundleReader(source, source.size()), -1
                if f != frame:
                    frame, data = f, bundle.frame(f)
                yield pa.RecordBatch.from_arrays([pa.array([page_id]), pa.array([data[at : at + size]], pa.binary())], schema=schema)
            if source is not None:
                source.close()

    wanted = index.join(ids.select(F.col(id_col).cast("long").alias("page_id")).distinct(), "page_id", "left_semi").select("page_id", "bundle", "frame", "at", "bytes")
    return wanted.repartition("bundle").sortWithinPartitions("bundle", "frame", "at").mapInArrow(run, "page_id long, record binary")


def archive(pages: DataFrame, **columns) -> tuple[DataFrame, str]:
    """``write`` to a new shared folder; (index, folder)."""
    to = workspace(pages.sparkSession, "warc")
    return write(pages, to, **columns), to
