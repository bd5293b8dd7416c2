"""A deterministic sharded WARC writer, and a reader for what it writes.

Pages are dealt into ranges of their id whose borders come from a hash sample, sorted inside them, and
written as gzip members, one to a record; a file is closed when its compressed size reaches the
limit, so the same table gives the same files, byte for byte, however tasks run. Headers and digests
are made anew from the payload. Of pages with equal payloads of ``min_bytes`` or more that with the
largest id is written as response, the others as revisits that refer to it.

The html crosses the network once. Which page a payload belongs to is found from digests alone (an
aggregate that combines before its shuffle, so a payload that a third of the pages share is one row
per task), and revisits are sent to the writer as narrow rows that sort just before their page.

A null html is an empty payload; a null url is an empty target; a null id sorts first and is the
response of a payload only if no page with an id has it. Pages that repeat id and payload are all
what the first is. Other columns are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import stored
from fleetfold.llm.files import borders, read_files, shard_count, shard_of, write_sharded

MIN_BYTES = 1000
FILE_BYTES = 64 << 20
SHARD_ROWS = 10_000
# No clock takes part: the time of a record is that of the crawl if known, else this.
DATE = "1970-01-01T00:00:00Z"
RECORDS = "page_id BIGINT, url STRING, payload_bytes BIGINT, payload_digest STRING, record_type STRING, refers_to BIGINT, payload BINARY"
_READ = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def owners(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Pages (page_id, sha1) that repeat a payload, with the page that keeps it (refers_to)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digests = stored(
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n"))
        .filter(F.col("n") >= min_bytes)
        .select("page_id", "sha1"),
        "digests",
    )
    shared = digests.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    found = digests.join(shared, "sha1").filter(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.distinct()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One compressed record. A revisit keeps the HTTP header, with the length, but not the payload."""
    sha1 = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c for c in url if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[3:3] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    plain = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(plain, compresslevel=6, mtime=0)


def parse_record(plain: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of one record."""
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind = fields["WARC-Type"]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return number("X-Page-ID"), fields["WARC-Target-URI"], length, digest, kind, number("X-Refers-To-Page-ID"), payload if kind == "response" else None


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, each unpacked, one in memory at a time."""
    unpack, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(size)
        rest = b""
        if not data:
            if parts:
                raise ValueError("truncated archive")
            return
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            rest, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []


def write_warc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, shard_rows: int = SHARD_ROWS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) below a folder every executor can reach; returns the manifest."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    shards = shard_count(pages.count(), shard_rows)
    edges = borders(pages, "page_id", shards)
    none = lambda kind: F.lit(None).cast(kind)
    revisits = owners(pages, min_bytes).select("page_id", F.lit(0).alias("kind"), none("string").alias("url"), none("string").alias("html"), "sha1", "refers_to")
    wide = pages.select("page_id", F.lit(1).alias("kind"), "url", "html", none("string").alias("sha1"), none("long").alias("refers_to"))
    rows = revisits.unionByName(wide).withColumn("shard", shard_of(F.col("page_id"), edges))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at: tuple | None = None
        known: dict[str, int] = {}
        shard, number, size, held = None, 0, 0, None
        for batch in batches:
            for page_id, kind, url, html, sha1, refers_to, s in zip(*[c.to_pylist() for c in batch.columns]):
                if (s, page_id) != at:
                    at, known = (s, page_id), {}
                if kind == 0:
                    known[sha1] = refers_to
                    continue
                if held is not None:  # the piece before this record: is it the last of its file?
                    full = s != shard or size >= file_bytes
                    yield shard, number, held, 1, 0, full
                    number, size = (0, 0) if s != shard else (number + 1, 0) if full else (number, size)
                payload = (html or "").encode("utf-8", "surrogatepass")
                owner = known.get(hashlib.sha1(payload).hexdigest()) if known else None
                held, shard = record(page_id, url or "", payload, owner, owner is not None), s
                size += len(held)
        if held is not None:
            yield shard, number, held, 1, 0, True

    return write_sharded(rows, folder, shards, ["page_id", "kind", "url", "html"], encode, ".warc.gz")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives that a manifest lists."""

    def decode(stream: io.RawIOBase, row: dict) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for plain in members(stream):
            held.append(dict(zip(_READ.names, parse_record(plain))))
            size += len(plain)
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=_READ)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=_READ)

    return read_files(manifest, folder, decode, RECORDS)
