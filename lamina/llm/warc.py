"""WARC archives as seekable Zstandard bundles.

``write_archives`` groups records into independent Zstandard frames, appends the seek table of the seekable
format (a skippable frame that names every frame's compressed and plain size) and returns an index: record id
to bundle, frame, offset within the frame's plain bytes, and length. ``read_archives`` reads whole bundles by
their seek tables; ``read_records`` fetches single records through the index, decompressing only their frames.

Of records with equal payloads (SHA-1) the one with the largest id is the response, others are revisits of it.
Who is whose copy is found on (digest, id) alone: digests are counted with map-side aggregation, only digests
that occur twice or more go on, and that table is broadcast if it has at most ``BROADCAST_ROWS`` rows (counted),
else joined by shuffle under a salt, so that a digest that a third of all rows share is spread.

Recovery: a bundle gets a new name in every attempt of a task, and only the index of attempts that succeeded is
kept (as Parquet in the shared folder), so a lost executor leaves at most files that no index names.

Defined cases. A null html is an empty payload. A null url becomes ``urn:page:<id>``. Rows repeated with the
response's id are responses too. A null id is never the largest one unless all ids of the payload are null. An
empty table writes no bundle. A payload beyond a frame's size is a frame of its own. The input's other columns
are left out.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import materialise, scratch, tidy

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
BROADCAST_ROWS = 100_000
SALTS = 16
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "2024-01-01T00:00:00Z"
_INDEX = "page_id bigint, record_id string, bundle string, frame int, offset bigint, length bigint"


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[str, bytes]:
    """Record id and bytes of a WARC 1.1 record."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = record_id(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url is not None else f'urn:page:{page_id}'}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if refers_to is not None:
            head += [f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in a frame's plain bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        yield head, data[start:stop]
        at = stop + 4


def describe(head: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """Page id, payload bytes, payload digest, record type and the page it refers to; a response's payload is measured, not believed."""
    http, _, payload = block.partition(b"\r\n\r\n")
    page = int(head["X-Page-Id"]) if "X-Page-Id" in head else None
    if head["WARC-Type"] == "response":
        return page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response", None
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    refers = head.get("X-Refers-To-Page")
    return page, size, head["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", None if refers is None else int(refers)


class BundleWriter:
    """One bundle file: frames, then the seek table."""

    def __init__(self, sink: io.RawIOBase, level: int = 3):
        self.sink, self.zstd = sink, zstandard.ZstdCompressor(level=level)
        self.sizes: list[tuple[int, int]] = []
        self.pending: list[bytes] = []
        self.held = self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset in it."""
        if self.held and self.held + len(record) > FRAME_BYTES:
            self.flush()
        at = len(self.sizes), self.held
        self.pending.append(record)
        self.held += len(record)
        return at

    def flush(self) -> None:
        if self.pending:
            packed = self.zstd.compress(b"".join(self.pending))
            self.sink.write(packed)
            self.sizes.append((len(packed), self.held))
            self.written += self.held
            self.pending, self.held = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.sink.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.sink.close()


class BundleReader:
    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(8 * n, size - 9 - 8 * n)
        at = 0
        self.frames: list[tuple[int, int, int]] = []
        for k in range(n):
            packed, plain = struct.unpack_from("<II", table, 8 * k)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)


def mark_copies(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, revisit, refers_to``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    digests = rows.filter(F.octet_length("payload") >= min_bytes).select("page_id", F.unhex(F.sha1("payload")).alias("digest"))
    shared = digests.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1").select("digest", "largest")
    shared = materialise(shared, "warc-shared")
    keyed = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.unhex(F.sha1("payload"))))
    if shared.count() <= BROADCAST_ROWS:
        marked = keyed.join(F.broadcast(shared), "digest", "left")
    else:
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return marked.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("largest")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write the bundles under ``path`` (default: a new folder in the shared one); the index of all records."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    system, name = fs.FileSystem.from_uri(path)
    system.create_dir(name, recursive=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_fs, folder = fs.FileSystem.from_uri(path)
        bundle = writer = None
        for batch in batches:
            rows = []
            for page_id, url, payload, revisit, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "revisit", "refers_to")), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle, writer = f"{path}/{name}", BundleWriter(out_fs.open_output_stream(f"{folder}/{name}", compression=None))
                page = page_id.as_py()
                rid, record = build_record(page, url.as_py(), payload.as_py(), refers_to.as_py(), revisit.as_py())
                frame, offset = writer.add(record)
                rows.append((page, rid, bundle, frame, offset, len(record)))
                if writer.written >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "record_id", "bundle", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    return materialise(mark_copies(pages, min_bytes).mapInArrow(run, _INDEX), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the bundles that ``index`` names: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for bundle in batch.column("bundle").to_pylist():
                reader = BundleReader(bundle)
                for k in range(len(reader.frames)):
                    rows = [describe(*r) for r in parse_records(reader.frame(k))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                    )

    bundles = materialise(index.select("bundle").distinct(), "bundles")
    bundles = bundles.repartitionByRange(max(1, bundles.count()), "bundle")  # a stated number, which adaptive execution leaves alone
    return bundles.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def read_records(wanted: DataFrame) -> DataFrame:
    """Rows of the index to their records' bytes (``record_id, record``), one frame at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, b""
        reader = None
        for batch in batches:
            ids, records = [], []
            for r in batch.to_pylist():
                if last != (r["bundle"], r["frame"]):
                    if last is None or last[0] != r["bundle"]:
                        reader = BundleReader(r["bundle"])
                    held, last = reader.frame(r["frame"]), (r["bundle"], r["frame"])
                ids.append(r["record_id"])
                records.append(held[r["offset"] : r["offset"] + r["length"]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(records, pa.binary())], ["record_id", "record"])

    rows = wanted.select("record_id", "bundle", "frame", "offset", "length").sortWithinPartitions("bundle", "frame", "offset")
    return rows.mapInArrow(run, "record_id string, record binary")


@tidy("archives")
def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives and read them back; they are deleted when the result is a table."""
    return read_archives(write_archives(pages))
