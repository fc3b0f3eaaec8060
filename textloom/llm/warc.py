"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about FRAME_BYTES; a bundle ends in a skippable frame
with the seek table of the public seekable format (compressed and plain size of every frame). The
index maps each record to its bundle, frame and offset in the plain frame, so that one record is
read by decompressing one frame. A task's bundles have names of their own: what a lost task has
written is never in the index.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import hot_join, map_arrow, shared_dir, written

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 128 << 20, 3
#: Payloads below this size are never revisits.
MIN_REVISIT_BYTES = 0

# Fixed values of the seekable format and of the WARC format.
SKIPPABLE_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

INDEX = "page_id long, bundle string, frame int, frame_at long, frame_bytes long, offset long, length long, record_type string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    value = name.rpartition(":")[2].rstrip(">")
    return None if value == "null" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response, or, with refers_to, a revisit with the headers but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    safe_url = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Target-URI: {safe_url}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        *([] if refers_to is None else [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """Headers, HTTP headers and body of the record at a place of a plain frame, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(line.split(": ", 1) for line in lines)
    begin, size = end + 4, int(head["Content-Length"])
    block = data[begin : begin + size]
    if data[begin + size : begin + size + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} doesn't end where it should")
    http_end = block.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in block[:http_end].decode().split("\r\n")[1:])
    return head, http, block[http_end + 4 :], begin + size + 4


class BundleWriter:
    def __init__(self, out: io.RawIOBase):
        self.out, self.table, self.plain, self.at = out, [], [], 0
        self.size, self.packer = 0, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.pending: list[tuple] = []

    def add(self, key: tuple, data: bytes) -> list[tuple]:
        """Index rows (key, frame, its place, its size, offset, length) of the frame that this ends, if it does."""
        self.pending.append((key, self.size, len(data)))
        self.plain.append(data)
        self.size += len(data)
        return self.flush() if self.size >= FRAME_BYTES else []

    def flush(self) -> list[tuple]:
        if not self.plain:
            return []
        packed = self.packer.compress(b"".join(self.plain))
        self.out.write(packed)
        rows = [(key, len(self.table), self.at, len(packed), offset, length) for key, offset, length in self.pending]
        self.table.append((len(packed), self.size))
        self.at += len(packed)
        self.plain, self.pending, self.size = [], [], 0
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        entries = b"".join(struct.pack("<II", *sizes) for sizes in self.table)
        footer = entries + struct.pack("<IBI", len(self.table), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(footer)) + footer)
        self.out.close()
        return rows


def seek_table(file) -> list[tuple[int, int, int]]:
    """(place, packed size, plain size) of every frame of an open bundle, from its footer."""
    size = file.seek(0, 2)
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEK_MAGIC or flags:
        raise ValueError("no seek table at the end of the bundle")
    file.seek(size - 9 - 8 * n)
    entries, out, at = file.read(8 * n), [], 0
    for packed, plain in struct.iter_unpack("<II", entries):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(file, at: int, packed: int) -> bytes:
    file.seek(at)
    return zstandard.ZstdDecompressor().decompress(file.read(packed))


def read_record(bundle: str, frame_at: int, frame_bytes: int, offset: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """One record by its index row: one frame is read, no other."""
    store, path = fs.FileSystem.from_uri(bundle)
    with store.open_input_file(path) as file:
        return parse(read_frame(file, frame_at, frame_bytes), offset)[:3]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every page to bundles in folder, a URI that executors can write to; the index of all records.

    A null html is an empty payload. Of pages with equal payloads, that of least page_id is a
    response and the others revisit it; rows that share this id are all responses, and so are equal
    payloads that have no page_id at all. Empty tables give no bundle. Other columns are not read.
    """
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.sha2("html", 256))
    # Only payloads that come more than once are joined to anything; rows of a frequent one stay where they are.
    first = rows.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    first = written(first, "payloads")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= MIN_REVISIT_BYTES), F.col("first"))
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = hot_join(rows, first, "key", "n", total).select("page_id", "url", "html", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        writer, bundle = None, ""

        def index(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([k[0] for k, *_ in found], pa.int64()), pa.array([bundle] * len(found), pa.string()), pa.array([r[1] for r in found], pa.int32()),
                *(pa.array([r[c] for r in found], pa.int64()) for c in (2, 3, 4, 5)), pa.array([k[1] for k, *_ in found], pa.string()),
            ], ["page_id", "bundle", "frame", "frame_at", "frame_bytes", "offset", "length", "record_type"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle, writer = f"{folder}/{name}", BundleWriter(store.open_output_stream(f"{root}/{name}", compression=None))
                if found := writer.add((page_id, "response" if refers_to is None else "revisit"), record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)):
                    yield index(found)
                if writer.at >= BUNDLE_BYTES:
                    yield index(writer.close())
                    writer = None
        if writer is not None:
            yield index(writer.close())

    return written(map_arrow(rows, run, INDEX), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the bundles that the index names, parsed and checked: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(bundle)
                with store.open_input_file(path) as file:
                    for at, packed, plain in seek_table(file):
                        data, place, out = read_frame(file, at, packed), 0, []
                        if len(data) != plain:
                            raise ValueError(f"frame at {at} of {bundle} has {len(data)} bytes, not {plain}")
                        while place < plain:
                            head, http, body, place = parse(data, place)
                            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                            refers = head.get("WARC-Refers-To")
                            if refers is None and (payload_digest(body) != digest or len(body) != int(http["Content-Length"])):
                                raise ValueError(f"damaged payload of {head['WARC-Record-ID']} in {bundle}")
                            out.append((_page(head["WARC-Record-ID"]), int(http["Content-Length"]), digest, head["WARC-Type"], refers and _page(refers)))
                        columns = list(zip(*out, strict=True)) or [[]] * 5
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return map_arrow(index.select("bundle").distinct(), run, RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes every page to archives and reads all records back; columns and cases as in write_archives and read_archives. An empty table gives an empty result."""
    return read_archives(write_archives(pages, shared_dir(pages.sparkSession, "warc")))
