"""Token-id files: blocks of coded ids, each checksummed, with a footer that names blocks and documents.

A file holds the ids of a range of documents in ascending doc_id order:
  magic; groups, each a prior and then its coded blocks; footer; footer length (8 bytes); magic.
The footer is five arrays, each after its length: per group the prior's bytes and the number of
blocks (unsigned 32-bit each), per block coded bytes, ids and CRC-32 of the ids (unsigned 32-bit
each), per document doc_id (signed 64-bit), whether it is null, and ids (unsigned 64-bit). A file is
written under a name of its own and is part of the result only if the task that wrote it succeeded.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import id_coder, vocab_ids
from textloom.llm.common import map_arrow, shared_dir, text_or_empty, written

MAGIC = b"TLID0002"
END_ID = 1
#: Blocks that are coded together and share a prior.
LANES = 8192

FILES = "part int, path string, documents long, ids long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class IdFileWriter:
    def __init__(self, out):
        self.out, self.groups, self.sizes, self.doc_ids, self.counts = out, [], [], [], []
        self.held: list[bytes] = []
        self.held_ids = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: packed unsigned 16-bit."""
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 2)
        self.held.append(ids)
        self.held_ids += len(ids) // 2
        if self.held_ids >= LANES * id_coder.BLOCK:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u2")
        group = LANES * id_coder.BLOCK
        whole = len(ids) if last else len(ids) // group * group
        for at in range(0, whole, group):
            blocks = [ids[k : k + id_coder.BLOCK] for k in range(at, min(at + group, whole), id_coder.BLOCK)]
            prior, coded = id_coder.encode_blocks(blocks)
            self.groups.append((len(prior), len(blocks)))
            self.out.write(prior)
            self.out.write(b"".join(coded))
            self.sizes += [(len(c), len(block), id_coder.checksum(block)) for block, c in zip(blocks, coded, strict=True)]
        self.held = [ids[whole:].tobytes()]
        self.held_ids = len(ids) - whole

    def close(self) -> int:
        """Ids in the file."""
        self._flush(last=True)
        groups, sizes = (np.array(rows, "<u4").tobytes() for rows in (self.groups, self.sizes))
        parts = groups, sizes, np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(), bytes(d is None for d in self.doc_ids), np.array(self.counts, "<u8").tobytes()
        footer = b"".join(struct.pack("<Q", len(p)) + p for p in parts)
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()
        return sum(self.counts)


def read_id_file(file) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of an open file, in order; raises ValueError where a checksum is wrong."""
    size = file.seek(0, 2)
    file.seek(size - 16)
    length, magic = struct.unpack("<Q8s", file.read(16))
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    file.seek(size - 16 - length)
    footer, parts, at = file.read(length), [], 0
    while at < length:
        (n,) = struct.unpack_from("<Q", footer, at)
        parts.append(footer[at + 8 : at + 8 + n])
        at += 8 + n
    groups, blocks = np.frombuffer(parts[0], "<u4").reshape(-1, 2), np.frombuffer(parts[1], "<u4").reshape(-1, 3)
    doc_ids, nulls, counts = np.frombuffer(parts[2], "<i8"), parts[3], np.frombuffer(parts[4], "<u8")
    file.seek(len(MAGIC))

    def decoded() -> Iterator[np.ndarray]:
        k = 0
        for prior_bytes, n in groups.tolist():
            group = blocks[k : k + n]
            k += n
            prior = file.read(prior_bytes)
            coded = [file.read(int(c)) for c in group[:, 0]]
            found = id_coder.decode_blocks(prior, coded, group[:, 1].tolist())
            for ids, expected in zip(found, group[:, 2].tolist(), strict=True):
                if id_coder.checksum(ids) != expected:
                    raise ValueError("a block's checksum is wrong")
            yield np.concatenate(found)

    source, rest = decoded(), np.zeros(0, "<u2")
    for doc_id, null, count in zip(doc_ids.tolist(), nulls, counts.tolist(), strict=True):
        if len(rest) < count:
            have, held = [rest], len(rest)
            while held < count:
                have.append(next(source))
                held += len(have[-1])
            rest = np.concatenate(have)
        yield None if null else doc_id, rest[:count]
        rest = rest[count:]


def write_files(docs: DataFrame, vocabulary: str, folder: str, added: bool = False) -> DataFrame:
    """Writes the ids of all documents to files in folder, in ascending doc_id order; part, path, documents and ids of each.

    Rows without a doc_id come first; rows of one doc_id follow one another by text. A null text is
    empty and has the end id alone. Other columns are not read. added is that of VocabularyIds.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        encoder, end, writer = vocab_ids.loaded(vocabulary, added), np.array([END_ID], "<u2").tobytes(), None
        part = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store.create_dir(root, recursive=True)
                name = f"{part:06d}-{uuid.uuid4().hex}.ids"
                writer = IdFileWriter(store.open_output_stream(f"{root}/{name}", compression=None))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.batch(batch.column(1).to_pylist()), strict=True):
                writer.add(doc_id, ids + end)
        if writer is not None:
            n = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.counts)], pa.int64()), pa.array([n], pa.int64())], ["part", "path", "documents", "ids"])

    return written(map_arrow(rows, run, FILES), "id-files")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files alone."""
    spark = files.sparkSession
    listed, start = [], 0
    for row in files.orderBy("part").collect():  # a row for each file
        listed.append((row["path"], start))
        start += row["ids"]
    paths = spark.createDataFrame(listed, "path string, start long").repartition(max(1, len(listed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as file:
                    rows: list[tuple] = []
                    for doc_id, ids in read_id_file(file):
                        rows.append((doc_id, first, len(ids), crc32(ids.astype("<u4").tobytes())))
                        first += len(ids)
                        if len(rows) == 10_000:
                            yield _documents(rows)
                            rows = []
                    yield _documents(rows)

    return map_arrow(paths, run, DOCUMENTS)


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def file_round_trip(docs: DataFrame, vocabulary: str, added: bool = False) -> DataFrame:
    """Writes the ids of every document to files and reads them back. An empty table gives an empty result."""
    return read_files(write_files(docs, vocabulary, shared_dir(docs.sparkSession, "ids"), added))
