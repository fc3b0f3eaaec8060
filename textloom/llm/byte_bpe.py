"""Byte-level BPE, encoding and decoding. pair_merger has the segment tree over byte positions."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.chunks import WordwiseEncoder
from textloom.llm.common import kept, map_arrow, text_or_empty
from textloom.llm.pair_merger import PairMerger

def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBPE:
    """Encoder and decoder for a rank file. Ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = load_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        pairs = {}
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                if (a := self.ranks.get(token[:cut])) is not None and (b := self.ranks.get(token[cut:])) is not None:
                    pairs[a, b] = rank, rank
        self.merger = PairMerger(pairs, [self.ranks[bytes([b])] for b in range(256)])
        whole = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        self._words = WordwiseEncoder(self.merger, pattern, whole=whole)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self._words.batch(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def loaded(path: str) -> ByteBPE:
    """One encoder, with its caches, for each worker process."""
    return kept(path, lambda: ByteBPE(path))


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (packed) and the bytes that these decode to, for each row of docs.

    A null text counts as empty and has no ids. Rows with equal or null doc_id are encoded one by
    one; other columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            ids = bpe.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return map_arrow(docs.select("doc_id", text_or_empty().alias("text")), run, "doc_id long, ids binary, decoded binary")


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """encode_documents with only counts and digests leaving the worker: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for ids in bpe.encode(batch.column(1).to_pylist()):
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", text_or_empty().alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
