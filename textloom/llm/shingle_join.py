"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, exact check.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Documents with equal
sets form a class, whose least doc_id stands for it in all that follows.

All sets are put in one order: rarest first, by counts that each task makes over its shingles and
that are summed over all documents and kept in a table of fixed size, then by hash. Two sets of the wanted similarity share a shingle
within the first n - ceil(t n) + 1 of each. Documents of a prefix shingle are joined in two rounds,
so that a large group of copies costs no pair for each two of its members: first each with the least
document under the shingle; then, of those that the first round didn't bring together, each with
each. Pairs that pass the filters are checked once, on whole texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SENT_IDS, SENT_ROWS, by_ids, hot_join, map_arrow, text_or_empty, written
from textloom.llm.components import components
from textloom.llm.runs import PIECE, factor, hashes, mixed

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Equal parts of the hash range, each with one byte for the count of its most frequent shingle: the table by
#: which prefixes are ordered has this size over any corpus. The order is all that depends on it.
CELL_BITS, CHUNK_BITS = 23, 13
#: A task counts blocks of so many shingles, and names those that come so often in one.
BLOCK, OFTEN = 8_000_000, 2
#: Postings of one shingle, and sets of about one size, that meet in one task.
BLOCK_POSTINGS = 1024
#: Parts of the hash range; those that one set has and another lacks bound their intersection from above.
MAP_BITS = 2048
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes' codes, mixed. Pieces that end at white space bound the memory."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        piece = np.frombuffer(data[at:end], np.uint8)
        at, n = end, len(piece)
        solid = np.zeros(n + 2, bool)
        np.logical_and(piece != 32, piece - np.uint8(9) > 4, out=solid[1:-1])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edges[::2], edges[1::2]
        out.append(hashes(piece, starts, ends))
    return np.concatenate(out)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes. Fewer than five words are one shingle; none, no shingle."""
    h = word_hashes(text.encode("utf-8", "surrogatepass").lower())  # bytes: A-Z only
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        size = min(WORDS, len(h))
        total = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            total = mixed(total + h[k : len(h) - size + 1 + k] * factor(k))
    return np.unique(total)


def _scan(docs: DataFrame) -> DataFrame:
    """Two kinds of rows: doc_id, n and digest of each document's set; shingle and count where frequent in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(block), return_counts=True) if block else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = counts >= OFTEN
            k = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(counts[often], pa.int64()), pa.nulls(k, pa.binary()), pa.array(values[often].view(np.int64), pa.int64())], ["doc_id", "n", "digest", "shingle"])

        for batch in batches:
            sets = [shingle_set(text) for text in batch.column(1).to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.nulls(len(sets), pa.int64())], ["doc_id", "n", "digest", "shingle"])
            block += sets
            held += sum(map(len, sets))
            if held >= BLOCK:
                yield counted()
                block, held = [], 0
        yield counted()

    return map_arrow(docs, run, "doc_id long, n long, digest binary, shingle long")


def _levels(scan: DataFrame) -> np.ndarray:
    """A byte for each cell of the hash range: eight times the binary logarithm of its largest count, 0 without any."""
    counts = scan.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("df"))
    cells = counts.groupBy(F.shiftrightunsigned("shingle", 64 - CELL_BITS).cast("int").alias("cell")).agg(F.max("df").alias("df"))
    level = F.least(F.lit(255), F.floor(F.log2("df") * 8)).cast("int").alias("level")

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        levels = np.zeros(1 << CHUNK_BITS, np.uint8)
        levels[rows["cell"].to_numpy() & ((1 << CHUNK_BITS) - 1)] = rows["level"].to_numpy()
        return pd.DataFrame({"chunk": [key[0]], "levels": [levels.tobytes()]})

    chunks = cells.select(F.shiftright("cell", CHUNK_BITS).alias("chunk"), "cell", level).groupBy("chunk").applyInPandas(joined, "chunk int, levels binary")
    out = np.zeros((1 << CELL_BITS - CHUNK_BITS, 1 << CHUNK_BITS), np.uint8)
    for row in chunks.collect():  # one byte for each cell
        out[row["chunk"]] = np.frombuffer(row["levels"], np.uint8)
    return out.reshape(-1)


def _prefixes(docs: DataFrame, levels: np.ndarray, percent: int) -> DataFrame:
    """Two kinds of rows: shingle, doc, n and pos for the prefix of each document's set, rarest first; doc, n and map.

    A map has a bit for each part of the hash range that the whole set has shingles in.
    """
    sent = docs.sparkSession.sparkContext.broadcast(levels)  # 2 ** CELL_BITS bytes
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, shift = sent.value, np.uint64(64 - CELL_BITS)
        part = np.uint64(65 - MAP_BITS.bit_length())
        names = ["shingle", "doc", "n", "pos", "map"]
        for batch in batches:
            shingles, docs_, sizes, bits = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text)
                n = len(s)
                if not n:
                    continue
                row = np.zeros(MAP_BITS, bool)
                row[(s >> part).astype(np.int64)] = True
                bits.append(row)
                keep = n - (percent * n + 99) // 100 + 1
                shingles.append(s[np.argsort(levels[(s >> shift).astype(np.int64)], kind="stable")][:keep])
                docs_.append(doc)
                sizes.append(n)
            if not docs_:
                continue
            k, kept = len(docs_), [len(x) for x in shingles]
            docs_, sizes = np.array(docs_, np.int64), np.array(sizes, np.int32)
            places = np.concatenate([np.arange(x, dtype=np.int32) for x in kept])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.repeat(docs_, kept)), pa.array(np.repeat(sizes, kept)), pa.array(places), pa.nulls(len(places), kind)], names)
            longs = np.packbits(np.array(bits), axis=1).view(np.int64)
            maps = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * longs.shape[1]), pa.array(longs.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(docs_), pa.array(sizes), pa.nulls(k, pa.int32()), maps], names)

    return map_arrow(docs, run, "shingle long, doc long, n int, pos int, map array<long>")


def _needed(na: Column, nb: Column, percent: int) -> Column:
    """Least intersection of two sets of these sizes that links them."""
    return F.ceil((na + nb) * F.lit(percent) / F.lit(100.0 + percent) - F.lit(1e-9))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) that link. texts(doc, text) has each document once.

    The sets of both are made anew from whole texts and intersected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, np.zeros(0, np.uint64)
        for batch in batches:
            hits = []
            for k, (a, text_a, text_b) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                if a != last:
                    last, of_last = a, shingle_set(text_a)
                other = shingle_set(text_b)
                both = len(np.intersect1d(of_last, other, assume_unique=True))
                if 100 * both >= percent * (len(of_last) + len(other) - both):
                    hits.append(k)
            yield batch.select([0, 1]).take(pa.array(hits, pa.int64()))

    right = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    full = right.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    return map_arrow(full.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def _missing(a: str, b: str) -> Column:
    """Parts that the map a has and b lacks: as many shingles at least aren't shared."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda acc, n: acc + n)


def _dealt(postings: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The postings twice, as smaller and as larger set, with the keys under which two that may link meet once: shingle, band and block.

    A band holds sizes within the wanted similarity of one another, so a set meets larger ones in its
    own band and the next. The larger sets of a frequent key are dealt to blocks of about
    BLOCK_POSTINGS, and the smaller ones sent to each, so that no task gets all of them.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent * 1.0001))).cast("int")
    rows = postings.withColumn("band", band)
    frequent = rows.groupBy("shingle", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_POSTINGS).cast("int").alias("blocks")).where("blocks > 1")
    frequent = written(frequent, "frequent")  # one row for BLOCK_POSTINGS postings at most
    frequent = F.broadcast(frequent) if frequent.count() <= SENT_IDS else frequent
    side = lambda name: (F.col(c).alias(f"{c}_{name}") for c in ("doc", "n", "pos", "component"))
    larger = rows.join(frequent, ["shingle", "band"], "left").select("shingle", "band", F.coalesce(F.pmod(F.xxhash64("doc"), F.col("blocks")), F.lit(0)).cast("int").alias("block"), *side("b"))
    smaller = rows.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))).join(frequent, ["shingle", "band"], "left")
    return smaller.select("shingle", "band", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"), *side("a")), larger


def link_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs.

    component_id is the least doc_id that links reach. A null text counts as empty; a document
    without words has no shingle, links with nothing and is its own component. A row with a null
    doc_id is its own component too, with a null component_id. Rows with one doc_id are one node,
    with the links of all its texts. Other columns are not read. An empty table gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    scan = written(_scan(plain), "shingles")
    sets = scan.where("digest IS NOT NULL").select("doc_id", "n", "digest")
    levels = _levels(scan)

    classes = written(sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    total = classes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    with_class = sets.join(F.broadcast(classes.drop("rows")), "digest", "left") if total <= SENT_ROWS else hot_join(sets, classes, "digest", "rows", total)
    rows = written(with_class.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "classes")
    # Only texts of a class's representative matter; those of the other rows, the copies, are left out.
    copies = rows.where("rep IS NOT NULL").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("rep")).alias("stands")).where("NOT stands").select("doc_id")
    known = plain.where("doc_id IS NOT NULL")
    texts = by_ids(known, written(copies, "copies"), "doc_id", "left_anti").select(F.col("doc_id").alias("doc"), "text")

    made = written(_prefixes(texts, levels, percent), "prefixes")
    prefixes, maps = made.where("shingle IS NOT NULL").drop("map"), made.where("map IS NOT NULL").select("doc", "n", "map")
    shared = prefixes.groupBy("shingle").agg(F.min("doc").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    postings = written(prefixes.join(shared, "shingle"), "postings")

    # The length filter; a document with several texts has several sizes.
    hubs = rows.where("doc_id = rep").groupBy(F.col("rep").alias("a")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    star = postings.where("hub <> doc").select(F.col("hub").alias("a"), F.col("doc").alias("b"), "n").distinct()
    fits = (F.col("n") * 100 >= F.col("low") * percent) & (F.col("high") * 100 >= F.col("n") * percent)
    star = star.join(hubs, "a").where(fits).select("a", "b").distinct()

    def checked(pairs: DataFrame) -> DataFrame:
        """pairs(a, b) that link. The suffix filter comes first: the parts of the hash range in which one set lies and the other doesn't."""
        pairs = written(pairs, "candidates")
        of_a, of_b = (maps.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("map").alias(f"map_{c}")) for c in "ab")
        most = F.least(F.col("na") - _missing("map_a", "map_b"), F.col("nb") - _missing("map_b", "map_a"))
        left = pairs.join(of_a, "a").join(of_b, "b").where(most >= _needed(F.col("na"), F.col("nb"), percent)).select("a", "b").distinct()
        left = written(left, "bounded")
        wanted = written(left.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "wanted")
        some = by_ids(known.select(F.col("doc_id").alias("doc"), "text"), wanted, "doc", "left_semi")
        return written(_verified(left, some, percent), "links")

    own = rows.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u <> v")
    several = rows.where("rep IS NOT NULL").join(own.select("doc_id", "u"), "doc_id").select("u", F.col("rep").alias("v")).where("u <> v")
    links = checked(star).select(F.col("a").alias("u"), F.col("b").alias("v")).union(several)
    near = components(links).withColumnRenamed("node", "doc")

    labelled = postings.join(near, "doc", "left").select("shingle", "doc", "n", "pos", F.coalesce("component", "doc").alias("component"))
    split = labelled.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle")
    open_ = written(labelled.join(split, "shingle", "left_semi"), "postings")
    a, b = _dealt(open_, percent)
    # The positional filter: what remains of both sets from a shared shingle on must suffice.
    rest = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    once = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("doc_a") < F.col("doc_b"))
    long_enough = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (rest >= _needed(F.col("n_a"), F.col("n_b"), percent))
    pairs = a.join(b, ["shingle", "band", "block"]).where(once & (F.col("doc_a") != F.col("doc_b")) & (F.col("component_a") != F.col("component_b")) & long_enough)
    pairs = pairs.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct()
    more = checked(pairs.join(star, ["a", "b"], "left_anti"))

    merged = near.select(F.col("doc").alias("u"), F.col("component").alias("v")).union(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    final = components(merged).withColumnRenamed("node", "rep")
    out = rows.join(final, "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
