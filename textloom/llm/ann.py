"""Approximate nearest neighbours by multiprobe p-stable hashing with exact reranking.

Each hash table takes some projections on Gaussian (2-stable) directions, shifted and cut to cells of
one width; a bucket is what shares all cells. A query visits, in every table, its own bucket and
perturbed ones: all vectors of -1, 0, +1 steps are ordered by the squared distances from the query to
the cell borders they cross, the estimate of their success, and the first of them are visited.

The index is a table of rows by table and bucket, queries are exploded to the buckets that they visit,
and both meet by an equi-join. Each bucket ranks its rows by exact distance in double precision; what
the buckets of all tables find is merged. Buckets of more than BUCKET_ROWS rows are split, and queries
sent to every part, so that no task depends on how many rows share a bucket. Equal vectors are one
row, with the ids that can count among the nearest.

How many tables, projections and probes, and how wide the cells, is fitted on a bounded sample for the
least work that reaches TARGET recall there. Vectors without structure leave no good choice: the
nearer two distances are to one another, the more rows any setting has to visit.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import SENT_IDS, hot_join, map_arrow, written

SEED = 11
#: What fit tries: tables, projections of each, width of a cell in lengths of a typical vector, probes.
TABLES, FUNCTIONS, WIDTHS = (1, 2, 3, 4, 6), (4, 5, 6), (0.25, 0.5, 1.0, 1.5, 2.0)
PROBES = (1, 2, 4, 8, 16, 32, 48, 64, 81, 128, 192, 243, 384, 729)
TARGET = 0.95
#: The bounded sample that these are fitted on.
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 64
#: A bucket that a query visits costs about as much as so many rows.
PROBE_COST = 2
#: Vectors of a length that fewer rows have make one bucket.
FEW_ROWS = 1000
BUCKET_ROWS = 1024
K, EVERY = 10, 100

BUCKET = ["dimensions", "hash_table", "bucket", "part"]
INDEX = "dimensions int, hash_table int, bucket long, part int, v array<double>, ids array<long>, times array<long>"
ASKED = "dimensions int, hash_table int, bucket long, query long, v array<double>"
FOUND = "query long, vec_id long, times long, score double"


@dataclass(frozen=True)
class Hashing:
    directions: np.ndarray  # tables x dimensions x functions
    shifts: np.ndarray  # tables x functions
    width: float
    probes: int

    @property
    def steps(self) -> np.ndarray:
        return np.array(list(itertools.product((-1, 0, 1), repeat=self.directions.shape[2])), np.int64)

    def cells(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector in each projection, and how far into it the vector lies."""
        at = (x @ self.directions[table] + self.shifts[table]) / self.width
        cell = np.floor(np.clip(at, -(2.0**40), 2.0**40))
        return cell.astype(np.int64), at - cell

    def costs(self, into: np.ndarray) -> np.ndarray:
        """Queries x steps: the squared distance to the borders that each vector of steps crosses."""
        one = np.stack([into**2, np.zeros_like(into), (1 - into) ** 2])
        steps = self.steps
        return sum(one[steps[:, f] + 1, :, f] for f in range(steps.shape[1])).T

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        return _mixed(self.cells(x, table)[0])

    def probed(self, x: np.ndarray, table: int) -> np.ndarray:
        """Vectors x probes: the buckets to visit, likeliest first."""
        cell, into = self.cells(x, table)
        order = np.argsort(self.costs(into), axis=1, kind="stable")[:, : self.probes]
        return _mixed(cell[:, None, :] + self.steps[order])


def _mixed(cells: np.ndarray) -> np.ndarray:
    """A 64-bit name of the cells. Two buckets of one name would only be visited together."""
    h = np.zeros(cells.shape[:-1], np.uint64)
    for f in range(cells.shape[-1]):
        h = (h ^ cells[..., f].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def hashing(dimensions: int, tables: int, functions: int, width: float, probes: int) -> Hashing:
    rng = np.random.default_rng(SEED)
    return Hashing(rng.normal(size=(tables, dimensions, functions)), rng.random((tables, functions)) * width, width, probes)


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    gap = rows - query
    return np.sqrt((gap * gap).sum(axis=1))


def _probe_ranks(h: Hashing, rows: np.ndarray, queries: np.ndarray, table: int) -> np.ndarray:
    """Queries x rows: at which probe of the table the query would meet the row; a large number for never."""
    cell_r, _ = h.cells(rows, table)
    cell_q, into = h.cells(queries, table)
    costs = h.costs(into)
    rank = np.empty_like(costs, np.int64)
    np.put_along_axis(rank, np.argsort(costs, axis=1, kind="stable"), np.arange(costs.shape[1])[None, :], 1)
    gap = cell_r[None] - cell_q[:, None]
    step = ((np.clip(gap, -1, 1) + 1) * 3 ** np.arange(gap.shape[2])[::-1]).sum(2)
    return np.where((np.abs(gap) <= 1).all(2), np.take_along_axis(rank, step, 1), 1 << 30)


def fit(sample: np.ndarray, k: int = K) -> Hashing:
    """The setting of least work that reaches TARGET recall on the sample, else the one of most recall."""
    spread = max(float(np.sqrt((sample**2).sum(1).mean())) if len(sample) else 1.0, 1e-12)
    at = np.unique(np.linspace(0, len(sample) - 1, min(len(sample), SAMPLE_QUERIES)).astype(int)) if len(sample) else np.zeros(0, int)
    queries = sample[at]
    best = []
    for i in at:
        d = distances(sample, sample[i])
        d[i] = np.inf
        best.append(np.argsort(d, kind="stable")[: min(k, len(sample) - 1)])
    tried = []
    for functions, width in itertools.product(FUNCTIONS, WIDTHS):
        h = hashing(sample.shape[1], max(TABLES), functions, width * spread, 1)
        least, visits = np.full((len(at), len(sample)), 1 << 30), np.zeros(len(PROBES))
        for table in range(max(TABLES)):
            ranks = _probe_ranks(h, sample, queries, table)
            visits += [np.count_nonzero(ranks < p) / max(1, len(at)) for p in PROBES]
            np.minimum(least, ranks, out=least)
            if table + 1 in TABLES:
                for p, rows in zip(PROBES, visits, strict=True):
                    if p <= 3**functions:
                        recall = np.mean([(least[i, b] < p).mean() if len(b) else 1.0 for i, b in enumerate(best)]) if best else 1.0
                        tried.append((recall, rows + PROBE_COST * p * (table + 1), table + 1, functions, width * spread, p))
    enough = [t for t in tried if t[0] >= TARGET]
    _, _, tables, functions, width, probes = min(enough, key=lambda t: t[1]) if enough else max(tried)
    full = hashing(sample.shape[1], max(TABLES), functions, width, probes)
    return Hashing(full.directions[:tables], full.shifts[:tables], width, probes)


def _usable(vector: Column) -> Column:
    """Not null, not all zero, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = batch.column(0).to_numpy()
    for dimensions in np.unique(lengths).tolist():
        yield dimensions, batch.filter(pa.array(lengths == dimensions))


def _search(k: int):
    def search(mine: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """Of each query vector the nearest rows with k + 1 different ids."""
        out = []
        if len(mine) and len(queries):
            x, ids, times = np.stack(mine["v"].to_numpy()), mine["ids"].tolist(), mine["times"].tolist()
            size = (x * x).sum(1)
            for query, v in zip(queries["query"].tolist(), queries["v"], strict=True):
                # Approximate squares pick what can be among the nearest, and those are measured exactly.
                near = size - 2 * (x @ v)
                n = min(k + 1, len(x))
                edge = np.partition(near, n - 1)[n - 1] + 1e-9 * (size.max() + v @ v)
                at = np.flatnonzero(near <= edge)
                d = distances(x[at], v)
                entries = sorted((score, i, t) for score, row in zip(d.tolist(), at.tolist(), strict=True) for i, t in zip(ids[row], times[row], strict=True))
                out += [(query, i, t, score) for score, i, t in _first_ids(entries, k)]
        return pd.DataFrame(out, columns=["query", "vec_id", "times", "score"])

    return search


def _first_ids(entries: list[tuple[float, int, int]], k: int) -> list[tuple[float, int, int]]:
    """The first entries that have k + 1 different ids."""
    seen: set[int] = set()
    out = []
    for entry in entries:
        if len(seen | {entry[1]}) > k + 1:
            break
        seen.add(entry[1])
        out.append(entry)
    return out


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The k nearest found of every row whose vec_id is divisible by every: query_id, rank, vec_id, score.

    Nearest first by Euclidean distance in double precision, ties to the smaller vec_id. Rows with a
    query's vec_id are its own and no candidates of it; they are one query, and a candidate counts by
    the nearest of them. Otherwise rows that share a vec_id stay apart. Vectors that are null, zero or hold null or non-finite components, and rows without
    vec_id, take no part; vectors meet those of equal length only. Lengths of fewer than FEW_ROWS
    rows are one bucket, searched whole. A query whose probes find fewer than k rows is compared with
    all rows, in blocks. Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    # Equal vectors are equally near: of their ids, only the least k + 1 can be among the k nearest of a query.
    once = rows.groupBy("v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("times"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("rank") <= k + 1)
    grouped = ranked.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "times"))).alias("members"))
    classes = written(grouped.select(F.size("v").alias("dimensions"), "v", F.col("members.vec_id").alias("ids"), F.col("members.times").alias("times")), "vectors")
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    wanted = queries.groupBy("v").agg(F.count(F.lit(1)).alias("rows"))
    wanted = written(wanted.select(F.size("v").alias("dimensions"), F.monotonically_increasing_id().alias("query"), "v", "rows"), "queries")

    fitted: dict[int, Hashing] = {}
    for r in classes.groupBy("dimensions").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FEW_ROWS).collect():
        sample = classes.where(F.col("dimensions") == r["dimensions"]).select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE_ROWS).collect()
        fitted[r["dimensions"]] = fit(np.array([s["v"] for s in sample], np.float64), k)
    sent = spark.sparkContext.broadcast(fitted)  # a few matrices for each length of many rows

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dimensions, some in _by_length(batch):
                h = sent.value.get(dimensions)
                x = _vectors(some.column(1))
                for table in range(len(h.directions) if h else 1):
                    keys = h.buckets(x, table) if h else np.zeros(len(x), np.int64)
                    n = some.num_rows
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array([table] * n, pa.int32()), pa.array(keys), pa.array([0] * n, pa.int32()), *some.columns[1:]], ["dimensions", "hash_table", "bucket", "part", "v", "ids", "times"])

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dimensions, some in _by_length(batch):
                h = sent.value.get(dimensions)
                x = _vectors(some.column(2))
                for table in range(len(h.directions) if h else 1):
                    keys = h.probed(x, table) if h else np.zeros((len(x), 1), np.int64)
                    at = pa.array(np.repeat(np.arange(len(x)), keys.shape[1]))
                    yield pa.RecordBatch.from_arrays([some.column(0).take(at), pa.array([table] * len(at), pa.int32()), pa.array(keys.ravel()), some.column(1).take(at), some.column(2).take(at)], ["dimensions", "hash_table", "bucket", "query", "v"])

    index = written(map_arrow(classes.select("dimensions", "v", "ids", "times"), indexed, INDEX), "index")
    key = BUCKET[:3]
    sizes = written(index.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).cast("int").alias("parts")), "buckets")
    some = F.broadcast(sizes) if sizes.count() <= SENT_IDS else sizes
    visits = map_arrow(wanted.select("dimensions", "query", "v"), visiting, ASKED).join(some, key)
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    large = F.broadcast(sizes.where("parts > 1"))  # one row for BUCKET_ROWS rows of the index
    dealt = index.drop("part").join(large, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("v"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    found = written(dealt.groupBy(*BUCKET).cogroup(visits.groupBy(*BUCKET)).applyInPandas(_search(k), FOUND).distinct(), "found")

    # A query's own id doesn't count: with k + 1 ids or all there are, k or all others remain.
    enough = found.groupBy("query").agg(F.count_distinct("vec_id").alias("found")).where(F.col("found") > k).select("query")
    lacking = written(wanted.where(F.col("dimensions").isin(*fitted)).join(enough, "query", "left_anti").select("dimensions", "query", "v"), "lacking")
    if fitted and (n := lacking.count()):
        # These few, in blocks, against the whole index, whose first table holds each vector once.
        whole = index.where("hash_table = 0").withColumn("bucket", F.lit(0).cast("long"))
        blocks = max(1, -(-whole.count() // BUCKET_ROWS))
        whole = whole.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"))
        lots = max(1, -(-n // BUCKET_ROWS))
        to_lots = F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).cast("int")
        asked = lacking.select("dimensions", F.pmod(F.xxhash64("v", F.lit(1)), F.lit(lots)).cast("int").alias("hash_table"), F.lit(0).cast("long").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), "query", "v")
        whole = whole.select("dimensions", to_lots.alias("hash_table"), "bucket", "part", "v", "ids", "times")
        found = found.unionByName(whole.groupBy(*BUCKET).cogroup(asked.groupBy(*BUCKET)).applyInPandas(_search(k), FOUND)).distinct()

    # The nearest k + 1 ids of each query vector, each as often as it can count; then of each query, without its own.
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    firsts = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= (k + 1) * 2)
    lists = firsts.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id", "times"))).alias("near"))
    lists = written(lists.join(wanted.select("query", "v", "rows"), "query").drop("query"), "lists")
    total = wanted.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    each = hot_join(queries, lists, "v", "rows", total).where("near IS NOT NULL").withColumnRenamed("vec_id", "query_id")
    others = F.flatten(F.transform(F.filter("near", lambda e: e["vec_id"] != F.col("query_id")), lambda e: F.array_repeat(e, e["times"].cast("int"))))
    firsts = each.select("query_id", F.slice(others, 1, k).alias("near"))
    turn = lambda e, i: F.size(F.filter(F.slice("near", F.lit(1), i), lambda o: o["vec_id"] == e["vec_id"]))
    taken = firsts.select("query_id", F.explode(F.transform("near", lambda e, i: F.struct(e["vec_id"].alias("vec_id"), e["score"].alias("score"), turn(e, i).alias("turn")))).alias("e"))
    # Several vectors of one query: a row of an id counts by the nearest of them.
    once_each = taken.groupBy("query_id", F.col("e.vec_id").alias("vec_id"), "e.turn").agg(F.min("e.score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once_each.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
