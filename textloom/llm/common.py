"""What the operators share: table access, the shared folder, bounded batches and memory, hot keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that an operator's function sees at a time, one longer text apart. Spark itself bounds what it sends by bytes.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20

#: So many ids, of 8 bytes each, may be sent to all executors.
SENT_IDS = 1_000_000

#: Tables of groups of so many rows, a number or digest for each, may be sent to all executors.
SENT_ROWS = 100_000

#: Keys with this share of all rows or more are hot; there can't be more of them than its inverse.
HOT_SHARE = 1e-4

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder, as a URI, under the one that all executors share.

    The cluster names it in spark.checkpoint.dir. Where that is unset in local mode, a temporary
    folder of this machine, which then holds driver and executors, takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/textloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, uri: str) -> None:
    """Deletes a folder of shared_dir that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that the operators of this application have written under the shared folder. Results not yet computed are lost."""
    delete(spark, shared_dir(spark, "x").rpartition("/")[0])


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """The rows of df as a table in the shared folder: lineage ends there, and no row is made twice."""
    path = path or shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_ids(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined (left_semi or left_anti) with a written table of distinct ids.

    At most SENT_IDS of them, by count, go to all executors, and rows stay where they are; beyond
    that both sides are shuffled.
    """
    return rows.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, key, how)


def hot_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left-joined with a written table that has each key once, with the number of its rows in size.

    Hot keys, at most 1 / HOT_SHARE of them as sizes add up to total at most, go to all executors, so
    that no task gets all rows of one; the others are shuffled.
    """
    least = max(2.0, HOT_SHARE * total)
    hot = F.broadcast(groups.where(F.col(size) >= least).drop(size))
    few = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(size) < least).drop(size), key, "left")
    return rows.join(hot, key).unionByName(few)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most BATCH_ROWS rows and about BATCH_BYTES."""
    for batch in batches:
        each = max(1, min(BATCH_ROWS, BATCH_BYTES * batch.num_rows // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, each):
            yield batch.slice(at, each)


def give_back() -> None:
    """Returns memory that this process has freed to the system, as Spark keeps workers for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], T]) -> T:
    """What make returns, kept for later tasks of this worker; whatever was kept under another key goes first."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """df.mapInArrow with small batches; workers give their memory back after each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(slices(batches))
        finally:
            give_back()

    return df.mapInArrow(run, schema)
