"""Connected components by alternating large and small stars, each a minimum per vertex and a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SENT_ROWS, delete, hot_join, shared_dir, written


def _least(edges: DataFrame, total: int) -> DataFrame:
    """edges(u, v), total of them at most, with m, the least v of each u. The edges of a hub stay where they are.

    Where there are few edges, all minima go to all executors: the driver plans one join in place of
    those of hot_join, each of which costs it plans, tasks' binaries and broadcasts.
    """
    stars = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    if total <= SENT_ROWS:
        return edges.join(F.broadcast(stars.drop("degree")), "u")
    return hot_join(edges, written(stars, "stars"), "u", "degree", total)


def _rows(*pairs: tuple[str, str]) -> Column:
    """A row u, v for each pair of columns, all made in one pass over what may be a join."""
    return F.inline(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs)))


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) to node, component: the least node of its component, for every node but those.

    Loops and repeated edges do no harm, nulls aren't allowed. Neighbours are never gathered: a node
    of any degree costs a partial minimum and, if it is a hub, a broadcast row.
    """
    spark = edges.sparkSession
    path = shared_dir(spark, "edges")
    current = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", path)
    before = None
    while True:
        now = current.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if now == before or not now["n"]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, total = now, 2 * now["n"]
        both = current.select(_rows(("u", "v"), ("v", "u")))
        large = _least(both, total).select("v", F.least("u", "m").alias("m"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        middle_path = shared_dir(spark, "edges")
        large = written(large, "edges", middle_path)
        starred = _least(large, total)
        small = starred.select(_rows(("u", "m"), ("v", "m"))).where("u <> v")
        next_path = shared_dir(spark, "edges")
        current = written(small.distinct(), "edges", next_path)
        for old in (path, middle_path):
            delete(spark, old)
        path = next_path
