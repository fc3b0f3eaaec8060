"""Mixture-controlled packing: deficit round-robin over source queues fills windows of tokens.

Every source is a queue of tokens, its documents' one after another. Each window is a round: a
source's deficit grows by its share of the window, it sends as many whole tokens as its deficit holds,
and the few that are left go to the largest remaining deficits. So every window is full and holds each
source to within two tokens of its target, as long as sources last; when one runs out, the others
share its part by their own targets.

The same schedule tells how many tokens of each source come before any point of the whole output, so
it is cut to partitions of a fixed number of tokens: a partition gets the tokens of each queue that
fall into it, documents cut where that is, and begins with exactly the deficits that the partitions
before it leave. No partition depends on how large a document or a source is. All windows but the
last of a partition are full.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm import vocab_ids
from textloom.llm.common import SENT_IDS, map_arrow, text_or_empty, written

WINDOW = 2048
END_ID = 1
#: Tokens of a partition. A source may add one by rounding, so a few are kept free for that.
TOKENS_EACH, MOST_FREE = 1 << 20, 1024

TOKENS = "doc_id long, source string, n long, task int, before long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
KNOTS = "array<struct<at: double, sent: double, rate: double>>"


def tokenized(docs: DataFrame, vocabulary: str, added: bool = False) -> DataFrame:
    """doc_id, source, n (ids with the end id) and ids (unsigned 16-bit) of every row; a null text is empty.

    task numbers the tasks, and before counts the ids of the same source earlier in the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = vocab_ids.loaded(vocabulary, added), np.array([END_ID], "<u2").tobytes()
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            sources, ids = batch.column(1).to_pylist(), [i + end for i in encoder.batch(batch.column(2).to_pylist())]
            sizes, before = [len(i) // 2 for i in ids], []
            for source, n in zip(sources, sizes, strict=True):
                before.append(seen.get(source, 0))
                seen[source] = before[-1] + n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array([task] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "source", "n", "task", "before", "ids"],
            )

    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), text_or_empty().alias("text")), run, TOKENS)


def allotted(space: int, deficits: np.ndarray, left: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Tokens that each source sends into a window with space for so many; deficits are paid and quanta granted in place.

    left: tokens that each source still has. weights: targets; those of weight 0 come when all others are out.
    """
    out = np.zeros(len(left), np.int64)
    space = min(space, int(left.sum()))
    while space:
        going = (left > out) & (weights > 0)
        share = np.where(going, weights, 0.0) if going.any() else np.where(left > out, 1.0 * left, 0.0)
        going = share > 0
        deficits += space * share / share.sum()
        send = np.where(going, np.clip(np.floor(deficits + 1e-9).astype(np.int64), 0, left - out), 0)
        if (over := int(send.sum()) - space) > 0:  # what is owed from before can be more than fits: the rest is owed on
            order = np.argsort(-send, kind="stable")
            cut = send[order]
            cut = cut - np.minimum(cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
            send[order] = cut
        elif 0 < -over <= np.count_nonzero(going):  # less than a token each: to the largest deficits
            rest = np.where(going & (left > out + send), deficits - send, -np.inf)
            top = np.argsort(-rest, kind="stable")[:-over]
            send[top[rest[top] > -np.inf]] += 1
        out += send
        deficits -= send
        space -= int(send.sum())
    return out


def round_robin(lengths: dict[str, list[int]], targets: dict[str, float], deficits: dict[str, float], window: int = WINDOW) -> list[tuple[str, int, int, int, int, int]]:
    """(source, position in its queue, start, length, window, offset) of every piece, in order.

    lengths: each source's queue of document lengths. deficits: what each is owed to begin with.
    """
    names = sorted(s for s in lengths if sum(lengths[s]))
    left, owed = np.array([sum(lengths[s]) for s in names], np.int64), np.array([float(deficits.get(s, 0.0)) for s in names])
    weights = np.array([max(0.0, float(targets.get(s, 0.0))) for s in names])
    at, done, out, w = [0] * len(names), [0] * len(names), [], 0
    while left.any():
        offset = 0
        sent = allotted(window, owed, left, weights)
        left -= sent
        for i in np.flatnonzero(sent).tolist():
            name, queue, more = names[i], lengths[names[i]], int(sent[i])
            while more:
                take = min(more, queue[at[i]] - done[i])
                if take:
                    out.append((name, at[i], done[i], take, w, offset))
                offset, more, done[i] = offset + take, more - take, done[i] + take
                if done[i] == queue[at[i]]:
                    at[i], done[i] = at[i] + 1, 0
        w += 1
    return out


def _schedule(totals: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """source, all_n, weight and knots: from the point `at` of the whole output on, `sent` tokens of the source have gone and `rate` of each token is its.

    Without targets every source lasts to the end. With them, those of positive target go by these
    until they run out, one after another, and all the others follow by their sizes.
    """
    if targets is None:
        whole = totals.agg(F.sum("all_n").alias("whole"))
        rate = F.col("all_n") / F.col("whole")
        knots = F.array(F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("sent"), rate.alias("rate"))).cast(KNOTS)
        return totals.crossJoin(F.broadcast(whole)).select("source", "all_n", rate.alias("weight"), knots.alias("knots"))
    listed = {s: float(w) for s, w in targets.items() if w > 0}
    left = {r["source"]: float(r["all_n"]) for r in totals.where(F.col("source").isin(*listed)).collect()} if listed else {}  # a row for each target
    knots: dict[str, list[tuple[float, float, float]]] = {s: [] for s in left}
    all_n, at = dict(left), 0.0
    while left:
        weight = sum(listed[s] for s in left)
        for s in left:
            knots[s].append((at, all_n[s] - left[s], listed[s] / weight))
        first = min(left, key=lambda s: left[s] * weight / listed[s])
        span = left[first] * weight / listed[first]
        at += span
        left = {s: n - span * listed[s] / weight for s, n in left.items() if s != first}
        left = {s: n for s, n in left.items() if n > 1e-6}
    spark = totals.sparkSession
    known = spark.createDataFrame([(s, listed[s], k) for s, k in knots.items()], f"source string, weight double, knots {KNOTS}")
    rest = totals.join(F.broadcast(known.select("source")), "source", "left_anti")
    whole = rest.agg(F.sum("all_n").alias("whole"))
    after = F.array(F.struct(F.lit(at).alias("at"), F.lit(0.0).alias("sent"), (F.col("all_n") / F.col("whole")).alias("rate"))).cast(KNOTS)
    others = rest.crossJoin(F.broadcast(whole)).select("source", "all_n", F.lit(0.0).alias("weight"), after.alias("knots"))
    return totals.join(F.broadcast(known), "source").select("source", "all_n", "weight", "knots").union(others)


def _sent_at(point: Column) -> Column:
    """Tokens of the source, with a fraction, that the first `point` tokens of the whole output hold."""
    known = F.aggregate("knots", F.lit(0.0), lambda acc, k: F.when(k["at"] <= point, k["sent"] + k["rate"] * (point - k["at"])).otherwise(acc))
    return F.least(known, F.col("all_n").cast("double"))


def pack(docs: DataFrame, vocabulary: str, added: bool = False, targets: dict[str, float] | None = None, each: int = TOKENS_EACH) -> DataFrame:
    """Every id of every document in exactly one piece of a sequence of at most WINDOW ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. targets: the share of
    each source in a window, by default its share of all tokens. Null and empty texts give one piece,
    the end id alone. Null sources are one source, the empty name. Rows are packed one by one, also
    those with equal or null doc_id. added is that of VocabularyIds; each is about the number of
    tokens of a partition. Other columns are not read. An empty table gives an empty result.
    """
    tokens = written(tokenized(docs, vocabulary, added), "packing")
    by_task = written(tokens.groupBy("source", "task").agg(F.sum("n").alias("n")), "packing")
    totals = by_task.groupBy("source").agg(F.sum("n").alias("all_n"))
    size = totals.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("all_n"), F.lit(0)).alias("tokens")).first()
    each = max(WINDOW, each - min(size["sources"], MOST_FREE))
    parts = max(1, -(-size["tokens"] // each))

    # Where each task's part of a queue begins: one number for each source and task.
    earlier = F.sum("n").over(Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    queues = written(by_task.select("source", "task", F.coalesce(earlier, F.lit(0)).alias("offset")).join(_schedule(totals, targets), "source"), "packing")
    if queues.count() <= SENT_IDS:
        queues = F.broadcast(queues)
    placed = tokens.join(queues, ["source", "task"]).withColumn("begin", F.col("offset") + F.col("before"))

    def bound(part: Column) -> Column:
        """Tokens of the source before a partition."""
        return F.when(part >= parts, F.col("all_n")).otherwise(F.floor(_sent_at(part * F.lit(float(each))) + F.lit(1e-6)))

    def part_of(token: Column) -> Column:
        """The partition that a token of the source, counted from 0, falls into."""
        point = F.aggregate("knots", F.lit(0.0), lambda acc, k: F.when(k["sent"] < token + 1, k["at"] + (token + 1 - k["sent"]) / k["rate"]).otherwise(acc))
        near = F.least(F.greatest(F.ceil(point / F.lit(float(each))) - 1, F.lit(0)), F.lit(parts - 1))
        return near

    last = F.col("begin") + F.col("n") - 1
    # Rounding may put the estimate one off; empty cuts are dropped, so one more on both sides does no harm.
    spread = F.sequence(F.greatest(part_of(F.col("begin")) - 1, F.lit(0)), F.least(part_of(last) + 1, F.lit(parts - 1)))
    cut = placed.withColumn("part", F.explode(spread)).withColumn("low", bound(F.col("part"))).withColumn("high", bound(F.col("part") + 1))
    cut = cut.withColumn("from", F.greatest("begin", "low")).withColumn("to", F.least(F.col("begin") + F.col("n"), F.col("high"))).where("from < to")
    start, length = F.col("from") - F.col("begin"), F.col("to") - F.col("from")
    rows = cut.select(
        F.col("part").cast("long").alias("part"), "source", "from", "doc_id", start.alias("start"), F.col("n").alias("doc_tokens"), "weight",
        (_sent_at(F.col("part") * F.lit(float(each))) - F.col("low")).alias("owed"),
        F.substring("ids", (start * 2 + 1).cast("int"), (length * 2).cast("int")).alias("ids"),
    )

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source", "from"]).reset_index(drop=True)
        sizes = rows["ids"].map(len).to_numpy() // 2
        ids = np.frombuffer(b"".join(rows["ids"]), "<u2").astype("<u4")
        ends = np.cumsum(sizes)
        firsts = rows.drop_duplicates("source")
        first_row = dict(zip(firsts["source"], firsts.index, strict=True))
        lengths = {s: sizes[i].tolist() for s, i in rows.groupby("source").indices.items()}
        targets_, owed = (dict(zip(firsts["source"], firsts[c], strict=True)) for c in ("weight", "owed"))
        pieces = round_robin(lengths, targets_, owed)
        doc_ids, starts, doc_tokens = rows["doc_id"].tolist(), rows["start"].tolist(), rows["doc_tokens"].tolist()
        base, begins, out = int(key[0]) << 32, (ends - sizes).tolist(), []
        for s, k, start, length, window, offset in pieces:
            i = first_row[s] + k
            a = begins[i] + start
            out.append((doc_ids[i], starts[i] + start, length, crc32(ids[a : a + length]), doc_tokens[i], base + window, offset))
        frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    return rows.groupBy("part").applyInPandas(fill, PIECES)
