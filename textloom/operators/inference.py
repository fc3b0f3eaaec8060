"""What surrounds a model: order by length, batches, token counts, throughput, and a registry of translators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T

Translate = Callable[[list[str]], list[str]]
_REGISTRY: dict[str, Callable[[], Translate]] = {}


def register(kind: str, make: Callable[[], Translate]) -> None:
    """make builds a translator in the worker that uses it."""
    _REGISTRY[kind] = make


def translator(kind: str) -> Callable[[], Translate]:
    if kind not in _REGISTRY:
        raise ValueError(f"unknown translator {kind}")
    return _REGISTRY[kind]


def head(rows: DataFrame, n: int | None, place: str = "seg_idx") -> DataFrame:
    """The first n rows in file order."""
    return rows if n is None else rows.where(F.col(place) < n)


def by_length(rows: DataFrame, text: str, place: str = "seg_idx") -> DataFrame:
    """Rows in ascending number of words, equal ones in their order, over all partitions."""
    return rows.withColumn("n_words", T.count_words(F.col(text))).orderBy("n_words", place)


def restored(rows: DataFrame, place: str = "seg_idx") -> DataFrame:
    """Rows in their first order; a place that is lost or comes twice is an error."""
    n, places, last = rows.agg(F.count(F.lit(1)), F.count_distinct(place), F.max(place)).first()
    if n != places or n and last != n - 1:
        raise ValueError(f"length mismatch: {n} rows, {places} places, the last {last}")
    return rows.orderBy(place)


def batches(rows: DataFrame, size: int, order: Sequence[str | Column], group: str | None = None) -> DataFrame:
    """rows with batch: size rows in the order make one. With group, batches are made within each."""
    window = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(window) - 1) / size))


def collated(rows: DataFrame, group: Sequence[str], pad: int) -> DataFrame:
    """rows(group, input_ids, labels) with both padded to the longest of their batch, labels by -100, and a mask."""
    batch = Window.partitionBy(*group)
    rows = rows.withColumn("__n", F.max(F.size("input_ids")).over(batch)).withColumn("__m", F.max(F.size("labels")).over(batch))
    padded = lambda ids, n, value: F.concat(ids, F.array_repeat(F.lit(value).cast("long"), n - F.size(ids)))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), F.col("__n") - F.size("input_ids")))
    return rows.withColumn("mask", mask).withColumn("input_ids", padded(F.col("input_ids"), F.col("__n"), pad)).withColumn("labels", padded(F.col("labels"), F.col("__m"), -100)).drop("__n", "__m")


def input_tokens(ids: Column, pad: int | None) -> Column:
    return (F.size(ids) if pad is None else F.size(F.filter(ids, lambda x: x != pad))).cast("long")


def output_tokens(ids: Column, pad: int | None, special: Sequence[int]) -> Column:
    """Ids other than padding and special ones."""
    left_out = [*special, *([] if pad is None else [pad])]
    return F.size(F.filter(ids, lambda x: ~x.isin(*left_out)) if left_out else ids).cast("long")


def translate(rows: DataFrame, text: str, kind: str) -> DataFrame:
    """rows with hyp, a batch at a time; line breaks in what the model gives become spaces."""
    make = translator(kind)
    schema = f"{rows._jdf.schema().toDDL()}, hyp string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            yield frame.assign(hyp=[h.replace("\n", " ") for h in model(frame[text].fillna("").tolist())])

    return rows.mapInPandas(run, schema)


def throughput(totals: DataFrame) -> DataFrame:
    """totals(sentences, tokens_out, seconds) with sents_per_sec and tokens_out_per_sec, null where no time passed."""
    return totals.select("*", F.try_divide("sentences", "seconds").alias("sents_per_sec"), F.try_divide("tokens_out", "seconds").alias("tokens_out_per_sec"))


def output_name(system: str, limit: int | None) -> str:
    return system if limit is None else f"{system}.limit{limit}"
