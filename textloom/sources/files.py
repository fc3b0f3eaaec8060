"""Text, line and JSON-lines sources, and sinks."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.functions import text as T

LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


#: A table below this size may be one row group of one file, which one task would read.
SMALL_BYTES = 32 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows; those of a table below SMALL_BYTES dealt to as many tasks as there are cores. Larger tables stay as their files cut them."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else rows


def dealt(rows: DataFrame, each: int = 3) -> DataFrame:
    """rows, dealt to so many tasks for each core where they come in fewer: for work on a row that takes far longer than to send it."""
    tasks = each * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's stem) and text of whole files, normalised; a byte-order mark goes."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("doc_id"), F.col("value").alias("text"))
    return rows.withColumn("text", T.normalize_unicode(F.regexp_replace("text", "^\ufeff", "")))


def document_ids(docs: DataFrame) -> DataFrame:
    """doc_id in numeric order."""
    return docs.select("doc_id").distinct().orderBy(F.col("doc_id").cast("long"))


def configuration(path: str) -> dict:
    """A YAML file of settings; an empty file has none."""
    import yaml  # nothing else needs it

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def overriding(base: DataFrame, override: DataFrame) -> DataFrame:
    """base, but for ids that override has."""
    return base.join(override.select("doc_id"), "doc_id", "left_anti").unionByName(override)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, seg_idx, line of files, line ends as Python's splitlines has them."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", LINE_END).alias("l"))
    rows = rows.withColumn("l", F.when(F.element_at("l", -1) == "", F.slice("l", F.lit(1), F.size("l") - 1)).otherwise(F.col("l")))
    return rows.select("path", F.posexplode("l").alias("seg_idx", "line"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A row for each line that isn't blank; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def predictions(spark: SparkSession, folder: str, split: str, lang: str) -> DataFrame:
    """system, seg_idx, hyp of the files <system>.<split>.<lang> in a folder."""
    rows = lines(spark, f"{folder.rstrip('/')}/*.{split}.{lang}")
    system = F.regexp_extract("path", rf"([^/]+)\.{re.escape(split)}\.{re.escape(lang)}$", 1)
    return rows.select(system.alias("system"), "seg_idx", F.col("line").alias("hyp")).where("system <> 'ref'")


def other_systems(rows: DataFrame, known: list[str]) -> DataFrame:
    """system: those of rows that aren't known, in order."""
    return rows.select("system").distinct().where(~F.col("system").isin(*known)).orderBy("system")


def with_pair_ids(segments: DataFrame, pairs: DataFrame | None, split: str) -> DataFrame:
    """segments(seg_idx, …) with pair_id and doc_id of pairs(seg_idx, pair_id, doc_id), if these are exactly as many; else all get <split>-<place> and no doc_id."""
    own = F.concat(F.lit(f"{split}-"), F.col("seg_idx").cast("string"))
    if pairs is not None and pairs.count() == segments.count():
        return segments.join(pairs.select("seg_idx", "pair_id", "doc_id"), "seg_idx", "left").withColumn("pair_id", F.coalesce("pair_id", own))
    return segments.withColumn("pair_id", own).withColumn("doc_id", F.lit(None).cast("string"))


def with_labels(systems: DataFrame, configured: dict[str, str], meta: DataFrame | None = None) -> DataFrame:
    """systems with label: the configured one, else that of meta(system, label), else the name."""
    given = F.create_map(*(F.lit(x) for item in configured.items() for x in item))[F.col("system")] if configured else F.lit(None).cast("string")
    if meta is not None:
        systems = systems.join(meta.select("system", F.col("label").alias("__meta")), "system", "left")
    return systems.withColumn("label", F.coalesce(given, *([F.col("__meta")] if meta is not None else []), "system")).drop("__meta")


def aligned_systems(predictions: DataFrame, n: int) -> DataFrame:
    """The rows of systems that have exactly n segments; others are left out."""
    whole = predictions.groupBy("system").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == n).select("system")
    return predictions.join(whole, "system", "left_semi")


def write_alignments(pairs: DataFrame, path: str) -> None:
    """Every pair, dropped ones too, as JSON lines by document and place."""
    pairs.orderBy("doc", "pair").write.json(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """Kept rows as JSON lines, a folder for each split, by document and place where these are there."""
    kept = rows.where("kept").drop("kept", "drop_reason") if "kept" in rows.columns else rows
    order = [c for c in ("doc", "doc_id", "pair", "pair_id") if c in kept.columns]
    kept.repartitionByRange("split", *order).sortWithinPartitions("split", *order).write.partitionBy("split").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A JSON object for each row, in the rows' order."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def write_predictions(rows: DataFrame, path: str, place: str = "seg_idx") -> None:
    """hyp line by line in order, line breaks within as spaces."""
    rows.orderBy(place).select(F.regexp_replace("hyp", "[\r\n]+", " ").alias("value")).write.text(path)


def cached_vectors(spark: SparkSession, texts: DataFrame, path: str, embed) -> DataFrame:
    """texts(text) with key (SHA-1 of the text) and vector. Vectors are kept at path: only texts that it lacks are embedded.

    embed turns a list of texts to a list of vectors, a batch at a time.
    """
    wanted = texts.select("text", F.sha1("text").alias("key")).distinct()
    schema = "key string, vector array<double>"
    try:
        known = spark.read.schema(schema).parquet(path)
        missing = wanted.join(known.select("key"), "key", "left_anti")
    except AnalysisException:  # nothing is kept yet
        missing = wanted

    def run(frames):
        for frame in frames:
            yield frame[["key"]].assign(vector=[[float(x) for x in v] for v in embed(frame["text"].tolist())])

    missing.select("key", "text").mapInPandas(run, schema).write.mode("append").parquet(path)
    return wanted.join(spark.read.schema(schema).parquet(path), "key")
