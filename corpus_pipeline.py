"""A corpus pipeline: quality classifier, near-duplicate join, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the next stage reads back from
Parquet. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import packing, pii, quality, shingle_join
from textloom.llm.common import by_ids, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; labels are those of the whole corpus."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the least doc_id, of rows that share it the least text.

    Documents without words link with nothing and stay, and so do rows without a doc_id.
    """
    ids = shingle_join.link_components(docs).where("doc_id IS NOT NULL").groupBy("doc_id")
    marks = ids.agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("rows"))
    # Ids that go or that rows share are fewer than the others, and written once: the plan of the links is made and run once.
    marks = written(marks.where("NOT stays OR rows > 1").select("doc_id", F.col("stays").alias("repeated")), "marks")
    single = by_ids(docs, marks.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    # Rows that share a doc_id are few: only those are compared with one another.
    several = by_ids(docs, marks.where("repeated").select("doc_id"), "doc_id", "left_semi")
    return single.union(several.orderBy("doc_id", "text").dropDuplicates(["doc_id"]).select(*docs.columns))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind."""
    return pii.redact_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in windows that hold each source by its share; null and empty texts are the end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

#: The classifier's network can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "pipeline")
    return docs
