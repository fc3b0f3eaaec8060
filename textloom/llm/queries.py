"""The operators' queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import ann, byte_bpe, fingerprints, id_files, packing, pii, quality, shingle_join, urls, warc
from textloom.llm.common import table
from textloom.sources.files import spread


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(spread(table(spark, sf_dir, "documents")))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spread(table(spark, sf_dir, "pages")))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(spread(table(spark, sf_dir, "documents")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"), added=True)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.link_components(spread(table(spark, sf_dir, "documents")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spread(table(spark, sf_dir, "pages")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.file_round_trip(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"), added=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_urls": op2_urls,
    "op3_ann": op3_ann,
    "op4_pii": op4_pii,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_packing": op6_packing,
    "op7_ngram_join": op7_ngram_join,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_id_files": op10_id_files,
}
ORACLES: dict[str, str] = {"op2_urls": urls.oracle()}
