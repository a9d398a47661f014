"""The corpus pipeline: language, quality, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet and reads it again as the next
stage's docs. All but the last return the columns of `documents`; the mix repeats rows, so a doc_id may then stand twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from halocline.llm import cotraining, ngram_join, packing, ppm_langid, source_schedule
from halocline.llm.common import staged
from halocline.llm.queries import BYTE_BPE, table, vocabulary

#: Trained stages and the linear program have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ppm_langid.keep_identified(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotraining.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_schedule.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, placed = packing.pack_documents(docs, vocabulary(BYTE_BPE))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("quality_classifier", quality_classifier), ("near_copies", near_copies), ("source_mix", source_mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
