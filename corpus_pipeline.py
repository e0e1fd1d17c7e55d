"""The corpus pipeline: documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of ``documents``; every decision takes effect:

1. language: texts whose words no learned language explains go (``findling.llm.crf``);
2. quality: texts that fail the base rules or are robust outliers of their language and source go;
3. near duplicates: of every component of similar documents the one row with the least id stays;
4. repeats: bytes of strings of ``PASSAGE_BYTES`` (some 30 to 50 words) that also start elsewhere are cut out of the texts;
5. packing: what is left becomes pieces placed in sequences of at most 2,048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from findling.llm._shared import Workspace
from findling.llm.crf import keep_identified
from findling.llm.packing import pack_documents
from findling.llm.quality import keep_good
from findling.llm.queries import vocabulary
from findling.llm.repeats import without_repeats
from findling.llm.sketch_join import one_of_each


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary())


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packing)]

#: The conditional random field and the covariance estimate can't be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return docs
