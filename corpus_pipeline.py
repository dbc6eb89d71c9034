"""A corpus made ready for training: five stages, each written before the next one reads it."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidlake.llm import decontam, jaccard, language, lines, packing
from vidlake.llm.queries import TOKENIZER
from vidlake.llm.sent import take_back
from vidlake.session import stage


#: Near copies share at least so many percent of their runs of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*like.columns)


def _alone(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, after what earlier stages sent to the executors is taken back: their rows are
    written."""
    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        take_back()
        return step(spark, docs, sf_dir)
    return run


@_alone
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the classifier takes for one of the languages labelled here, by a
    bound from held-out rows; texts without a letter, and null ones, go. Without anything to learn
    from, all texts with a letter stay."""
    return _columns(language.recognised(docs), docs)


@_alone
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of lower id has, too. All documents stay."""
    return _columns(lines.drop_shared_lines(docs), docs)


@_alone
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id. Rows without an id stay."""
    gone = jaccard.linked(docs, size=NEAR_WORDS, percent=NEAR_PERCENT).where(
        "component_id <> doc_id").select("doc_id").distinct()
    return docs.join(stage(gone, "near-duplicates"), "doc_id", "left_anti").select(*docs.columns)


@_alone
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the passages of benchmark items cut out of them. All documents stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _columns(decontam.without_passages(docs, benchmark), docs)


@_alone
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a training sequence."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", languages), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("packing", sequences),
]

#: Kernels, prefix orders and genetic packing have no SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
