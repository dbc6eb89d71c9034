"""Captured pages and responses as tables with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidlake import schemas
from vidlake.operators.accumulate import accumulate
from vidlake.operators.nested import is_empty
from vidlake.session import ROW_ID, staged


def _read(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """`page_captures` from Parquet, JSON lines or any other format Spark reads."""
    return _read(spark, path, schemas.PAGE_CAPTURES, fmt)


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """`response_captures`, likewise."""
    return _read(spark, path, schemas.RESPONSE_CAPTURES, fmt)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of saved pages: one row per file, its path as `url`."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"),
        F.col("value").alias("html"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
    )


def until_empty(responses: DataFrame, keys: list[str], seq: str = "response_seq") -> DataFrame:
    """Responses of each chain before its first empty body, each by its latest capture.

    Places are found from narrow columns, in buckets of a chain, so that no chain lands in one
    task; bodies are then picked by row id and so spread evenly. Keys must not be NULL.
    """
    rows = staged(responses, "responses")
    stamp = ["fetched_at"] if "fetched_at" in responses.columns else []
    capture = F.struct(*stamp, ROW_ID, is_empty(F.col("body")).cast("int").alias("_empty"))
    latest = rows.groupBy(*keys, seq).agg(F.max(capture).alias("_c")).select(*keys, seq, "_c.*")
    kept = accumulate(latest, keys, seq, {"_ends": F.col("_empty")}).filter("_ends = 0")
    return rows.join(kept.select(ROW_ID), ROW_ID).select(*responses.columns)
