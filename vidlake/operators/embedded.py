"""JSON objects that pages carry in their scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake.functions.jsonscan import balanced_object_column

# How a page assigns its client settings and its data. The first pattern of each
# pair captures the object up to the statement's end, the second finds its opening brace.
CONFIG = "ytcfg"
CONFIG_OBJECT = r"(?s)ytcfg\.set\s*\(\s*(\{.+?\})\s*\)\s*;"
CONFIG_OPENING = r"ytcfg\.set\s*\(\s*\{"
DATA = "ytInitialData"
DATA_OBJECT = (
    r"(?s)(?:window\s*\[\s*[\"']ytInitialData[\"']\s*\]|ytInitialData)\s*=\s*(\{.+?\})\s*;"
    r"\s*(?:var\s+meta|</script|\n)"
)
DATA_OPENING = r"(?:window\s*\[\s*[\"']ytInitialData[\"']\s*\]|ytInitialData)\s*=\s*\{"


def is_json_object(text: Column) -> Column:
    """Whether `text` parses as a JSON object; NULL counts as no."""
    return F.json_object_keys(text).isNotNull()


def _extract(df: DataFrame, html: str, out: str, name: str, pattern: str, opening: str,
             robust: bool) -> DataFrame:
    matched = F.nullif(F.regexp_extract(F.col(html), pattern, 1), F.lit(""))
    df = df.withColumn("_matched", matched)
    scan = F.col("_matched").isNull()
    if robust:
        scan = scan | ~is_json_object(F.col("_matched"))
    scanned = balanced_object_column(F.when(scan, F.col(html)), opening)
    best = F.coalesce(scanned, F.col("_matched")) if robust else F.coalesce("_matched", scanned)
    df = df.withColumn("_object", best)
    df = df.withColumn("_valid", is_json_object(F.col("_object")))
    valid = F.col("_valid")
    return (
        df.withColumn(out, F.when(valid, F.col("_object")))
        .withColumn(
            f"{out}_error",
            F.when(F.col("_object").isNull(), F.lit(f"Failed to extract {name}"))
            .when(~valid, F.lit(f"Failed to parse {name} JSON")),
        )
        .drop("_matched", "_object", "_valid")
    )


def extract_config(df: DataFrame, html: str = "html", out: str = "config",
                   robust: bool = False) -> DataFrame:
    """Add the page's client settings as JSON text and, where that fails, the error.

    A regular expression finds the object; only pages where it finds nothing are scanned for
    balanced braces. With `robust`, pages whose match does not parse are scanned as well.
    """
    return _extract(df, html, out, CONFIG, CONFIG_OBJECT, CONFIG_OPENING, robust)


def read_pages(pages: DataFrame) -> DataFrame:
    """Every page's `data`, and in `error` why it cannot be used: settings are looked for first,
    then data. The html is read once and dropped."""
    rest = [c for c in pages.columns if c != "html"]
    return extract_data(extract_config(pages)).select(
        *rest, "data", F.coalesce("config_error", "data_error").alias("error"))


def latest_pages(pages: DataFrame, *columns: str) -> DataFrame:
    """These columns of the latest capture of each page, a page being a channel's or a video's."""
    keys = ["channel_ref", "video_id"]
    capture = F.struct("fetched_at", *columns)
    return pages.groupBy(*keys).agg(F.max(capture).alias("_c")).select(*keys, "_c.*")


def page_errors(pages: DataFrame) -> DataFrame:
    """Pages that cannot be used, with the reason; `pages` holds html or comes from `read_pages`.

    Where `channel_ref`, `video_id` and `fetched_at` tell captures of one page apart, the latest
    counts; only these columns and the reason are shuffled. Pages of other tables all count.
    """
    read = pages if "error" in pages.columns else read_pages(pages)
    read = read.drop("data")
    if {"channel_ref", "video_id", "fetched_at"} <= set(read.columns):
        rest = [c for c in read.columns if c not in ("channel_ref", "video_id", "fetched_at")]
        read = latest_pages(read, *rest).select(*read.columns)
    return read.filter("error is not null")


def extract_data(df: DataFrame, html: str = "html", out: str = "data",
                 robust: bool = False) -> DataFrame:
    """Add the page's data as JSON text and, where that fails, the error; see `extract_config`."""
    return _extract(df, html, out, DATA, DATA_OBJECT, DATA_OPENING, robust)
