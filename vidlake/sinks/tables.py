"""Comments and videos as partitioned folders of JSON lines, CSV or Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidlake.functions.human import iso_utc
from vidlake.functions.refs import comments_file_name, safe_name
from vidlake.schemas import COMMENT_FIELDS, VIDEO_FIELDS
from vidlake.sinks.documents import write_videos_json

_JSON = {"ignoreNullFields": "false"}
_CSV = {
    "header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def csv_cell(df: DataFrame, name: str) -> Column:
    """A value as the text of a CSV cell, by its type: missing is empty, nested is JSON."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(c, _JSON)
    elif isinstance(kind, T.TimestampType):
        text = iso_utc(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("")).alias(name)


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Spread by ranges of (keys, order) and sort each range.

    A key with very many rows is cut into several ranges, each written by a task of its own;
    the names of its files sort in the order of its rows.
    """
    columns = [F.col(c) for c in keys + order]
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def _key(name: str) -> Column:
    # Not nullable, so that the writer keeps the order of the rows within a folder.
    return F.coalesce(safe_name(F.col(name)), F.lit(""))


def _write(df: DataFrame, fmt: str, path: str, partitions: list[str], fresh: str) -> int:
    counted = Observation("export")
    df = df.observe(counted, F.count("*").alias("rows"))
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", fresh)
    writer = writer.partitionBy(*partitions)
    if fmt == "csv":
        writer.options(**_CSV).csv(path)
    elif fmt == "parquet":
        writer.option("compression", "snappy").parquet(path)
    else:
        writer.options(**_JSON).json(path)
    return counted.get["rows"]


class _Folder:
    """The folder of an export, whose subfolders are replaced one by one.

    New subfolders are written beside the old ones, under a name that readers pass over. Once all
    are there, a manifest names what is to be replaced and what to be removed: from then on the
    export counts as made, and is put in place, or finished by the next one after a failure. A
    write that fails leaves the old export as it is.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at().getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    def _listed(self, prefix: str, *parts: str) -> list[str]:
        at = self._at(*parts)
        found = self._fs.listStatus(at) if self._fs.exists(at) else []
        return sorted(n for n in (f.getPath().getName() for f in found) if n.startswith(prefix))

    def replace(self, write: Callable[[str], int], channels: DataFrame | None) -> int:
        """`write` fills a new folder; `channels` keep nothing of an earlier export."""
        self.finish()
        name = uuid.uuid4().hex
        rows = write(f"{self.path}/_new-{name}")
        new = self._listed("channel_key=", f"_new-{name}")
        silent = self.spark.createDataFrame([], "value string") if channels is None else (
            self._silent(channels, new))
        # Names go to a text file from the tasks; only its rename makes the export count.
        silent.write.mode("overwrite").text(f"{self.path}/_draft-{name}")
        self._fs.rename(self._at(f"_draft-{name}"), self._at(f"_manifest-{name}"))
        self.finish()
        return rows

    def _silent(self, channels: DataFrame, new: list[str]) -> DataFrame:
        """Names of channels without a new folder."""
        keys = channels.select(_key("channel_ref").alias("value")).distinct()
        # Folder names are escaped; those of the new folders are turned back.
        plain = [self._names.unescapePathName(n.split("=", 1)[1]) for n in new]
        have = self.spark.createDataFrame(
            [("" if n == self._names.DEFAULT_PARTITION_NAME() else n,) for n in plain],
            "value string")
        return keys.join(have, "value", "left_anti").select(
            F.base64(F.encode("value", "UTF-8")).alias("value"))

    def finish(self) -> None:
        """Put complete exports in place, drop incomplete ones. May be done again at any point."""
        for manifest in self._listed("_manifest-"):
            name = manifest.removeprefix("_manifest-")
            for folder in self._listed("channel_key=", f"_new-{name}"):
                self._fs.delete(self._at(folder), True)
                self._fs.rename(self._at(f"_new-{name}", folder), self._at(folder))
            gone = self.spark.read.schema("value string").text(f"{self.path}/{manifest}").select(
                F.decode(F.unbase64("value"), "UTF-8").alias("value"))
            for row in gone.toLocalIterator():
                self._fs.delete(self._at(
                    self._names.getPartitionPathString("channel_key", row["value"])), True)
            self._fs.delete(self._at(manifest), True)
        for left in (*self._listed("_new-"), *self._listed("_draft-")):
            self._fs.delete(self._at(left), True)


def export_comments(comments: DataFrame, fmt: str, path: str, per_video: bool = False,
                    channels: DataFrame | None = None) -> int:
    """Write comments in order of their video and place; returns the number of rows.

    `comments` carries `channel_ref`, `video_id`, `order` and `pos` besides the exported fields.
    The folder of a channel is replaced as a whole; a column `file_name` holds the name of the
    video's own file. With `per_video` each video gets a folder of that name instead, which
    suits small exports, and the export replaces everything under `path`. `channels` lists, by
    `channel_ref`, channels whose folder goes if they have no comment now. Folders are replaced
    once all are written; a failed export leaves the earlier one as it is.
    """
    ext = "jsonl" if fmt in ("json", "jsonl") else fmt
    rows = comments.select(
        _key("channel_ref").alias("channel_key"), "order", "pos",
        F.coalesce(comments_file_name(F.col("order"), F.col("video_id"), ext), F.lit(""))
        .alias("file_name"),
        *[(iso_utc(F.col(c)).alias(c) if c == "scraped_at" else F.col(c))
          for c in COMMENT_FIELDS],
    )
    fields = sorted(COMMENT_FIELDS) if fmt == "csv" else COMMENT_FIELDS
    rows = in_order(rows, ["channel_key"], ["order", "file_name", "pos"])
    cells = [csv_cell(rows, c) if fmt == "csv" else F.col(c) for c in fields]
    if per_video:
        out = rows.select("channel_key", F.col("file_name").alias("video_key"), *cells)
        return _write(out, fmt, path, ["channel_key", "video_key"], "static")
    out = rows.select("channel_key", *cells, "file_name")
    return _Folder(comments.sparkSession, path).replace(
        lambda new: _write(out, fmt, new, ["channel_key"], "static"), channels)


def export_videos(videos: DataFrame, fmt: str, path: str,
                  channels: DataFrame | None = None) -> int:
    """Write videos in order, one folder per channel; returns the number of rows.

    JSON is one document per channel, see `write_videos_json`, where `channels` (`channel_ref`
    and, for JSON, `scraped_at`) get one even without videos. In the other formats the folders
    of those of these channels that have no video now are removed.
    """
    if fmt not in ("csv", "parquet"):
        return write_videos_json(videos, path, channels=channels)
    rows = in_order(
        videos.select(_key("channel_ref").alias("channel_key"), *VIDEO_FIELDS),
        ["channel_key"], ["order"])
    cells = [csv_cell(rows, c) if fmt == "csv" else F.col(c) for c in VIDEO_FIELDS]
    out = rows.select("channel_key", *cells)
    return _Folder(videos.sparkSession, path).replace(
        lambda new: _write(out, fmt, new, ["channel_key"], "static"), channels)
