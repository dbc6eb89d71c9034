"""Streams of parsed comment responses, and what is read from their output at any time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vidlake import SOURCE, schemas
from vidlake.operators.accumulate import accumulate
from vidlake.operators.comments import (
    SORT_RECENT,
    comments,
    ends_chain,
    number_responses,
    parse_comment_bodies,
)

_KEYS = ["channel_ref", "video_id", "sort_by"]
#: Name of the metrics that every batch of `stream_comments` is observed by.
OBSERVED = "written"
_FIGURES = ["comments", "characters", "hearts"]


def read_landing(spark: SparkSession, path: str, fmt: str = "parquet",
                 files_per_batch: int | None = None) -> DataFrame:
    """A stream of `response_captures` files arriving in a folder."""
    reader = spark.readStream.schema(schemas.RESPONSE_CAPTURES).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _append(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def _parsed(responses: DataFrame, sort_by: int) -> DataFrame:
    """The parsed responses of a batch, parsed on all cores.

    One file that landed is one task, however many responses it holds. Spark deals the rows of a
    large batch to more tasks, and leaves those of a small one together.
    """
    return parse_comment_bodies(responses.hint("rebalance"), sort_by)


def stream_comments(responses: DataFrame, out: str, checkpoint: str,
                    sort_by: int = SORT_RECENT) -> StreamingQuery:
    """Parse all that has landed and append one row per response to `out`.

    Stateless: the toolbar lookup stays within a body. Where a chain ends, which capture of a
    response is the latest, and numbers within a video need all responses; `landed_comments`
    finds them. A restart after a failure continues at the checkpoint; the file sink writes
    every batch exactly once.
    """
    rows = _parsed(responses, sort_by)
    return _append(rows.observe(OBSERVED, F.sum("n_comments").alias("comments")), out, checkpoint)


def landed_comments(spark: SparkSession, out: str, strict: bool = False,
                    videos: DataFrame | None = None, per_video_limit: int | None = None,
                    source: str = SOURCE) -> DataFrame:
    """The comments of all responses written to `out` so far, exactly as the batch job would
    number, end and limit them; bodies are not parsed again."""
    numbered = number_responses(spark.read.parquet(out), strict, videos, per_video_limit)
    return comments(numbered, per_video_limit, source)


def written_comments(spark: SparkSession, out: str) -> int:
    """Comments in the responses written to `out` so far, whatever the number of batches.

    Counted from the sink's own log and one narrow column of the files it lists.
    """
    return spark.read.parquet(out).agg(F.sum("n_comments")).first()[0] or 0


class Progress:
    """How many comments a stream has written, told while it runs.

    Every batch is counted as it is written, by observed metrics, and the counts are kept under
    the batch's number in `folder`: a batch that is repeated after a failure counts once, and a
    restarted stream goes on from there. No rows are read for it. A batch that was committed
    without its count (the driver died in between) makes `total` count what is in `out` instead.
    """

    def __init__(self, spark: SparkSession, out: str, checkpoint: str, folder: str) -> None:
        self.spark, self.out, self.checkpoint, self.folder = spark, out, checkpoint, folder
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(folder).getFileSystem(
            spark._jsparkSession.sessionState().newHadoopConf())
        self._known = self.batches()

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop.Path(folder)
        found = self._fs.listStatus(at) if self._fs.exists(at) else []
        return [f.getPath().getName() for f in found]

    def batches(self) -> dict[int, int]:
        """Comments of each batch counted so far."""
        pairs = (n.split("-") for n in self._names(self.folder) if n[0].isdigit())
        return {int(batch): int(count) for batch, count in pairs}

    def follow(self, query: StreamingQuery, each: Callable[[int], None] | None = None,
               pause: float = 0.2) -> None:
        """Until the stream ends, note what its batches wrote, and call `each` with the number of
        comments whenever it grows."""
        while True:
            ended = query.awaitTermination(pause)
            if self._note(query) and each:
                each(sum(self._known.values()))
            if ended:
                return

    def _note(self, query: StreamingQuery) -> bool:
        new = False
        for p in query.recentProgress:
            batch, row = p.batchId, p.observedMetrics.get(OBSERVED)
            read = any(x.startOffset != x.endOffset for x in p.sources)
            if batch not in self._known and read:
                # Where the scan drops every row of a batch, there is nothing to observe.
                self._known[batch] = (row["comments"] or 0) if row else 0
                self._fs.create(self._hadoop.Path(
                    f"{self.folder}/{batch}-{self._known[batch]}"), True).close()
                new = True
        return new

    def total(self) -> int:
        committed = {int(n) for n in self._names(f"{self.checkpoint}/commits") if n.isdigit()}
        if committed - self._known.keys():
            return written_comments(self.spark, self.out)
        return sum(self._known.values())


def live_totals(responses: DataFrame, out: str, checkpoint: str,
                sort_by: int = SORT_RECENT) -> StreamingQuery:
    """Append the figures of each response that has landed to `out`: its comments, their
    characters and hearts, and whether it ends its chain. See `latest_totals`."""
    rows = _parsed(responses, sort_by)
    sizes = F.aggregate("comments", F.lit(0).cast("bigint"),
                        lambda n, c: n + F.coalesce(c["text_length"], F.lit(0)))
    return _append(rows.select(
        *_KEYS, "response_seq", "fetched_at", ends_chain().cast("int").alias("ends"),
        F.col("n_comments").cast("bigint").alias("comments"), sizes.alias("characters"),
        F.size(F.filter("comments", lambda c: c["heart"])).cast("bigint").alias("hearts"),
    ), out, checkpoint)


def latest_totals(spark: SparkSession, out: str) -> DataFrame:
    """Totals per channel of all that `live_totals` has written: `comments`, `characters` and
    `hearts` of the latest capture of each response before the end of its chain.

    The same as totals of the batch job's comments. Only a few numbers per response are read
    and shuffled, in buckets of a chain, so no video or channel lands in one task.
    """
    capture = F.struct("fetched_at", "ends", *_FIGURES)
    latest = spark.read.parquet(out).groupBy(*_KEYS, "response_seq").agg(
        F.max(capture).alias("_c")).select(*_KEYS, "response_seq", "_c.*")
    kept = accumulate(latest, _KEYS, "response_seq", {"_ends": F.col("ends")}).filter("_ends = 0")
    totals = kept.groupBy("channel_ref").agg(*[F.sum(c).alias(c) for c in _FIGURES])
    return totals.filter("comments > 0")
