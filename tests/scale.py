"""Time the two main flows on many captures, half of them of one channel or one video.

    python tests/scale.py [sf_dir] [copies]

Copies of the captures encoded from the tables are given new places: even copies make one long
chain, odd ones many short ones. Prints seconds, records, and how evenly the rows of the last
stage are spread (the largest partition's share against an even one).
"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from vidlake.checks import captures as cap  # noqa: E402
from vidlake.operators import comments as C  # noqa: E402
from vidlake.operators import videos as V  # noqa: E402
from vidlake.session import builder, stage, staged  # noqa: E402

#: More responses than any chain of the encoded captures has.
CHAIN = 1000


def copied(df, copies: int, key: str, hot: str):
    """`copies` copies of every response; the even copies form one chain called `hot`."""
    n = F.col("_copy")
    numbered = stage(df, "base", row_id=True).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    rows = numbered.select(
        *[c for c in df.columns if c not in (key, "response_seq")],
        F.when(n % 2 == 0, F.lit(hot)).otherwise(F.concat_ws("/", key, (n % 100).cast("string")))
        .alias(key),
        F.when(n % 2 == 0, F.pmod(F.xxhash64("row_id", "_copy"), F.lit(1 << 30)))
        .otherwise(n * CHAIN + F.col("response_seq")).cast("int").alias("response_seq"),
    )
    return stage(rows.repartition(64), "copies")


def timed(label: str, action):
    start = time.perf_counter()
    result = action()
    print(f"{label:34s}{time.perf_counter() - start:8.1f} s", flush=True)
    return result


def spread(df, label: str) -> None:
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    even = sum(counts) / len(counts)
    print(f"{label:34s}{sum(counts):10,} records in {len(counts)} partitions, "
          f"largest {max(counts) / even:.2f} x even", flush=True)


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 150
    spark = (
        builder("scale").master("local[8]").config("spark.sql.shuffle.partitions", "64")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.autoBroadcastJoinThreshold", "64k")  # as if the tables were large
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    bodies = copied(V.channel_responses(*cap.video_captures(spark, sf_dir)), copies,
                    "channel_ref", "@hot")
    size = bodies.agg(F.count("*"), F.sum(F.length("body"))).first()
    print(f"video pages: {size[0]:,} bodies, {size[1] / 1e9:.2f} GB")
    parsed = timed("parse and stage", lambda: staged(V.parse_video_bodies(bodies), "pages"))
    timed("place, unfold, normalise", lambda: noop(V.videos(parsed)))
    spread(V.videos(parsed), "videos")
    timed("first 100 of each channel", lambda: noop(V.videos(parsed, 100)))

    responses = cap.comment_captures(spark, sf_dir).filter(
        "sort_by = 1 and body not like '%externalErrorMessage%' and body like '%commentId%'")
    responses = copied(responses, copies, "video_id", "hot")
    size = responses.agg(F.count("*"), F.sum(F.length("body"))).first()
    print(f"comment responses: {size[0]:,} bodies, {size[1] / 1e9:.2f} GB")
    parsed = timed("parse and stage", lambda: staged(C.parse_comment_bodies(responses), "pages"))
    timed("place, unfold, normalise", lambda: noop(C.comments(C.number_responses(parsed))))
    spread(C.comments(C.number_responses(parsed)), "comments")
    timed("first 100 of each video", lambda: noop(C.comments(
        C.number_responses(parsed, per_video_limit=100), 100)))


if __name__ == "__main__":
    main()
