"""Time the headline queries: one JSON line with seconds per query and their sum.

`BENCH_SF_DIR` names the tables, `BENCH_CPUS` the cores. Each query runs once on the smallest
tables beside them, if there are any, so that classes are loaded and expressions compiled, and
then once timed; results go to a sink that drops the rows. Queries over captures include the
encoding of the captures from the tables.
"""

from __future__ import annotations

import json
import os
import time

from vidlake.checks.queries import registered
from vidlake.session import builder

HEADLINE = [
    "channel_totals", "videos_flat", "videos_fallback", "comments_flat", "comments_limited",
    "comments_of_videos", "comment_totals", "embedded_config", "embedded_data", "deep_search",
    "longest_token", "pending_pages", "view_counts", "comment_counts", "durations",
    "text_lengths", "human_figures", "channel_stats", "batch_report", "channel_progress",
    "status_lines", "fail_fast", "export_json", "export_csv", "export_parquet",
    "videos_documents", "streamed_comments", "streamed_totals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        builder("bench").master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        # Small tables: let partitions be small enough for every core to have one.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()

    def run(name: str, tables: str) -> float:
        start = time.perf_counter()
        queries[name](spark, tables).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in HEADLINE:
            run(name, small)
    seconds = {name: run(name, sf_dir) for name in HEADLINE}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
