from __future__ import annotations

import datetime as dt

from vidlake.operators import progress, stats
from vidlake.schemas import RUN_LOG, VIDEO_LOG

T0 = dt.datetime(2025, 1, 5, 12, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


LOG = [
    ("r", 1, "@a", "ok", None, at(0), at(90)),
    ("r", 2, "@b", "failed", "boom", at(90), at(91.5)),
    ("r", 3, "@a", "ok", None, at(92), at(100.25)),  # a channel listed twice
    ("r", 5, "@c", "ok", None, at(101), at(102)),
    ("q", 1, "@a", "ok", None, at(0), at(1)),
]
LISTED = [("r", i, c) for i, c in enumerate(["@a", "@b", "@a", "@skipped", "@c", "@late"], 1)] + [
    ("q", 1, "@a"), ("unstarted", 1, "@a")]


def tables(spark):
    log = spark.createDataFrame(LOG, RUN_LOG)
    listed = spark.createDataFrame(LISTED, "run_id string, idx int, channel string")
    videos = spark.createDataFrame([("@a",)] * 3 + [("@b",)], "channel_ref string")
    comments = spark.createDataFrame([("@a",)] * 5, "channel_ref string")
    sizes = spark.createDataFrame([("@a", 2**20), ("@a", 2**19), ("@c", 1)],
                                  "channel_ref string, bytes long")
    return listed, log, stats.channel_stats(log, videos, comments, sizes)


def test_channel_stats(spark):
    rows = {(r.run_id, r.idx): (r.channel, r.videos, r.comments, r.bytes_mb, r.duration_sec,
                                r.status, r.error) for r in tables(spark)[2].collect()}
    assert rows == {
        ("r", 1): ("@a", 3, 5, 1.5, 90.0, "ok", None),
        ("r", 2): ("@b", 0, 0, 0.0, 0.0, "failed", "boom"),
        ("r", 3): ("@a", 3, 5, 1.5, 8.25, "ok", None),
        ("r", 5): ("@c", 0, 0, 2**-20, 1.0, "ok", None),
        ("q", 1): ("@a", 3, 5, 1.5, 1.0, "ok", None),
    }


def test_comments_of_failed_videos_do_not_count(spark):
    log = spark.createDataFrame(LOG, RUN_LOG).filter("run_id = 'q'")
    keys = "channel_ref string, video_id string"
    videos = spark.createDataFrame([("@a", "v"), ("@a", "w")], keys)
    comments = spark.createDataFrame([("@a", "v")] * 3 + [("@a", "w")] * 4, keys)
    failed = spark.createDataFrame([("@a", "v"), ("@a", None), ("@b", "w")], keys)
    sizes = spark.createDataFrame([], "channel_ref string, bytes long")
    (row,) = stats.channel_stats(log, videos, comments, sizes, failed).collect()
    assert (row.videos, row.comments, row.bytes_mb) == (2, 4, 0.0)
    sizes = spark.createDataFrame(
        [("@a", "v", 2**20), ("@a", "w", 2**21)], "channel_ref string, video_id string, bytes long")
    (row,) = stats.channel_stats(log, videos, comments, sizes, failed).collect()
    assert row.bytes_mb == 2.0
    listed = videos.union(spark.createDataFrame([("@a", "none")], keys))
    counts = {r.video_id: r.comments for r in stats.comments_per_video(comments, listed).collect()}
    assert counts == {"v": 3, "w": 4, "none": 0}


def test_batch_report(spark):
    listed, log, rows = tables(spark)
    report = {r.run_id: tuple(r)[1:] for r in stats.batch_report(listed, log, rows).collect()}
    assert report == {
        "r": ("2025-01-05_12-00-00", at(0), at(102), 6, 3, 1, 6, 10, 3.0, 102.0),
        "q": ("2025-01-05_12-00-00", at(0), at(1), 1, 1, 0, 3, 5, 1.5, 1.0),
        "unstarted": (None, None, None, 1, 0, 0, 0, 0, 0.0, 0.0),
    }
    shown = {r.idx: tuple(r)[3:] for r in
             stats.reported_channels(rows).filter("run_id = 'r'").collect()}
    assert shown[1] == (3, 5, 1.5, 90.0, "ok", None)
    assert shown[2] == (None, None, None, None, "failed", "boom")
    assert shown[3][3] == 8.2  # 8.25 is a tie and goes to the even digit
    lines = {(r.run_id, r.idx): r.line for r in stats.channel_lines(listed, rows).collect()}
    assert lines["r", 1] == "[1/6] @a — 3 videos — 5 comments — OK (1.5MB, 1m 30s)"
    assert lines["r", 2] == "[2/6] @b — ERROR: boom"


def test_errors_and_unreached_channels(spark):
    listed, log, _ = tables(spark)
    log_lines = [r.line for r in stats.error_log(log).collect()]
    assert log_lines == ["2025-01-05T12:01:31.500000+00:00 | @b | boom"]
    assert [tuple(r) for r in stats.error_counts(log.filter("status = 'failed'")).collect()] == [
        ("boom", 1)]
    kept = {(r.run_id, r.idx) for r in progress.until_failure(log).collect()}
    assert kept == {("r", 1), ("r", 2), ("q", 1)}
    state = {(r.run_id, r.idx): r.status for r in stats.listed_channels(listed, log).collect()}
    assert state == {("r", 1): "ok", ("r", 2): "failed", ("r", 3): "ok", ("r", 4): None,
                     ("r", 5): "ok", ("r", 6): None, ("q", 1): "ok", ("unstarted", 1): None}


def test_dry_run(spark):
    rows = [("@a", True), ("@a", None), ("@a", False), ("@b", None)]
    videos = spark.createDataFrame(rows, "channel_ref string, has_comments boolean")

    def run(df, limit=None):
        return {tuple(r) for r in stats.dry_run(df, limit).collect()}

    assert run(videos) == {("@a", 3, 2, 1000), ("@b", 1, 1, 500)}
    assert run(videos.drop("has_comments"), 10) == {("@a", 3, 3, 30), ("@b", 1, 1, 10)}
    assert run(videos, 0) == run(videos)


def brute_progress(rows):
    """Running figures of one channel, one video after the other."""
    done = comments = size = 0
    passed, times, out = 0.0, [], []
    for (_, total, order, _, status, n, b, sec, _) in sorted(rows, key=lambda r: r[2]):
        passed += sec
        if status != "ok":
            continue
        done, comments, size = done + 1, comments + n, size + b
        times.append(sec)
        eta = sum(times) / len(times) * (total - done) if done < total else None
        out.append((order, done, comments, size, passed, done / total * 100, eta))
    return out


def test_progress(spark):
    rows = [("@a", 12, i, f"v{i}", "failed" if i in (3, 10) else "ok", i * 100, i * 50000,
             i * 0.5, None) for i in range(1, 13)]
    rows += [("@b", 1, 1, "w", "ok", 1, 10, 1.0, None), ("@c", 2, 1, "x", "failed", 0, 0, 1.0, None)]
    log = spark.createDataFrame(rows, VIDEO_LOG)
    table = progress.channel_progress(log)
    got = {}
    for r in table.orderBy("channel", "order").collect():
        got.setdefault(r.channel, []).append((
            r.order, r.completed, r.total_comments, r.total_bytes, r.elapsed, r.percent, r.eta_sec))
    assert got == {c: brute_progress([r for r in rows if r[0] == c]) for c in ("@a", "@b")}
    lines = {(r.channel, r.order): r.line for r in progress.status_lines(table).collect()}
    assert lines == {
        ("@a", 5): "Videos: 4/12 (33.3%) | Comments: 1,200 | Data: 585.9KB | Time: 7s | ETA: 12s",
        ("@a", 12): "Videos: 10/12 (83.3%) | Comments: 6,500 | Data: 3.1MB | Time: 39s | ETA: 6s",
        ("@b", 1): "Videos: 1/1 (100.0%) | Comments: 1 | Data: 10B | Time: 1s",
    }
    summary = {r.channel: r.summary for r in stats.final_summary(log).collect()}
    assert summary["@a"].splitlines() == [
        "  Total Videos:   10", "  Total Comments: 6,500", "  Total Data:     3.1MB",
        "  Total Time:     39s"]
    assert summary["@c"].splitlines()[0] == "  Total Videos:   0"


def test_comment_progress(spark):
    cases = [  # comments, seconds, expected -> percent, eta
        (50, 10.0, 200, "25.0%", "30s"), (200, 10.0, 200, "100.0%", "almost done"),
        (300, 10.0, 200, "150.0%", "almost done"), (50, 0.5, 200, "25.0%", None),
        (0, 10.0, 200, "0.0%", None), (50, 10.0, None, None, None), (50, 10.0, 0, None, None),
        (1, 1.0, 16, "6.2%", "15s"),
    ]
    rows = [("@a", 9, i, f"v{i}", "ok", n, 0, sec, want) for i, (n, sec, want, *_) in
            enumerate(cases)]
    log = spark.createDataFrame(rows, VIDEO_LOG)
    got = [(r.percent_text, r.eta) for r in
           progress.comment_progress(log).orderBy("order").collect()]
    assert got == [tuple(c[3:]) for c in cases]
    limited = progress.comment_progress(log, limit=100).orderBy("order").collect()
    assert [r.percent_text for r in limited[:2]] == ["50.0%", "200.0%"]
