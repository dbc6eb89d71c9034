from __future__ import annotations

import csv
import datetime as dt
import glob
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from vidlake import sinks
from vidlake.operators import stats
from vidlake.schemas import COMMENT_FIELDS, VIDEO_FIELDS
from vidlake.sinks.documents import report_lines
from vidlake.sinks.tables import _Folder, export_comments

T0 = dt.datetime(2025, 1, 5, 12, 34, 56)
TEXTS = ["plain", 'a "quoted", text', "two\nlines", "\r\n", " padded ", "é😀", "", ",", '"', "#x",
         "a\\b", "\\", "tab\t"]


def comments(spark, rows):
    data = [(ch, v, o, p, f"{v}.{p}", text, len(text), "1 day ago", "@u", "UC", "0", "1", "p",
             p % 2 == 0, False, T0, "s") for ch, v, o, p, text in rows]
    return spark.createDataFrame(
        data, "channel_ref string, video_id string, order int, pos long, cid string, text string, "
        "text_length int, time string, author string, channel string, votes string, "
        "replies string, photo string, heart boolean, reply boolean, scraped_at timestamp, "
        "source string")


ROWS = [("@a", f"v{o}", o, p, TEXTS[(o + p) % len(TEXTS)]) for o in (1, 2, 10) for p in (1, 2, 3, 4, 5)]
ROWS += [("@b/c", "w", 12345, 1, "x")]


def files(path, key, ext):
    return sorted(glob.glob(os.path.join(path, f"channel_key={key}", "**", f"*.{ext}"),
                            recursive=True))


def want(rows):
    out = []
    for ch, v, o, p, text in rows:
        out.append({
            "cid": f"{v}.{p}", "text": text, "text_length": len(text), "time": "1 day ago",
            "author": "@u", "channel": "UC", "votes": "0", "replies": "1", "photo": "p",
            "heart": p % 2 == 0, "reply": False, "scraped_at": "2025-01-05T12:34:56+00:00",
            "source": "s"})
    return out


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "out")
    shuffled = comments(spark, ROWS[::-1]).repartition(4)
    assert sinks.export_comments(shuffled, "json", path) == len(ROWS)
    got = [json.loads(line) for f in files(path, "a", "json") for line in open(f, encoding="utf-8")]
    assert [list(r) for r in got] == [[*COMMENT_FIELDS, "file_name"]] * 15
    names = [r.pop("file_name") for r in got]
    assert got == want(ROWS[:15])
    assert names == [f"{o:04d}_v{o}.jsonl" for o in (1, 2, 10) for _ in range(5)]
    (line,) = open(files(path, "b_c", "json")[0], encoding="utf-8").readlines()
    assert json.loads(line)["file_name"] == "12345_w.jsonl"


def test_csv(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.export_comments(comments(spark, ROWS), "csv", path)
    got = []
    for f in files(path, "a", "csv"):
        got += csv.DictReader(io.StringIO(open(f, encoding="utf-8", newline="").read()))
    assert list(got[0]) == [*sorted(COMMENT_FIELDS), "file_name"]
    for g, w in zip(got, want(ROWS[:15]), strict=True):
        g.pop("file_name")
        assert g == {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in w.items()}


def test_parquet(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.export_comments(comments(spark, ROWS), "parquet", path)
    assert all(f.endswith(".snappy.parquet") for f in files(path, "a", "parquet"))
    rows = [r.asDict() for r in spark.read.parquet(files(path, "a", "parquet")[0]).collect()]
    assert [{k: r[k] for k in COMMENT_FIELDS} for r in rows] == want(ROWS[:15])


def test_folder_of_a_channel_is_replaced(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.export_comments(comments(spark, ROWS), "json", path)
    again = [("@a", "new", 1, 1, "x")]
    sinks.export_comments(comments(spark, again), "json", path)
    got = [json.loads(line)["cid"] for f in files(path, "a", "json") for line in open(f)]
    assert got == ["new.1"]
    assert files(path, "b_c", "json")  # other channels stay


def test_listed_channels_start_fresh(spark, tmp_path):
    listed = spark.createDataFrame([("@a",), ("@new",)], "channel_ref string")
    path = str(tmp_path / "out")
    sinks.export_comments(comments(spark, ROWS), "json", path, channels=listed)
    rest = comments(spark, [r for r in ROWS if r[0] != "@a"])
    sinks.export_comments(rest, "json", path, channels=listed)
    assert not files(path, "a", "json") and files(path, "b_c", "json")
    path = str(tmp_path / "videos")
    sinks.export_videos(videos(spark, VIDEOS), "csv", path, listed)
    sinks.export_videos(videos(spark, VIDEOS[-1:]), "csv", path, listed)
    assert not files(path, "a", "csv") and files(path, "b", "csv")


def test_documents_are_not_joined_by_their_key(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = sinks.videos_json_lines(videos(spark, VIDEOS))
        plan = lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines()
             if "hashpartitioning(" in line]
    # Both sides of the join are dealt by the identity of an element, sums by the document.
    assert sum("order#" in d for d in dealt) == 2 and len(dealt) == 4 and "Window" not in plan


def test_folder_per_video(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.export_comments(comments(spark, ROWS), "json", path, per_video=True)
    folders = sorted(os.listdir(os.path.join(path, "channel_key=a")))
    assert folders == [f"video_key={o:04d}_v{o}.jsonl" for o in (1, 2, 10)]
    sinks.export_comments(comments(spark, ROWS[-1:]), "json", path, per_video=True)
    assert not files(path, "a", "json")
    sizes = {r.channel_key: r.bytes for r in stats.file_sizes(spark, path).collect()}
    assert sizes == {"b_c": os.path.getsize(files(path, "b_c", "json")[0])}
    (row,) = stats.file_sizes(spark, path, per_video=True).collect()
    assert (row.channel_key, row.video_key) == ("b_c", "video_key=12345_w.jsonl"[10:])


def test_empty_export_keeps_its_schema(spark, tmp_path):
    none = comments(spark, [])
    for fmt in ("json", "csv", "parquet"):
        assert sinks.export_comments(none, fmt, str(tmp_path / fmt)) == 0
    back = spark.read.parquet(str(tmp_path / "parquet")) if glob.glob(
        str(tmp_path / "parquet" / "*.parquet")) else None
    assert back is None or set(COMMENT_FIELDS) <= set(back.columns)


def videos(spark, rows):
    data = [(ch, f"v{o}", title, len(title), "UC", None if o % 2 else o * 10, "", "10:25",
             10 + 25 / 60, "t", "u", o, T0) for ch, o, title in rows]
    return spark.createDataFrame(
        data, "channel_ref string, video_id string, title string, title_length int, "
        "channel_id string, view_count long, view_count_raw string, length string, "
        "length_minutes double, thumbnail_url string, url string, order int, scraped_at timestamp")


VIDEOS = [("@a", o, TEXTS[o % len(TEXTS)]) for o in range(1, 300)] + [("@b", 1, "x")]


def document(path, key):
    folder = os.path.join(path, key)
    names = sorted(glob.glob(os.path.join(folder, "*.txt")))
    return names, "".join(open(f, encoding="utf-8", newline="").read() for f in names)


def test_videos_document(spark, tmp_path):
    path = str(tmp_path / "out")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = sinks.export_videos(videos(spark, VIDEOS[::-1]).repartition(3), "json", path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert n == 300
    names, text = document(path, "channel_key=a")
    assert len(names) > 1  # one channel, several tasks
    doc = json.loads(text)
    listed = doc.pop("videos")
    assert doc == {"channel_id": "@a", "total_videos": 299, "source": doc["source"],
                   "scraped_at": "2025-01-05T12:34:56+00:00"}
    assert listed == [
        dict(zip(VIDEO_FIELDS, (f"v{o}", t, len(t), "UC", None if o % 2 else o * 10, "", "10:25",
                                10 + 25 / 60, "t", "u", o))) for _, o, t in VIDEOS[:299]]
    keys = ["channel_id", "total_videos", "videos", "scraped_at", "source"]
    whole = json.loads(text)
    assert text.rstrip("\n") == json.dumps(
        {k: whole[k] for k in keys}, indent=2, ensure_ascii=False)


def test_document_of_a_channel_without_videos(spark, tmp_path):
    path = str(tmp_path / "out")
    listed = spark.createDataFrame(
        [("@none", T0), ("@b", T0)], "channel_ref string, scraped_at timestamp")
    assert sinks.write_videos_json(videos(spark, VIDEOS[-1:]), path, "s", listed) == 1
    _, text = document(path, "channel_key=none")
    want = {"channel_id": "@none", "total_videos": 0, "videos": [],
            "scraped_at": "2025-01-05T12:34:56+00:00", "source": "s"}
    assert text.rstrip("\n") == json.dumps(want, indent=2)
    _, text = document(path, "channel_key=b")
    assert json.loads(text)["total_videos"] == 1


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_videos_table(spark, tmp_path, fmt):
    path = str(tmp_path / "out")
    assert sinks.export_videos(videos(spark, VIDEOS), fmt, path) == 300
    if fmt == "csv":
        rows = []
        for f in files(path, "a", "csv"):
            rows += csv.DictReader(io.StringIO(open(f, encoding="utf-8", newline="").read()))
        assert list(rows[0]) == VIDEO_FIELDS
        assert [(r["title"], r["view_count"], r["length_minutes"]) for r in rows] == [
            (t, "" if o % 2 else str(o * 10), "10.416666666666666") for _, o, t in VIDEOS[:299]]
    else:
        back = spark.read.parquet(path)
        assert back.columns == [*VIDEO_FIELDS, "channel_key"] and back.count() == 300


def test_batch_folder(spark, tmp_path):
    from test_stats import tables

    listed, log, rows = tables(spark)
    report = stats.batch_report(listed, log, rows)
    path = str(tmp_path / "batch")
    sinks.write_report(listed, log, report, rows, path)
    _, text = document(os.path.join(path, "report"), "run_id=r")
    doc = json.loads(text)
    assert list(doc) == [
        "started_at", "finished_at", "channels_total", "channels_ok", "channels_failed",
        "total_videos", "total_comments", "total_bytes_mb", "total_duration_sec", "stats"]
    assert doc["started_at"] == "2025-01-05T12:00:00+00:00" and doc["channels_total"] == 6
    assert doc["stats"][:2] == [
        {"channel": "@a", "videos": 3, "comments": 5, "bytes_mb": 1.5, "duration_sec": 90.0,
         "status": "ok"},
        {"channel": "@b", "status": "failed", "error": "boom"}]
    assert text.rstrip("\n") == json.dumps(doc, indent=2, ensure_ascii=False)
    _, lone = document(os.path.join(path, "report"), "run_id=unstarted")
    assert lone.rstrip("\n") == json.dumps(json.loads(lone), indent=2, ensure_ascii=False)
    assert json.loads(lone)["stats"] == []
    _, errors = document(os.path.join(path, "errors"), "run_id=r")
    assert errors == "2025-01-05T12:01:31.500000+00:00 | @b | boom\n"
    _, channels = document(os.path.join(path, "channels"), "run_id=r")
    assert channels.splitlines() == ["@a", "@b", "@a", "@skipped", "@c", "@late"]
    assert report_lines(report, rows).columns == ["run_id", "part", "at", "line"]


def test_failed_export_keeps_the_earlier_one(spark, tmp_path):
    path = str(tmp_path / "export")
    kind = "channel_ref string, video_id string, `order` int, pos int, " + ", ".join(
        f"{c} {'timestamp' if c == 'scraped_at' else 'string'}" for c in COMMENT_FIELDS)

    def rows(*named):
        return spark.createDataFrame(
            [(ref, "v", 1, 1, cid, *[None] * (len(COMMENT_FIELDS) - 1)) for ref, cid in named],
            kind)

    def read():
        found = spark.read.json(path).select("channel_key", "cid")
        return sorted((r.channel_key or "", r.cid) for r in found.collect())

    listed = spark.createDataFrame([("@a",), ("@b",), ("@d/e",), (None,)], "channel_ref string")
    old = [("@a", "1"), ("@b", "2"), ("@c", "3"), ("@d/e", "4"), (None, "5")]
    export_comments(rows(*old), "json", path)
    before = read()
    broken = rows(("@a", "new")).withColumn("cid", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        export_comments(broken, "json", path, channels=listed)
    assert read() == before == [("", "5"), ("a", "1"), ("b", "2"), ("c", "3"), ("d_e", "4")]
    # Complete, but the driver was lost before all was in place: the next export finishes it.
    folder = _Folder(spark, path)
    finish, folder.finish = folder.finish, lambda: None
    ready = rows(("@a", "6"), (None, "7"))
    folder.replace(lambda new: ready.selectExpr(
        "coalesce(translate(channel_ref, '/@', '_'), '') channel_key", "cid").write.partitionBy(
            "channel_key").json(new) or 2, listed)
    assert read() == before
    (tmp_path / "export" / "_draft-x").mkdir()
    export_comments(rows(("@c", "8")), "json", path)
    assert read() == [("", "7"), ("a", "6"), ("c", "8")]
    assert [p.name for p in (tmp_path / "export").iterdir() if p.name.startswith("_")] == []
