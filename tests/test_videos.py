from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vidlake.operators.videos import channel_responses, parse_video_bodies, videos
from vidlake.plans.channels import video_table
from vidlake.schemas import PAGE_CAPTURES, RESPONSE_CAPTURES, VIDEO_FIELDS
from vidlake.session import staged

T0 = dt.datetime(2025, 1, 5, 12, 0, 0)


def item(video_id, **fields):
    return {"richItemRenderer": {"content": {"videoRenderer": {"videoId": video_id, **fields}}}}


def later(items, layout="Actions"):
    return {f"onResponseReceived{layout}": [
        {"other": 1}, {"appendContinuationItemsAction": {"continuationItems": items}}]}


def grid(items, **tab):
    return {"tabRenderer": {**tab, "content": {"richGridRenderer": {"contents": items}}}}


def tabs(*renderers):
    return {"contents": {"twoColumnBrowseResultsRenderer": {"tabs": list(renderers)}}}


def bodies(spark, rows):
    data = [(c, s, b if isinstance(b, str) else json.dumps(b), T0) for c, s, b in rows]
    return parse_video_bodies(spark.createDataFrame(
        data, "channel_ref string, response_seq int, body string, fetched_at timestamp"))


def ids(df):
    out = {}
    for r in df.orderBy("channel_ref", "order").collect():
        out.setdefault(r.channel_ref, []).append((r.order, r.video_id))
    return out


def test_layouts(spark):
    empty_tab = {"tabRenderer": {"content": {}}}
    next_item = {"continuationItemRenderer": {"continuationEndpoint": {}}}
    parsed = bodies(spark, [
        ("selected", 0, tabs(grid([item("no")]), grid([item("a"), item("b")], selected=True))),
        ("first grid", 0, tabs(empty_tab, grid([item("a")], selected=False), grid([item("no")]))),
        ("first tab", 0, tabs(grid(None), grid([item("no")], selected=False))),
        ("selected wins", 0, tabs(grid([item("x")]), {"tabRenderer": {
            "selected": True, "content": {"sectionListRenderer": {}}}})),
        ("later", 1, later([item("a"), next_item, {**next_item, **item("no")}, item("")])),
        ("later", 2, later([item("b"), {"richItemRenderer": {}}, item("c")], "Endpoints")),
        ("both", 1, {**later([item("no")]), **later([item("a")], "Endpoints")}),
        ("only endpoints count", 1, {**later([item("no")]), "onResponseReceivedEndpoints": []}),
        ("deep", 0, {"x": [item("a"), {"y": item("b")}], "g": [
            {"gridVideoRenderer": {"videoId": "g"}}, {"gridVideoRenderer": {"title": "no id"}}]}),
        ("no deep search on later pages", 1, {"onResponseReceivedActions": [], "x": item("no")}),
        ("broken", 0, '{"contents": '),
    ])
    assert ids(videos(parsed)) == {
        "selected": [(1, "a"), (2, "b")],
        "first grid": [(1, "a")],
        "selected wins": [(1, "x")],  # the selected tab has no grid, so the page is searched
        "first tab": [(1, "no")],  # the first grid is empty, so the page is searched
        "later": [(1, "a"), (2, "b"), (3, "c")],
        "both": [(1, "a")],
        "deep": [(1, "b"), (2, "a"), (3, "g")],
    }


def test_fields(spark):
    full = item(
        "v1", title={"runs": [{"text": "É😀"}, {"text": "x"}], "simpleText": "no"},
        ownerText={"runs": [{"navigationEndpoint": {"browseEndpoint": {"browseId": "UC1"}}}]},
        viewCountText={"simpleText": "1,234 views", "runs": [{"text": "no"}]},
        lengthText={"simpleText": "10:25"},
        thumbnail={"thumbnails": [{"url": "small"}, {"url": "large"}]})
    sparse = item("v2", title={"runs": [], "simpleText": "plain"}, ownerText={"runs": []},
                  viewCountText={"runs": [{"text": "32.3K"}, {"text": " views"}]},
                  thumbnail={"thumbnails": []})
    bare = item("v3", title={"runs": [{"text": ""}]}, lengthText={})
    parsed = bodies(spark, [("@c", 0, tabs(grid([full, sparse]))), ("@c", 1, later([bare]))])
    got = [r.asDict() for r in videos(parsed).orderBy("order").collect()]
    assert list(got[0]) == ["channel_ref", *VIDEO_FIELDS, "scraped_at"]
    watch = "https://www.youtube.com/watch?v="

    def row(*values):
        return dict(zip(["channel_ref", *VIDEO_FIELDS, "scraped_at"], ("@c", *values, T0)))

    assert got == [
        row("v1", "É😀", 2, "UC1", 1234, "1,234 views", "10:25", 10 + 25 / 60, "large",
            watch + "v1", 1),
        row("v2", "plain", 5, "", 32299, "32.3K", "", None, "", watch + "v2", 2),
        row("v3", "", 0, "@c", None, "", "", None, "", watch + "v3", 3),
    ]
    filled = videos(parsed, fill_first_page=True).orderBy("order").collect()
    assert [r.channel_id for r in filled] == ["UC1", "@c", "@c"]


def test_limit_and_end_of_chain(spark):
    rows = []
    for seq in range(9):
        page = [item(f"v{seq}.{i}") for i in range(3)]
        rows.append(("a", seq, tabs(grid(page)) if seq == 0 else later(page)))
        rows.append(("b", seq, "{}" if seq == 2 else (
            tabs(grid(page)) if seq == 0 else later(page))))
    parsed = bodies(spark, rows)
    every = [(n + 1, f"v{n // 3}.{n % 3}") for n in range(27)]
    assert ids(videos(parsed)) == {"a": every, "b": every[:6]}
    for n in (1, 2, 3, 4, 26, 99):
        assert ids(videos(parsed, n)) == {"a": every[:n], "b": every[:min(n, 6)]}
    with pytest.raises(ValueError):
        videos(parsed, 0)


def test_from_captures(spark):
    html = ("<script>var ytInitialData = " + json.dumps(tabs(grid([item("a")]))) + ";</script>")
    pages = spark.createDataFrame([
        ("@x", None, "u", html, T0), ("@x", "a", "u", "a video's own page", T0),
        ("@none", None, "u", "no data", T0), ("@null", None, "u", None, T0)], PAGE_CAPTURES)
    responses = spark.createDataFrame([
        ("@x", None, "videos", None, 1, "t", json.dumps(later([item("b")])), T0),
        ("@x", "a", "comments", 1, 1, "t", json.dumps(later([item("no")])), T0),
    ], RESPONSE_CAPTURES)
    assert channel_responses(pages, responses).count() == 4
    # A page without data is no video page: its chain ends before it begins.
    assert ids(video_table(pages, responses)) == {"@x": [(1, "a"), (2, "b")]}


def test_latest_capture_of_a_response_counts(spark):
    rows = [("@c", 0, tabs(grid([item("old"), item("old2")])))] * 500
    first = bodies(spark, rows).withColumn("fetched_at", F.lit(T0) - F.expr("interval 1 day"))
    second = bodies(spark, [("@c", 0, tabs(grid([item("new")])))] * 300)
    later_page = bodies(spark, [("@c", 1, later([item("b")]))] * 2)
    parsed = first.unionByName(second).unionByName(later_page).repartition(3)
    assert ids(videos(parsed)) == {"@c": [(1, "new"), (2, "b")]}
    assert ids(videos(parsed, 1)) == {"@c": [(1, "new")]}


def test_pages_are_picked_by_their_row(spark):
    """Wide rows are neither sorted nor shuffled by channel."""
    parsed = staged(bodies(spark, [("a", 0, tabs(grid([item("v")])))]), "pages")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = videos(parsed)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "videos" in line and "FileScan" in line)
    above = [line for line in lines[:scan] if "Exchange" in line]
    assert "hashpartitioning(row_id" in above[-1]
    assert "Window" not in lines[scan - 1] + lines[scan - 2] + lines[scan - 3]
