from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vidlake.operators import comments as C
from vidlake.operators import discussion
from vidlake.plans import channel_tables
from vidlake.schemas import PAGE_CAPTURES, RESPONSE_CAPTURES

T0 = dt.datetime(2025, 1, 5, 12, 0, 0)
HEART = "TOOLBAR_HEART_STATE_HEARTED"


def comment(cid, key="k", text="text", votes="1", replies="0", **change):
    c = {
        "properties": {"commentId": cid, "content": {"content": text},
                       "publishedTime": "2 days ago", "toolbarStateKey": key},
        "author": {"displayName": "@u", "channelId": "UCu", "avatarThumbnailUrl": "p"},
        "toolbar": {"likeCountNotliked": votes, "replyCount": replies},
    }
    for part, fields in change.items():
        c[part] = {**c[part], **fields}
        c[part] = {k: v for k, v in c[part].items() if v != "drop"}
    return {"payload": {"commentEntityPayload": c}}


def bar(key="k", state="x"):
    return {"payload": {"engagementToolbarStateEntityPayload": {"key": key, "heartState": state}}}


def body(*mutations, **more):
    return {"frameworkUpdates": {"entityBatchUpdate": {"mutations": list(mutations)}}, **more}


def responses(spark, rows, sort_by=1):
    data = [("@c", v, "comments", sort_by, s, f"{v}-{s}",
             b if isinstance(b, str) else json.dumps(b), T0 + dt.timedelta(seconds=s))
            for v, s, b in rows]
    return spark.createDataFrame(data, RESPONSE_CAPTURES)


def cids(df):
    out = {}
    for r in df.orderBy("video_id", "pos").collect():
        out.setdefault(r.video_id, []).append(r.cid)
    return out


def table(spark, rows, strict=False, **options):
    parsed = C.parse_comment_bodies(responses(spark, rows))
    numbered = C.number_responses(
        parsed, strict, per_video_limit=options.get("per_video_limit"))
    return C.comments(numbered, **options)


def test_fields_and_states(spark):
    rows = [("v", 0, body(
        comment("a", "k1", "É😀, \"x\"\n", " 12 "), bar("k1", HEART), comment("b.c", "k2", votes="\t"),
        {"payload": {"other": {}}}, {"type": "x"}, bar("k2"), bar("k2", HEART), bar("unused"),
        comment("d", "k1", replies=7)))]
    got = [r.asDict() for r in table(spark, rows, source="s").orderBy("pos").collect()]
    assert got[0] == {
        "channel_ref": "@c", "video_id": "v", "sort_by": 1, "response_seq": 0, "pos": 1,
        "cid": "a", "text": "É😀, \"x\"\n", "text_length": 8, "time": "2 days ago", "author": "@u",
        "channel": "UCu", "votes": "12", "replies": "0", "photo": "p", "heart": True,
        "reply": False, "scraped_at": T0, "source": "s", "record_error": None,
    }
    assert [(r["cid"], r["votes"], r["replies"], r["heart"], r["reply"]) for r in got[1:]] == [
        ("b.c", "0", "0", False, True), ("d", "1", "7", True, False)]


def test_payloads_anywhere(spark):
    declared = body(comment("a"), comment("b"), bar("k", HEART))
    lists = {"deep": [{"x": [comment("a")]}, comment("b")], "bars": [bar("k", HEART), bar("k")]}
    split = body(comment("a"), bar("k", HEART), z={"more": [comment("b")]})
    quoted = body(comment("a", text='"commentEntityPayload": {'), comment("b"), bar("k", HEART))
    escaped = json.dumps(declared).replace("commentEntityPayload", "comment\\u0045ntityPayload")
    rows = [("1", 0, declared), ("2", 0, lists), ("3", 0, split), ("4", 0, quoted),
            ("5", 0, escaped)]
    df = table(spark, rows).cache()
    assert cids(df) == {v: ["a", "b"] for v in "12345"}
    assert [r.heart for r in df.collect()] == [True] * 10


def test_incomplete_comments(spark):
    rows = [
        ("v", 0, body(comment("a"), comment("b", "lost"), comment("c"), bar())),
        ("v", 1, body(comment("d"), bar())),
        ("w", 0, body(comment("e", properties={"content": "drop"}), bar())),
        ("x", 0, body(comment("f"), bar())),
    ]
    errors = {r.cid: r.record_error for r in table(spark, rows).collect()}
    assert errors == {"a": None, "b": "missing toolbar state", "c": None, "d": None,
                      "e": "missing content", "f": None}
    assert cids(table(spark, rows, strict=True)) == {"v": ["a"], "x": ["f"]}
    failed = C.video_errors(C.parse_comment_bodies(responses(spark, rows)))
    assert {(r.video_id, r.first_seq, r.error) for r in failed.collect()} == {
        ("v", 0, "missing toolbar state"), ("w", 0, "missing content")}


def test_chains_limits_and_errors(spark):
    def page(v, s, n=4):
        return v, s, body(*[comment(f"{v}{s}{i}") for i in range(n)], bar())

    rows = [
        *[page("a", s) for s in range(4)],
        page("b", 0), ("b", 1, "{}"), page("b", 2),
        page("c", 0), ("c", 1, body(comment("no"), bar(), error={"externalErrorMessage": "x \"y\""})),
        page("c", 2),
        page("d", 0), ("d", 1, {"externalErrorMessage": ""}), page("d", 2, 1),
        ("e", 0, "{}"), ("e", 1, {"externalErrorMessage": "after the end"}),
    ]
    every = {"a": [f"a{s}{i}" for s in range(4) for i in range(4)],
             "b": [f"b0{i}" for i in range(4)], "c": [f"c0{i}" for i in range(4)],
             "d": [f"d0{i}" for i in range(4)] + ["d20"]}
    assert cids(table(spark, rows)) == every
    for n in (1, 4, 5, 16, 100):
        assert cids(table(spark, rows, per_video_limit=n)) == {k: v[:n] for k, v in every.items()}
    with pytest.raises(ValueError):
        table(spark, rows, per_video_limit=0)
    stamps = table(spark, rows).select("video_id", "scraped_at").distinct().collect()
    assert {tuple(r) for r in stamps} == {(v, T0) for v in "abcd"}
    failed = C.video_errors(C.parse_comment_bodies(responses(spark, rows)))
    assert [(r.video_id, r.first_seq, r.error) for r in failed.collect()] == [
        ("c", 1, 'Error returned from server: x "y"')]


def test_video_listed_twice_has_its_comments_twice(spark):
    rows = [("v", 0, body(comment("a"), bar())), ("v", 1, body(comment("b"), bar()))]
    listed = spark.createDataFrame(
        [("@c", "v", 1), ("@c", "w", 2), ("@c", "v", 3)],
        "channel_ref string, video_id string, order int")
    numbered = C.number_responses(
        C.parse_comment_bodies(responses(spark, rows)), videos=listed)
    got = {(r.order, r.pos, r.cid) for r in C.comments(numbered).collect()}
    assert got == {(1, 1, "a"), (1, 2, "b"), (3, 1, "a"), (3, 2, "b")}


def test_other_order_is_left_out(spark):
    popular = responses(spark, [("v", 0, body(comment("p"), bar()))], sort_by=0)
    recent = responses(spark, [("v", 0, body(comment("r"), bar()))])
    both = popular.unionByName(recent)
    for sort_by, cid in ((C.SORT_POPULAR, "p"), (C.SORT_RECENT, "r")):
        parsed = C.parse_comment_bodies(both, sort_by)
        assert cids(C.comments(C.number_responses(parsed))) == {"v": [cid]}


def test_order_that_is_not_said_is_recent(spark):
    unsaid = responses(spark, [("v", 0, body(comment("a"), bar()))], sort_by=None)
    for sort_by, want in ((C.SORT_POPULAR, {}), (C.SORT_RECENT, {"v": ["a"]})):
        parsed = C.parse_comment_bodies(unsaid, sort_by)
        assert cids(C.comments(C.number_responses(parsed))) == want


def page_rows(spark, pages, retry=None):
    data = [("@c", f"v{i:02d}", json.dumps(p), retry and json.dumps(retry[i]))
            for i, p in enumerate(pages)]
    return spark.createDataFrame(
        data, "channel_ref string, video_id string, data string, retry string")


def entry(token):
    return {"serviceEndpoint": {"continuationCommand": {"token": token}}}


def test_enabled_and_menu(spark):
    menu = {"sortFilterSubMenuRenderer": {"subMenuItems": [entry("p"), entry("r")]}}
    short = {"sortFilterSubMenuRenderer": {"subMenuItems": [entry("p")]}}
    section = {"itemSectionRenderer": {"contents": [{"continuationItemRenderer": {"x": 1}}]}}
    listed = {"sectionListRenderer": {"a": [{"continuationEndpoint": {
        "continuationCommand": {"token": "again"}}}]}}
    pages = [
        {**menu, "s": section}, {**short, "s": section}, {"s": [section, {"itemSectionRenderer": {}}]},
        {"s": {"itemSectionRenderer": {"continuationItemRenderer": {}}}}, {**listed},
        {**listed, "s": [{"itemSectionRenderer": {}}, section]},
    ]
    retry = [None, None, None, None, menu, {}]
    df = discussion.video_facts(page_rows(spark, pages, retry), 1, "retry").orderBy("video_id")
    got = [(r.comments_enabled, r.sort_token, r.sort_error, r.retry_token) for r in df.collect()]
    error = "Failed to set sorting"
    assert got == [(True, "r", None, None), (True, None, error, None), (False, None, error, None),
                   (False, None, error, None), (False, "r", None, "again"),
                   (True, None, error, "again")]
    first = discussion.video_facts(page_rows(spark, pages), 0).orderBy("video_id").collect()
    assert [r.sort_token for r in first] == ["p", "p", None, None, None, None]


def test_announced_totals(spark):
    def runs(*texts):
        return {"runs": [{"text": t} for t in texts]}

    cases = [
        ({"commentCountRenderer": {"text": runs("1,234 Comments", "5")}}, 1234),
        ({"commentCountRenderer": {"text": {"simpleText": "28.9K"}}, "commentCount": 5}, 28900),
        ({"commentCountRenderer": {"text": runs("Comments")}, "commentCount": "77"}, 77),
        ({"headerRenderer": {"countText": runs("12")}, "commentCount": 5}, 12),
        ({"commentsHeaderRenderer": {"countText": {"simpleText": "9"}, "title": runs("8")}}, 9),
        ({"commentsHeaderRenderer": {"title": runs("Comments", "8", "7")}}, 8),
        ({"commentsHeaderRenderer": {"title": {"simpleText": "6 Comments"}}}, 6),
        ({"commentCount": 41}, 41), ({"commentCount": 41.9}, 41), ({"commentCount": "1.5K"}, 1500),
        ({"commentCount": 0, "a": {"text": runs("all 3 comments")}}, 3),
        ({"commentCount": {"x": 1}}, None),
        ({"a": {"text": runs("2 Comments")}, "b": {"text": runs("no", "5 COMMENTS")}}, 5),
        ({"a": {"text": {"simpleText": "about 2 comments"}}, "b": {"text": "9 comments"}}, 2),
        ({"a": {"text": runs("comments")}, "b": {"text": runs("9 videos")}}, None),
        ({}, None),
    ]
    open_ = {"itemSectionRenderer": {"continuationItemRenderer": {"x": 1}},
             "sortFilterSubMenuRenderer": {"subMenuItems": [entry("p"), entry("r")]}}
    facts = discussion.video_facts(page_rows(spark, [{**p, **open_} for p, _ in cases]), 1)
    got = [r.page_total for r in facts.orderBy("video_id").collect()]
    assert got == [want for _, want in cases]

    rows = [("@c", "v11", 3, '{"commentCount": 10}'), ("@c", "v11", 2, '{"commentCount": 20}'),
            ("@c", "v14", 0, "{}"), ("@c", "v14", 1, '{"commentCount": 30}'),
            ("@c", "v00", 0, '{"commentCount": 40}'), ("@c", "v99", 0, '{"commentCount": 50}')]
    later = spark.createDataFrame(
        rows, "channel_ref string, video_id string, response_seq int, body string")
    totals = {r.video_id: r.total_count for r in discussion.comment_totals(facts, later).collect()}
    assert len(totals) == len(cases)
    assert (totals["v11"], totals["v14"], totals["v00"]) == (20, None, 1234)


def test_totals_are_had_only_where_comments_are_asked_for(spark):
    section = {"itemSectionRenderer": {"continuationItemRenderer": {"x": 1}}}
    menu = {"sortFilterSubMenuRenderer": {"subMenuItems": [entry("p"), entry("r")]}}
    pages = [{**section, **menu, "commentCount": 1}, {**menu, "commentCount": 2},
             {**section, "commentCount": 3}, {**section, "commentCount": 4},
             {**section, "commentCount": 5}]
    retry = [{"commentCount": 9}, None, {**menu, "commentCount": 900}, None, menu]
    facts = discussion.video_facts(page_rows(spark, pages, retry), 1, "retry")
    kind = ("channel_ref string, video_id string, response_seq int, sort_by int, body string, "
            "fetched_at int")
    later = spark.createDataFrame(
        [("@c", "v04", 0, 1, '{"commentCount": 60}', 1), ("@c", "v04", 0, 0,
         '{"commentCount": 70}', 3), ("@c", "v03", 0, 1, '{"commentCount": 80}', 1),
         ("@c", "v04", 0, 1, '{"commentCount": 61}', 2)], kind).withColumn(
             "fetched_at", F.timestamp_seconds("fetched_at"))
    for n in (1, 5):
        totals = discussion.comment_totals(facts, later.repartition(n, "body"))
        got = {r.video_id: r.total_count for r in totals.collect()}
        assert got == {"v00": 1, "v01": None, "v02": 900, "v03": None, "v04": 61}
    popular = discussion.comment_totals(facts, later, 0)
    assert {r.video_id: r.total_count for r in popular.collect()}["v04"] == 70
    assert [r.video_id for r in discussion.sort_failures(facts).collect()] == ["v03"]


def test_expected_total(column):
    assert column([5, None], "bigint", discussion.expected_total) == [5, None]
    assert column([5, None], "bigint", lambda c: discussion.expected_total(c, 3)) == [3, 3]


def test_whole_job(spark):
    page = {"contents": {"twoColumnBrowseResultsRenderer": {"tabs": [{"tabRenderer": {"content": {
        "richGridRenderer": {"contents": [
            {"richItemRenderer": {"content": {"videoRenderer": {"videoId": v}}}}
            for v in ("v", "w", "x")]}}}}]}}}
    html = f"ytcfg.set({{}}); var ytInitialData = {json.dumps(page)};</script>"
    pages = spark.createDataFrame(
        [("@c", None, "u", html, T0), ("@d", None, "u", "", T0)], PAGE_CAPTURES)
    caps = responses(spark, [
        ("v", 0, body(comment("a"), comment("b"), bar())), ("w", 0, body(comment("c"), bar())),
        ("unlisted", 0, body(comment("d"), bar())), ("x", 0, {"externalErrorMessage": "e"})])
    caps = caps.union(spark.createDataFrame(
        [("@c", None, "videos", None, 1, None, '{"cut', T0)], RESPONSE_CAPTURES))
    watch = json.dumps({"itemSectionRenderer": {"continuationItemRenderer": {"x": 1}}})
    pages = pages.union(spark.createDataFrame(
        [("@c", "w", "u", f"ytcfg.set({{}}); var ytInitialData = {watch};</script>", T0),
         ("@d", None, "u", "earlier", T0 - dt.timedelta(1))], PAGE_CAPTURES))
    tables = channel_tables(pages, caps, max_videos=2, per_video_limit=1)
    assert [r.video_id for r in tables.videos.orderBy("order").collect()] == ["v", "w"]
    got = tables.comments.select("order", "video_id", "pos", "cid").orderBy("order").collect()
    assert [tuple(r) for r in got] == [(1, "v", 1, "a"), (2, "w", 1, "c")]
    assert {tuple(r) for r in tables.errors.collect()} == {
        ("@c", "x", "Error returned from server: e"), ("@d", None, "Failed to extract ytcfg"),
        ("@c", None, "Failed to parse response JSON"), ("@c", "w", "Failed to set sorting")}
    assert tables.errors.count() == 4
    assert [tuple(r) for r in tables.totals.collect()] == [("@c", "w", None)]
    assert "html" not in tables.errors._jdf.queryExecution().optimizedPlan().toString()
    assert "vidlake" in tables.comments.select(F.first("source")).first()[0]


def nested_deep(levels, inner):
    return '{"x":' * levels + json.dumps(inner) + "}" * levels


def test_no_body_vanishes(spark):
    good = body(comment("a"), bar())
    rows = [("cut", 0, good), ("cut", 1, json.dumps(good)[:-2]), ("cut", 2, good),
            ("deep", 0, nested_deep(1500, good)), ("deep", 1, good),
            ("deeper", 0, nested_deep(200000, good)), ("text", 0, "<html>"),
            ("odd", 0, '{"frameworkUpdates": 5}'), ("odd", 1, good), ("list", 0, "[1]"),
            ("list", 1, good), ("none", 0, None), ("none", 1, good)]
    parsed = C.parse_comment_bodies(responses_of(spark, rows))
    got = cids(C.comments(C.number_responses(parsed)))
    assert got == {"cut": ["a"], "deep": ["a", "a"], "odd": ["a"], "list": ["a"]}
    failed = {(r.video_id, r.first_seq, r.error) for r in C.video_errors(parsed).collect()}
    assert failed == {(v, s, "Failed to parse response JSON") for v, s in (
        ("cut", 1), ("deeper", 0), ("text", 0))}


def responses_of(spark, rows):
    data = [("@c", v, "comments", 1, s, f"{v}-{s}", json.dumps(b) if isinstance(b, dict) else b,
             T0 + dt.timedelta(seconds=s)) for v, s, b in rows]
    return spark.createDataFrame(data, RESPONSE_CAPTURES)


def test_pages_with_declared_places_need_no_python(spark):
    def results(*sections):
        return {"twoColumnWatchNextResults": {"results": {"results": {"contents": [
            {"itemSectionRenderer": s} for s in sections]}}}}

    item = {"contents": [{"continuationItemRenderer": {"x": 1}}]}
    menu = {"subMenuItems": [entry("p"), entry("r")]}
    panel = {"engagementPanels": [{"other": 1}, {"engagementPanelSectionListRenderer": {
        "header": {"engagementPanelTitleHeaderRenderer": {"menu": {
            "sortFilterSubMenuRenderer": menu}}}}}]}
    listed = {"sectionListRenderer": {
        "continuations": [{"continuationEndpoint": entry("last")["serviceEndpoint"]}],
        "contents": [{"itemSectionRenderer": {"continuationItemRenderer": {
            "continuationEndpoint": entry("section")["serviceEndpoint"]}}}]}}
    count = {"commentCountRenderer": {"text": {"simpleText": "12"}}}
    pages = [
        {"contents": results({"a": 1}, item), **panel, **count},
        {"contents": results(item, {"a": 1}), **panel, **count},  # the last section has none
        {**listed, **count}, {"sectionListRenderer": dict(reversed(
            listed["sectionListRenderer"].items())), "commentCount": 0}, {},
    ]
    retry = [None, None, {"sortFilterSubMenuRenderer": menu, "commentCount": 8}, {}, None]
    elsewhere = [{"x": pages[0]}, {"x": [{"y": p} for p in pages]}, "no page",
                 {"z": pages[2], **panel}]

    def facts(pages, retry):
        df = discussion.video_facts(page_rows(spark, pages, retry), 1, "retry")
        rows = df.orderBy("video_id").collect()
        return df._jdf.queryExecution().executedPlan().toString(), [
            (r.comments_enabled, r.page_total, r.sort_token, r.sort_error, r.retry_token)
            for r in rows]

    plan, native = facts(pages, retry)
    assert "Python" not in plan
    error = "Failed to set sorting"
    assert native == [
        (True, 12, "r", None, None), (False, 12, "r", None, None), (True, 8, "r", None, "section"),
        (True, None, None, error, "last"), (False, None, None, error, None)]
    # The search alone finds the same, and pages of both kinds can be mixed.
    rows = page_rows(spark, [*pages, *elsewhere], [*retry, *[None] * 4])
    searched = discussion._searched_facts(rows, 1, "retry").orderBy("video_id").collect()
    searched = [(r.comments_enabled, r.page_total, r.sort_token, r.sort_error, r.retry_token)
                for r in searched]
    assert searched[:5] == native
    plan, mixed = facts([*pages, *elsewhere], [*retry, *[None] * 4])
    assert mixed == searched and "Python" in plan
