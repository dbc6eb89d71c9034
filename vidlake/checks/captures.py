"""Captures encoded from the given tables, in the shapes the operators must understand.

Groups are cut by fixed ranges of a key, so a body stays small however large its table or its
channel is. `CASE`-like choices by key vary the shape of records; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys per page of videos; with 25 brands about 30 videos a page.
PARTS_PER_PAGE = 750
TURNS_PER_RESPONSE = 3
#: Place of a response cut short, after all pages of its channel.
CUT_SEQ = 10000
#: Beyond the last turn of any conversation.
LAST_TURN = 3000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(value: Column) -> Column:
    return F.struct(value.alias("text"))


def _endpoint(token: Column) -> Column:
    return F.struct(F.struct(token.alias("token")).alias("continuationCommand"))


def _next_item(token: Column) -> Column:
    return F.struct(_endpoint(token).alias("continuationEndpoint"))


def clock(seconds: Column) -> Column:
    """Seconds as M:SS or H:MM:SS."""
    s = seconds.cast("bigint")
    return F.when(s < 3600, F.format_string("%d:%02d", F.floor(s / 60), s % 60)).otherwise(
        F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    )


# --- videos, from part --------------------------------------------------------------------


def video_renderer() -> Column:
    k, size = F.col("p_partkey"), F.col("p_size")
    title = F.concat("p_name", F.lit(" é "), "p_type")
    views = (
        F.when(k % 6 == 0, F.concat(F.format_number(k * 7919, 0), F.lit(" views")))
        .when(k % 6 == 1, F.concat((F.floor(k % 1000 / 10)).cast("string"), F.lit("."),
                                   (k % 10).cast("string"), F.lit("K views")))
        .when(k % 6 == 3, F.lit("No views"))
        .when(k % 6 == 5, F.format_string("%d\u00a0%03d views", k + 1, k % 1000))
    )
    runs = F.when(k % 6 == 2, F.array(
        _text(F.concat(size.cast("string"), F.lit("."), (k % 10).cast("string"), F.lit("M"))),
        _text(F.lit(" views")),
    ))
    return F.struct(
        F.when(k % 37 != 5, F.concat(F.lit("v"), k.cast("string"))).alias("videoId"),
        F.struct(
            F.when(k % 4 == 0, F.array(_text(title)))
            .when(k % 4 == 2, F.array(_text(F.lit(""))))
            .when(k % 4 == 3, F.array(_text(title), _text(F.lit("rest")))).alias("runs"),
            F.when(k % 4 != 0, F.when(k % 4 == 3, F.lit("unused")).otherwise(title))
            .alias("simpleText"),
        ).alias("title"),
        F.when(k % 3 != 0, F.struct(F.array(F.struct(F.struct(F.struct(
            F.concat(F.lit("UC"), size.cast("string")).alias("browseId")
        ).alias("browseEndpoint")).alias("navigationEndpoint"))).alias("runs"))
        ).alias("ownerText"),
        F.when(k % 6 != 4, F.struct(views.alias("simpleText"), runs.alias("runs")))
        .alias("viewCountText"),
        F.when(k % 11 != 3, F.struct(clock(size * 97 + k % 4001).alias("simpleText")))
        .alias("lengthText"),
        F.when(k % 13 != 1, F.struct(F.array(
            F.struct(F.concat(F.lit("https://img.example/s/"), k.cast("string")).alias("url")),
            F.struct(F.concat(F.lit("https://img.example/l/"), k.cast("string")).alias("url")),
        ).alias("thumbnails"))).alias("thumbnail"),
    )


def brand_channel() -> Column:
    return F.concat(F.lit("@"), F.replace("p_brand", F.lit("#"), F.lit("-")))


def video_captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(page_captures, response_captures): a part is a video, its brand the channel.

    Some first pages and responses were captured badly before. Some channels have a response cut
    short after their last page and one after that, which must not count.
    """
    seq = F.floor(F.col("p_partkey") / PARTS_PER_PAGE).cast("int")
    pages = (
        table(spark, sf_dir, "part")
        .select(brand_channel().alias("channel_ref"), seq.alias("response_seq"), "p_partkey",
                F.regexp_extract("p_brand", r"\d+", 0).cast("int").alias("brand"),
                F.struct(F.struct(video_renderer().alias("videoRenderer")).alias("content"))
                .alias("rich"))
        .groupBy("channel_ref", "brand", "response_seq")
        .agg(F.array_sort(F.collect_list(F.struct("p_partkey", "rich"))).alias("rows"))
    )
    token = F.concat_ws("-", F.col("channel_ref"), (F.col("response_seq") + 1).cast("string"))
    item = "struct<continuationItemRenderer:struct<continuationEndpoint:struct<" \
           "continuationCommand:struct<token:string>>>>"
    nothing = F.lit(None).cast(item)["continuationItemRenderer"]
    items = F.concat(
        F.transform("rows", lambda r: F.struct(
            nothing.alias("continuationItemRenderer"), r["rich"].alias("richItemRenderer"))),
        F.array(F.struct(
            _next_item(token).alias("continuationItemRenderer"),
            F.get("rows", F.lit(0))["rich"].alias("richItemRenderer"),
        )),
    )
    # The continuation item must be skipped on later pages even though it carries a video; on
    # first pages an item is a video whatever else it carries, so there it carries none.
    first_items = F.transform(items, lambda i: F.struct(
        i["continuationItemRenderer"].alias("continuationItemRenderer"),
        F.when(i["continuationItemRenderer"].isNull(), i["richItemRenderer"])
        .alias("richItemRenderer"),
    ))
    grid = F.struct(first_items.alias("contents"))
    marked = F.col("brand") % 2 == 0
    tabs = F.array(
        F.struct(F.struct(
            F.when(marked, F.lit(False)).alias("selected"),
            F.when(marked, F.struct(F.struct(F.slice(first_items, 1, 1).alias("contents"))
                                    .alias("richGridRenderer"))).alias("content"),
        ).alias("tabRenderer")),
        F.struct(F.struct(
            F.when(marked, F.lit(True)).alias("selected"),
            F.struct(grid.alias("richGridRenderer")).alias("content"),
        ).alias("tabRenderer")),
    )
    data = F.to_json(F.struct(F.struct(
        F.struct(tabs.alias("tabs")).alias("twoColumnBrowseResultsRenderer")
    ).alias("contents")))
    actions = F.array(F.struct(
        F.struct(items.alias("continuationItems")).alias("appendContinuationItemsAction")))
    odd = F.col("response_seq") % 2 == 1
    later = F.to_json(F.struct(
        F.when(odd, actions).alias("onResponseReceivedEndpoints"),
        F.when(~odd, actions).alias("onResponseReceivedActions"),
    ))
    fetched = F.timestamp_seconds(F.lit(1700000000) + F.col("response_seq"))
    page_captures = pages.filter("response_seq = 0").select(
        "channel_ref", F.lit(None).cast("string").alias("video_id"),
        F.concat(F.lit("https://www.youtube.com/"), "channel_ref", F.lit("/videos")).alias("url"),
        F.concat(
            F.lit('<html><script>ytcfg.set({"KEY": {"hl": "en"}}) ;</script><script>'
                  "var ytInitialData = "), data, F.lit(";</script></html>"),
        ).alias("html"),
        fetched.alias("fetched_at"),
    )
    responses = pages.filter("response_seq > 0").select(
        "channel_ref", F.lit(None).cast("string").alias("video_id"),
        F.lit("videos").alias("kind"), F.lit(None).cast("int").alias("sort_by"),
        "response_seq",
        F.concat_ws("-", "channel_ref", F.col("response_seq").cast("string"))
        .alias("request_token"),
        later.alias("body"), fetched.alias("fetched_at"),
    )
    before = F.col("fetched_at") - F.expr("INTERVAL 1 MINUTE")
    bad_pages = page_captures.filter(F.crc32("channel_ref") % 3 == 0).withColumns({
        "html": F.lit("<html>try again</html>"), "fetched_at": before})
    bad = responses.filter("response_seq % 2 = 1").withColumns({
        "body": F.when(F.col("response_seq") % 4 == 1, F.lit("{}")).otherwise(F.lit('{"on')),
        "fetched_at": before})
    after = pages.filter("response_seq = 0 and brand % 4 = 1").select(
        "channel_ref", later.alias("body"), fetched.alias("fetched_at"),
    ).withColumn("response_seq", F.explode(F.array(F.lit(CUT_SEQ), F.lit(CUT_SEQ + 1))))
    after = after.select(
        "channel_ref", F.lit(None).cast("string").alias("video_id"), F.lit("videos").alias("kind"),
        F.lit(None).cast("int").alias("sort_by"), "response_seq",
        F.lit(None).cast("string").alias("request_token"),
        F.when(F.col("response_seq") == CUT_SEQ, F.expr("left(body, length(body) - 2)"))
        .otherwise(F.col("body")).alias("body"), "fetched_at")
    return page_captures.union(bad_pages), responses.union(bad).union(after)


def shelf_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of no known layout: rich items and grid videos of parts on shelves, somewhere."""
    seq = F.floor(F.col("p_partkey") / PARTS_PER_PAGE).cast("int")
    grid = F.col("p_partkey") % 5 == 0
    r = video_renderer()
    rows = (
        table(spark, sf_dir, "part")
        .select(brand_channel().alias("channel_ref"), seq.alias("response_seq"), "p_partkey",
                F.when(~grid, F.struct(F.struct(r.alias("videoRenderer")).alias("content")))
                .alias("richItemRenderer"),
                F.when(grid, r).alias("gridVideoRenderer"))
        .groupBy("channel_ref", "response_seq")
        .agg(F.array_sort(F.collect_list(
            F.struct("p_partkey", "richItemRenderer", "gridVideoRenderer"))).alias("rows"))
    )
    shelf = F.transform("rows", lambda x: F.struct(
        x["richItemRenderer"].alias("richItemRenderer"),
        x["gridVideoRenderer"].alias("gridVideoRenderer")))
    return rows.select(
        "channel_ref", "response_seq",
        F.to_json(F.struct(F.struct(F.array(F.struct(shelf.alias("items"))).alias("shelves"))
                           .alias("layout"))).alias("body"),
        F.timestamp_seconds(F.lit(1700000000)).alias("fetched_at"),
    )


# --- comments, from conversations ---------------------------------------------------------


def talk_video() -> Column:
    return F.concat(F.lit("c"), F.col("conv_id").cast("string"))


def talk_channel() -> Column:
    return F.concat(F.lit("@talk"), (F.col("conv_id") % 5).cast("string"))


def comment_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`response_captures`: a conversation is a video, its turns are the comments.

    Both orders are captured: 1 as spoken, 0 backwards. Some chains hold an empty body, one cut
    short or a server error, some bodies keep their payloads in an undeclared place, some are
    nested 1,500 deep. Some responses were captured badly before.
    """
    turns = table(spark, sf_dir, "conversations").withColumn(
        "sort_by", F.explode(F.array(F.lit(0), F.lit(1))))
    conv, turn = F.col("conv_id"), F.col("turn")
    seq = F.floor(F.when(F.col("sort_by") == 1, turn).otherwise(LAST_TURN - turn)
                  / TURNS_PER_RESPONSE).cast("int")
    payload = F.struct(
        F.struct(
            F.concat(F.lit("t"), conv.cast("string"),
                     F.when(turn % 2 == 1, F.lit(".")).otherwise(F.lit("-")),
                     turn.cast("string")).alias("commentId"),
            F.struct(F.col("text").alias("content")).alias("content"),
            F.concat(turn.cast("string"), F.lit(" days ago")).alias("publishedTime"),
            F.concat(F.lit("k"), turn.cast("string")).alias("toolbarStateKey"),
        ).alias("properties"),
        F.struct(
            F.concat(F.lit("@"), "role").alias("displayName"),
            F.concat(F.lit("UC"), conv.cast("string")).alias("channelId"),
            F.concat(F.lit("https://img.example/a/"), "role").alias("avatarThumbnailUrl"),
        ).alias("author"),
        F.struct(
            F.when(turn % 3 == 0, F.lit("  ")).otherwise(
                F.concat(F.lit(" "), (turn * conv).cast("string"), F.lit("\t")))
            .alias("likeCountNotliked"),
            (turn % 4).alias("replyCount"),
        ).alias("toolbar"),
    )
    state = F.when((conv + turn) % 4 == 0, F.lit("TOOLBAR_HEART_STATE_HEARTED")).otherwise(
        F.lit("TOOLBAR_HEART_STATE_UNHEARTED"))
    key = F.concat(F.lit("k"), turn.cast("string"))
    bars = F.concat(
        F.array(F.struct(key.alias("key"), state.alias("heartState"))),
        # A second state under the same key must lose.
        F.when(turn % 5 == 0, F.array(F.struct(
            key.alias("key"), F.lit("TOOLBAR_HEART_STATE_HEARTED").alias("heartState"))))
        .otherwise(F.array().cast("array<struct<key:string,heartState:string>>")),
    )
    rank = F.when(F.col("sort_by") == 1, turn).otherwise(-turn)
    bodies = (
        turns.select("conv_id", "sort_by", talk_channel().alias("channel_ref"),
                     talk_video().alias("video_id"), seq.alias("response_seq"),
                     rank.alias("rank"), payload.alias("payload"), bars.alias("bars"))
        .groupBy("conv_id", "channel_ref", "video_id", "sort_by", "response_seq")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "payload", "bars"))).alias("rows"))
    )
    comments = F.transform("rows", lambda r: r["payload"])
    states = F.flatten(F.transform("rows", lambda r: r["bars"]))
    no_state = F.lit(None).cast("struct<key:string,heartState:string>")
    no_comment = F.get(comments, F.lit(-1))
    usual = F.concat(
        F.transform(comments, lambda c: F.struct(F.struct(
            c.alias("commentEntityPayload"),
            no_state.alias("engagementToolbarStateEntityPayload")).alias("payload"))),
        F.transform(states, lambda s: F.struct(F.struct(
            no_comment.alias("commentEntityPayload"),
            s.alias("engagementToolbarStateEntityPayload")).alias("payload"))),
    )
    elsewhere = F.struct(
        F.transform(comments, lambda c: F.struct(c.alias("commentEntityPayload")))
        .alias("threads"),
        F.transform(states, lambda s: F.struct(s.alias("engagementToolbarStateEntityPayload")))
        .alias("bars"),
    )
    moved = F.col("conv_id") % 6 == 2
    failed = (F.col("conv_id") % 11 == 7) & (F.col("response_seq") == 2)
    body = F.when((F.col("conv_id") % 9 == 4) & (F.col("response_seq") == 1), F.lit(" { } "))
    body = body.otherwise(F.to_json(F.struct(
        F.when(failed, F.struct(F.struct(F.lit("quota \"used\" up").alias("externalErrorMessage"))
                                .alias("error"))).alias("response"),
        F.when(~moved, F.struct(F.struct(usual.alias("mutations")).alias("entityBatchUpdate")))
        .alias("frameworkUpdates"),
        F.when(moved, elsewhere).alias("other"),
    )))
    cut = (F.col("conv_id") % 13 == 5) & (F.col("conv_id") % 9 != 4) & (F.col("response_seq") == 1)
    deep = (F.col("conv_id") % 17 == 3) & ~cut & (F.col("response_seq") == 0)
    bodies = bodies.select("*", body.alias("body")).withColumn("body", F.when(
        cut, F.expr("left(body, length(body) - 3)")
    ).when(
        deep, F.expr("""concat(left(body, length(body) - 1), ',"deep":', repeat('[', 1500),
                               repeat(']', 1500), '}')""")
    ).otherwise(F.col("body")))
    bad = (
        F.when(F.col("conv_id") % 3 == 0, F.lit("{}"))
        .when(F.col("conv_id") % 3 == 1, F.lit('{"externalErrorMessage": "gone"}'))
        .otherwise(F.lit('{"frameworkUpdates": {')))
    good = bodies.select(
        "conv_id", "channel_ref", "video_id", F.lit("comments").alias("kind"), "sort_by",
        "response_seq",
        F.concat_ws("-", "video_id", F.col("sort_by").cast("string"),
                    F.col("response_seq").cast("string")).alias("request_token"),
        "body",
        F.timestamp_seconds(F.lit(1700000000) + F.when(
            F.col("sort_by") == 1, F.col("response_seq")).otherwise(0)).alias("fetched_at"),
    )
    earlier = good.filter("conv_id % 7 = 2 and response_seq % 2 = 0").withColumns({
        "body": bad, "fetched_at": F.col("fetched_at") - F.expr("INTERVAL 1 MINUTE")})
    return good.union(earlier).drop("conv_id")


def known_talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of the conversations; every fourth is not on its channel's list."""
    return listed_talks(spark, sf_dir).filter("substr(video_id, 2) % 4 <> 3")


def listed_talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of all conversations."""
    conv = F.col("conv_id")
    return (
        table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
        .select(talk_channel().alias("channel_ref"), talk_video().alias("video_id"),
                (F.floor(conv / 5) + 1).cast("int").alias("order"))
    )


def talk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data of each conversation's page: comments on or off, their number, the sort menu.

    `retry_body` is what was captured for pages without a menu.
    """
    conv = F.col("conv_id")
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n"))
    token = F.concat(F.lit("s"), conv.cast("string"))
    entry = F.array(
        F.struct(_endpoint(F.concat(token, F.lit("-0"))).alias("serviceEndpoint")),
        F.struct(_endpoint(F.concat(token, F.lit("-1"))).alias("serviceEndpoint")),
    )
    short = F.slice(entry, 1, 1)
    menu = F.struct(F.when(conv % 10 == 6, short).otherwise(entry).alias("subMenuItems"))
    own_menu = conv % 8 != 5
    count = (F.col("n") * 1234 + conv).cast("bigint")
    plain = F.concat(F.format_number(count, 0), F.lit(" Comments"))
    kind = conv % 7
    data = F.to_json(F.struct(
        F.struct(
            F.array(F.struct(F.struct(
                F.when(conv % 7 != 3, _next_item(F.concat(token, F.lit("-c"))))
                .alias("continuationItemRenderer"),
                F.lit("x").alias("message"),
            ).alias("itemSectionRenderer"))).alias("contents"),
            F.array(F.struct(_endpoint(F.concat(token, F.lit("-retry")))
                             .alias("continuationEndpoint"))).alias("continuations"),
        ).alias("sectionListRenderer"),
        F.when(own_menu, menu).alias("sortFilterSubMenuRenderer"),
        F.when(kind == 0, F.struct(F.struct(F.array(_text(plain)).alias("runs")).alias("text")))
        .alias("commentCountRenderer"),
        F.when(kind == 1, F.struct(F.struct(
            F.concat(F.col("n").cast("string"), F.lit(".3K")).alias("simpleText"))
            .alias("countText"))).alias("headerRenderer"),
        F.when(kind == 2, F.struct(F.struct(
            F.array(_text(F.lit("Comments")), _text(count.cast("string"))).alias("runs"))
            .alias("title"))).alias("commentsHeaderRenderer"),
        F.when(kind == 4, count).alias("commentCount"),
        F.when(kind == 5, F.struct(F.struct(plain.alias("simpleText")).alias("text")))
        .alias("note"),
    ))
    return talks.select(
        talk_channel().alias("channel_ref"), talk_video().alias("video_id"), "conv_id",
        data.alias("data"),
        F.when(~own_menu & (conv % 16 == 5),
               F.to_json(F.struct(menu.alias("sortFilterSubMenuRenderer"),
                                  (900 + conv * 3).alias("commentCount")))).alias("retry_body"),
    )


def talk_captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(page_captures, response_captures) of whole channels: lists of their conversations, a
    thousand ids to a response, pages and comments of these, and a channel without any page."""
    conv = F.col("conv_id")
    at = F.timestamp_seconds(F.lit(1700000000))
    talks = table(spark, sf_dir, "conversations").select(
        "conv_id", talk_channel().alias("channel_ref"), talk_video().alias("video_id")).distinct()
    listed = talks.groupBy(
        "channel_ref", (F.floor(conv / 1000) + 1).cast("int").alias("response_seq")
    ).agg(F.array_sort(F.collect_list(F.struct("conv_id", "video_id"))).alias("rows"))
    items = F.transform("rows", lambda r: F.struct(F.struct(F.struct(F.struct(
        r["video_id"].alias("videoId")).alias("videoRenderer")).alias("content"))
        .alias("richItemRenderer")))
    none = F.lit(None).cast("string")
    lists = listed.select(
        "channel_ref", none.alias("video_id"), F.lit("videos").alias("kind"),
        F.lit(None).cast("int").alias("sort_by"), "response_seq", none.alias("request_token"),
        F.to_json(F.struct(F.array(F.struct(F.struct(items.alias("continuationItems"))
                                            .alias("appendContinuationItemsAction")))
                           .alias("onResponseReceivedActions"))).alias("body"),
        at.alias("fetched_at"))

    def html(data: Column) -> Column:
        return F.concat(F.lit("ytcfg.set({}); var ytInitialData = "), data, F.lit(";</script>"))

    first = talks.select("channel_ref").distinct().union(
        spark.range(1).select(F.lit("@gone").alias("channel_ref"))).select(
        "channel_ref", none.alias("video_id"), F.col("channel_ref").alias("url"),
        F.when(F.col("channel_ref") != "@gone", html(F.lit('{"contents": {"none": []}}')))
        .otherwise(F.lit("<html></html>")).alias("html"), at.alias("fetched_at"))
    watched = talk_pages(spark, sf_dir).select(
        "channel_ref", "video_id", F.col("video_id").alias("url"), html(F.col("data"))
        .alias("html"), at.alias("fetched_at"))
    return first.union(watched), lists.union(comment_captures(spark, sf_dir))


def counting_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two responses per conversation and order, each captured twice; in the latest captures of
    the recent order the first announces a number, the second another."""
    conv = F.col("conv_id")
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n"))
    rows = talks
    for c in ("response_seq", "sort_by", "again"):
        rows = rows.withColumn(c, F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(
        talk_channel().alias("channel_ref"), talk_video().alias("video_id"), "response_seq",
        "sort_by", F.timestamp_seconds(F.lit(1700000000) + F.col("again")).alias("fetched_at"),
        F.to_json(F.struct(
            F.when((F.col("sort_by") == 0) | (F.col("again") == 0), F.lit("7M comments"))
            .when((conv % 2 == 0) | (F.col("response_seq") == 1),
                  F.concat((F.col("n") * 10 + F.col("response_seq")).cast("string"),
                           F.lit("M comments"))).alias("commentCount"))).alias("body"),
    )


# --- nested bodies ------------------------------------------------------------------------


def customer_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested bodies: customers of a nation, 2,000 keys at a time, names at three depths."""
    k = F.col("c_custkey")
    rows = (
        table(spark, sf_dir, "customer")
        .groupBy("c_nationkey", F.floor(k / 2000).cast("int").alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("rows"))
    )
    listed = F.transform("rows", lambda r: F.struct(
        F.when(r["c_custkey"] % 2 == 0, r["c_name"]).alias("name"),
        F.when(r["c_custkey"] % 2 == 1, F.struct(F.struct(
            F.struct(r["c_name"].alias("name")).alias("name")).alias("inner"))).alias("deeper"),
    ))
    return rows.select(
        "c_nationkey", "part",
        F.to_json(F.struct(
            listed.alias("list"),
            F.concat(F.lit("nation \"é\" "), F.col("c_nationkey").cast("string")).alias("name"),
        )).alias("body"))


def order_token() -> Column:
    k = F.col("o_orderkey")
    return F.concat(F.repeat(F.lit("x"), (k % 4).cast("int")), F.format_string("%012d", k))


#: Where `endpoint_bodies` has its endpoints.
ENDPOINT_PLACES = ["items.*.continuationItemRenderer"]


def endpoint_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies offering a continuation for each order of a customer, 10,000 keys at a time."""
    rows = (
        table(spark, sf_dir, "orders")
        .select("o_custkey", F.floor(F.col("o_orderkey") / 10000).cast("int").alias("part"),
                "o_orderkey", order_token().alias("token"))
        .groupBy("o_custkey", "part")
        .agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "token"))).alias("rows"))
    )
    items = F.transform("rows", lambda r: F.struct(
        F.struct(_endpoint(r["token"]).alias("continuationEndpoint"))
        .alias("continuationItemRenderer")))
    return rows.select(
        "o_custkey", F.col("part").alias("response_seq"),
        F.to_json(F.struct(items.alias("items"))).alias("body"))


def offer_captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(responses, captures): an order offers a continuation per line; returned lines were asked.

    Lines up to 4 stand in the comment section, later ones behind a reply thread's button.
    """
    lines = table(spark, sf_dir, "lineitem")
    token = F.concat_ws("-", F.col("l_orderkey").cast("string"),
                        F.col("l_linenumber").cast("string"))
    n = F.col("l_linenumber")
    # Dealt by order once, which serves both the distinct lines and the lists.
    offered = (
        lines.select("l_orderkey", "l_linenumber").repartition("l_orderkey").distinct()
        .groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"))
    )

    # Every seventh order keeps its endpoints in another place.
    usual = F.col("l_orderkey") % 7 != 0

    def tokens(keep) -> Column:
        return F.transform(F.filter("lines", keep), lambda i: F.concat_ws(
            "-", F.col("l_orderkey").cast("string"), i.cast("string")))

    section = F.struct(
        F.lit("comments-section").alias("targetId"),
        F.transform(tokens(lambda i: i <= 4), lambda t: F.struct(
            F.when(usual, F.struct(F.struct(F.struct(F.array(F.struct(
                _next_item(t).alias("continuationItemRenderer"))).alias("contents"))
                .alias("commentRepliesRenderer")).alias("replies")))
            .alias("commentThreadRenderer"),
            F.when(~usual, F.struct(_endpoint(t).alias("continuationEndpoint"))).alias("other"),
        )).alias("continuationItems"),
    )
    replies = F.struct(
        F.concat(F.lit("comment-replies-item-"), F.col("l_orderkey").cast("string"))
        .alias("targetId"),
        F.transform(tokens(lambda i: i > 4), lambda t: F.struct(F.struct(F.struct(F.struct(
            _endpoint(t).alias("command")).alias("buttonRenderer")).alias("button"))
            .alias("continuationItemRenderer"))).alias("continuationItems"),
    )
    body = F.to_json(F.struct(F.array(
        F.struct(section.alias("reloadContinuationItemsCommand"),
                 replies.alias("appendContinuationItemsAction")),
    ).alias("onResponseReceivedEndpoints")))
    responses = offered.select(F.col("l_orderkey").alias("order_key"), body.alias("body"))
    captures = lines.filter("l_returnflag = 'R'").select(token.alias("request_token"))
    return responses, captures


# --- logs ---------------------------------------------------------------------------------


def run_logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(channel_list, run_log): a customer is a channel, a nation a run, debt a failure."""
    k = F.col("c_custkey")
    failed = F.col("c_acctbal") < 0
    log = table(spark, sf_dir, "customer").select(
        F.format_string("run-%02d", "c_nationkey").alias("run_id"),
        k.cast("int").alias("idx"),
        F.concat(F.lit("@"), "c_name").alias("channel"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
        F.when(failed, F.when(k % 2 == 0, F.lit("Failed to set sorting"))
               .otherwise(F.lit("Failed to extract ytInitialData"))).alias("error"),
        F.timestamp_micros(F.lit(1735689600000000) + k * 1000000).alias("started_at"),
        F.timestamp_micros(F.lit(1735689600000000) + k * 1000000 + (k % 1000) * 250000)
        .alias("finished_at"),
    )
    return log.select("run_id", "idx", "channel"), log


def customer_channel(key: str) -> Column:
    return F.format_string("@Customer#%09d", F.col(key))


def order_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        customer_channel("o_custkey").alias("channel_ref"),
        F.col("o_orderkey").alias("video_id"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("bytes"),
    )


def line_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`video_log`: a user is a channel, an event a video, numbered in order of the event id."""
    from vidlake.operators.accumulate import accumulate

    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("channel"), "event_id",
        F.concat(F.lit("e"), e.cast("string")).alias("video_id"),
        F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("ok"))
        .alias("status"),
        k.alias("comments"),
        (k * k * (e % 97) * 64).alias("bytes"),
        ((e % 40) * F.lit(0.25)).alias("elapsed_sec"),
        F.when(e % 5 != 0, k * (e % 5) - 1).alias("expected_total"),
    )
    one = F.lit(1).cast("bigint")
    log = accumulate(events, ["channel"], "event_id", {"_order": one},
                     {"_total": ("sum", one)})
    return log.select(
        "channel", F.col("_total").cast("int").alias("total_videos"),
        F.col("_order").cast("int").alias("order"), "video_id", "status", "comments", "bytes",
        "elapsed_sec", "expected_total")
