"""Videos of a channel, from its first page and the responses after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake import schemas
from vidlake.functions.jsonscan import body_error, find_many, found, parsed_body, suspect
from vidlake.functions.numbers import length_to_minutes, parse_view_count
from vidlake.functions.refs import watch_url
from vidlake.operators.embedded import extract_data
from vidlake.operators.nested import is_empty
from vidlake.operators.places import placed
from vidlake.operators.unfold import unfold
from vidlake.session import staged

_RENDERERS = f"array<{schemas.VIDEO_RENDERER}>"


def _none() -> Column:
    return F.array().cast(_RENDERERS)


def _ids_only(renderers: Column) -> Column:
    return F.filter(renderers, lambda r: F.coalesce(r["videoId"], F.lit("")) != "")


def _of_items(items: Column) -> Column:
    return F.transform(items, lambda i: i["richItemRenderer"]["content"]["videoRenderer"])


def _later_page(actions: Column) -> Column:
    items = F.flatten(F.transform(actions, lambda a: F.coalesce(
        a["appendContinuationItemsAction"]["continuationItems"], F.array())))
    return _of_items(F.filter(items, lambda i: i["continuationItemRenderer"].isNull()))


def _first_page(tabs: Column) -> Column:
    grid = "richGridRenderer"
    tab = F.coalesce(
        F.get(F.filter(tabs, lambda t: t["tabRenderer"]["selected"]), F.lit(0)),
        F.get(F.filter(tabs, lambda t: t["tabRenderer"]["content"][grid].isNotNull()), F.lit(0)),
        F.get(tabs, F.lit(0)),
    )
    return _of_items(tab["tabRenderer"]["content"][grid]["contents"])


def channel_responses(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """First pages and video responses as one bag of bodies; the first page is number 0.

    `pages` holds html, or the `data` that `embedded.read_pages` found.
    """
    first = pages.filter("video_id is null")
    first = first if "data" in pages.columns else extract_data(first)
    first = first.select(
        "channel_ref", F.lit(0).alias("response_seq"), F.col("data").alias("body"), "fetched_at")
    later = responses.filter("kind = 'videos'").select(
        "channel_ref", "response_seq", "body", "fetched_at"
    )
    return first.unionByName(later)


def _text(*choices: Column) -> Column:
    """The first choice that is neither missing nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit(""))


def _first(runs: Column) -> Column:
    return F.get(runs, F.lit(0))


def _texts(r: Column) -> Column:
    """The texts a video's fields are made of."""
    return F.struct(
        r["videoId"].alias("video_id"),
        _text(_first(r["title"]["runs"])["text"], r["title"]["simpleText"]).alias("title"),
        _first(r["ownerText"]["runs"])["navigationEndpoint"]["browseEndpoint"]["browseId"]
        .alias("owner"),
        _text(r["viewCountText"]["simpleText"], _first(r["viewCountText"]["runs"])["text"])
        .alias("view_count_raw"),
        _text(r["lengthText"]["simpleText"]).alias("length"),
        _text(F.try_element_at(r["thumbnail"]["thumbnails"], F.lit(-1))["url"])
        .alias("thumbnail_url"),
    )


def parse_video_bodies(bodies: DataFrame) -> DataFrame:
    """One row per body: the texts of its videos in order, their number, whether it is empty.

    Every body is parsed once against a declared schema that knows the first page and both
    layouts of later ones. Only a body of neither later layout whose ordered parse yields
    nothing is searched in depth: rich items first, then grid videos. A body that is no JSON, or
    nested too deep for any parser, has no videos and says so in `body_error`.
    """
    parsed = bodies.withColumn("_doc", parsed_body(F.col("body"), schemas.VIDEO_BODY))
    actions = F.coalesce("_doc.onResponseReceivedEndpoints", "_doc.onResponseReceivedActions")
    ordered = F.when(actions.isNotNull(), _later_page(actions)).otherwise(
        _first_page(F.col("_doc.contents.twoColumnBrowseResultsRenderer.tabs"))
    )
    parsed = parsed.withColumn("_ordered", F.coalesce(_ids_only(ordered), _none()))
    parsed = parsed.withColumn("_suspect", (
        suspect(F.col("_doc"), F.col("body")) & ~is_empty(F.col("body"))))
    search = actions.isNull() & (F.size("_ordered") == 0)
    parsed = parsed.withColumn("_found", find_many(
        F.when(search | F.col("_suspect"), F.col("body")),
        ["richItemRenderer", "gridVideoRenderer"], anyway=F.col("_suspect")))
    deep = F.concat(
        F.transform(found(F.col("_found"), "richItemRenderer"), lambda v: F.from_json(
            v, schemas.RICH_ITEM)["content"]["videoRenderer"]),
        F.transform(found(F.col("_found"), "gridVideoRenderer"), lambda v: F.from_json(
            v, schemas.VIDEO_RENDERER)),
    )
    rest = [c for c in bodies.columns if c != "body"]
    return parsed.select(
        *rest,
        is_empty(F.col("body")).alias("empty"),
        body_error(F.col("_found")).alias("body_error"),
        F.transform(F.when(search, _ids_only(deep)).otherwise(F.col("_ordered")), _texts)
        .alias("videos"),
    ).withColumn("n_videos", F.size("videos"))


def video_records(rows: DataFrame, fill_channel: Column) -> DataFrame:
    """Turn the texts in `_video` into the fields of a video.

    `fill_channel` says where a missing owner becomes the channel.
    """
    texts = rows.select(*[c for c in rows.columns if c != "_video"], "_video.*")
    return texts.select(
        "*",
        F.length("title").alias("title_length"),
        _text(F.col("owner"), F.when(fill_channel, F.col("channel_ref"))).alias("channel_id"),
        parse_view_count(F.col("view_count_raw")).alias("view_count"),
        length_to_minutes(F.col("length")).alias("length_minutes"),
        watch_url(F.col("video_id")).alias("url"),
    )


def videos(parsed: DataFrame, max_videos: int | None = None,
           fill_first_page: bool = False) -> DataFrame:
    """Videos of every channel in page order, numbered from 1, optionally the first N only.

    `parsed` comes from `parse_video_bodies`, staged or not. Numbers are the videos on the pages
    before plus the place on the page; pages beyond the limit are dropped before they are
    unfolded. An empty or unreadable body ends its channel. Videos without an owner take the channel's
    reference on all pages but the first, or on all with `fill_first_page`.
    """
    if max_videos is not None and max_videos < 1:
        raise ValueError("max_videos must be at least 1")
    pages = placed(staged(parsed, "video-pages"), ["channel_ref"], "n_videos",
                   F.expr("empty or body_error is not null"), "max", limit=max_videos)
    rows = unfold(
        pages, ["channel_ref", "response_seq", "scraped_at", "before"], "videos",
        "_pos", "_video",
    ).withColumn("order", (F.col("before") + F.col("_pos") + 1).cast("int"))
    if max_videos is not None:
        rows = rows.filter(F.col("order") <= max_videos)
    fill = F.lit(True) if fill_first_page else F.col("response_seq") > 0
    return video_records(rows, fill).select("channel_ref", *schemas.VIDEO_FIELDS, "scraped_at")


def channel_errors(parsed: DataFrame) -> DataFrame:
    """Channels with a page that cannot be read before their end: `first_seq` and the error.

    `parsed` comes from `parse_video_bodies`. Where a page was captured more than once, the
    latest capture counts.
    """
    seq = F.col("response_seq")
    capture = F.struct("fetched_at", "empty", "body_error")
    rows = parsed.groupBy("channel_ref", "response_seq").agg(F.max(capture).alias("_c")).select(
        "channel_ref", "response_seq", "_c.*").filter("empty or body_error is not null")
    failed = F.when(F.col("body_error").isNotNull(), seq)
    return (
        rows.groupBy("channel_ref")
        .agg(F.min(failed).alias("first_seq"), F.min(F.when(F.col("empty"), seq)).alias("_end"),
             F.min_by("body_error", failed).alias("error"))
        .filter("first_seq is not null and (_end is null or first_seq < _end)").drop("_end")
    )
