"""What a video's page says about its comments: enabled or not, how many, in which orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake import schemas
from vidlake.functions.declared import at_places, parsed, readable, texts, values_at
from vidlake.functions.jsonscan import (
    count_name, find_many, find_values, first_value, found, json_scalar,
)
from vidlake.functions.numbers import parse_comment_count
from vidlake.operators.comments import SORT_RECENT
from vidlake.operators.nested import ENDPOINT_KEY, NEXT_ITEM_KEY, is_empty, token_of
from vidlake.session import stage

# Where a number of comments may stand, tried in this order.
COUNT_KEYS = ["commentCountRenderer", "headerRenderer", "commentsHeaderRenderer", "commentCount"]
SECTION_KEY = "itemSectionRenderer"
MENU_KEY = "sortFilterSubMenuRenderer"
LIST_KEY = "sectionListRenderer"
SORT_ERROR = "Failed to set sorting"

# Where those names stand in pages and responses as they are now, as paths; `*` is
# every element of an array. The last item section of an array is the one found first.
_PANEL = "engagementPanels.*.engagementPanelSectionListRenderer"
_RESULTS = "contents.twoColumnWatchNextResults.results.results.contents.*"
_RELOAD = "onResponseReceivedEndpoints.*.reloadContinuationItemsCommand.continuationItems.*"
PLACES = {
    SECTION_KEY: [f"{LIST_KEY}.contents.*", _RESULTS],
    MENU_KEY: ["", f"{_PANEL}.header.engagementPanelTitleHeaderRenderer.menu",
               f"{_RELOAD}.commentsHeaderRenderer.sortMenu"],
    LIST_KEY: ["", f"{_PANEL}.content"],
    "commentCountRenderer": [""],
    "headerRenderer": [""],
    "commentsHeaderRenderer": ["", _RELOAD],
    "commentCount": [""],
}
#: Inside a section, what tells that it holds comments; inside a list, its continuations. None
#: of these places of a list lies inside or beside another, so a search meets them from the end
#: of the text.
SECTION_ITEMS = ["", "contents.*"]
LIST_ITEMS = ["continuations.*", f"contents.*.{SECTION_KEY}.{NEXT_ITEM_KEY}",
              f"contents.*.{SECTION_KEY}.contents.*.{NEXT_ITEM_KEY}"]


def _first_positive(texts: Column) -> Column:
    counts = F.filter(F.transform(texts, parse_comment_count), lambda n: n > 0)
    return F.get(counts, F.lit(0))


def _runs(t: Column) -> Column:
    """The texts of all runs, then the simple text."""
    runs = F.transform(t["runs"], lambda r: r["text"])
    return F.concat(F.coalesce(runs, F.array()), F.array(t["simpleText"]))


def _first_run(t: Column) -> Column:
    """The text of the first run, then the simple text."""
    return F.array(F.get(t["runs"], F.lit(0))["text"], t["simpleText"])


def _add_count(df: DataFrame, body: str | None, matches: str, out: str) -> DataFrame:
    """Add the first non-zero count of five sources, four of them among `matches`.

    The last source, any text speaking of comments, is searched only where the others fail, and
    not at all without `body`.
    """
    first = {k: F.get(found(F.col(matches), k), F.lit(0)) for k in COUNT_KEYS}
    df = df.select(
        "*",
        F.from_json(first["commentCountRenderer"], schemas.COUNT_RENDERER).alias("_renderer"),
        F.from_json(first["headerRenderer"], schemas.COUNT_HEADER).alias("_header"),
        F.from_json(first["commentsHeaderRenderer"], schemas.COUNT_HEADER).alias("_comments"),
        F.when(~first["commentCount"].rlike(r"^[\[{]"), json_scalar(first["commentCount"]))
        .alias("_number"),
    )
    df = df.withColumn("_named", F.concat(
        _first_run(F.col("_renderer.text")),
        _first_run(F.col("_header.countText")),
        _first_run(F.col("_comments.countText")),
        _runs(F.col("_comments.title")),
        F.array("_number"),
    ))
    df = df.withColumn("_count", _first_positive(F.col("_named")))
    if body is None:
        return df.withColumn(out, F.col("_count")).drop(
            "_renderer", "_header", "_comments", "_number", "_named", "_count")
    df = df.withColumn(
        "_texts", find_values(F.when(F.col("_count").isNull(), F.col(body)), "text")
    )
    candidates = F.flatten(F.transform(
        F.filter("_texts", lambda v: v.startswith("{")),
        lambda v: _runs(F.from_json(v, schemas.COUNT_TEXT)),
    ))
    speaking = F.filter(
        candidates, lambda s: F.contains(F.lower(s), F.lit("comment")) & s.rlike(r"\d")
    )
    return df.withColumn(out, F.coalesce("_count", _first_positive(speaking))).drop(
        "_renderer", "_header", "_comments", "_number", "_named", "_count", "_texts"
    )


def _at_declared(df: DataFrame, body: str, keys: list[str], out: str) -> DataFrame:
    """Add `out`, like `find_many`: JSON texts of the values at declared places; its `_missed`
    tells that others may be found by a search. Nothing is parsed in Python."""
    node = f"{out}_node"
    df = df.withColumn(node, parsed(F.col(body)))
    df = df.withColumn(out, F.struct(*[
        at_places(F.col(node), F.col(body), k, PLACES[k]).alias(k) for k in keys]))
    missed = ~readable(F.col(node), F.col(body))
    for k in keys:
        missed = missed | F.col(out)[k]["missed"]
    return df.withColumn(out, F.struct(
        *[F.coalesce(texts(F.col(out)[k]["values"]), F.array().cast("array<string>")).alias(k)
          for k in keys],
        (F.col(body).isNotNull() & F.coalesce(missed, F.lit(True))).alias("_missed"))).drop(node)


def _may_speak(body: Column) -> Column:
    """Whether a body may hold a text that speaks of comments, beyond the declared places."""
    return F.coalesce(body.rlike(r'"text"\s*:\s*\{') & body.rlike("(?i)comment"), F.lit(False))


def add_comment_count(df: DataFrame, body: str, out: str) -> DataFrame:
    """Add the number of comments a body announces, NULL if none.

    Bodies are parsed natively and only those whose declared places do not hold all there is are
    searched. `df` is staged for it without bodies that are done with.
    """
    df = _at_declared(df, body, COUNT_KEYS, "_found")
    df = _add_count(df, None, "_found", out).withColumn(
        "_search", F.col("_found._missed") | (F.col(out).isNull() & _may_speak(F.col(body))))
    df = df.drop("_found").withColumn(body, F.when(F.col("_search"), F.col(body)))
    known, left = _split(df, "counts")
    if left is None:
        return known
    left = left.drop(out).withColumn("_found", find_many(F.col(body), COUNT_KEYS))
    return known.unionByName(_add_count(left, body, "_found", out).drop("_found"))


def _split(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """What is known natively, and what has to be searched, or None if there is no such row."""
    df = stage(df, name)
    left = df.filter("_search").drop("_search")
    return df.filter("not _search").drop("_search"), None if left.isEmpty() else left


def _menu(renderer: Column) -> Column:
    return F.from_json(renderer, schemas.SORT_MENU)["subMenuItems"]


def video_facts(pages: DataFrame, sort_by: int, retry: str | None = None) -> DataFrame:
    """What the pages' `data` says about their comments.

    Adds `comments_enabled` (the first item section holds a continuation), `page_total` (the
    number of comments announced), `sort_token` and `sort_error` (the menu's entry for the
    chosen order, or that it is missing) and `retry_token` (the first continuation of the
    section list, to be asked where there is no menu). `retry` names a column with the body
    captured in answer to that token: where the page has no menu, both the menu and the number of
    comments are taken from that body, and a page without such a body has neither.

    Pages are parsed natively, once, and staged. Only pages with such names at other than the
    declared `PLACES`, or that cannot be read so, are searched; without such pages the plan has
    no Python step. Bodies are staged for the pages that are searched only, and not returned.
    """
    bodies = ["data", *([retry] if retry else [])]
    facts = _facts_at_places(pages, sort_by, retry).withColumns(
        {b: F.when(F.col("_search"), F.col(b)) for b in bodies})
    known, left = _split(facts, "watch-facts")
    if left is None:
        return known.drop(*bodies)
    own = ["comments_enabled", "page_total", "sort_token", "sort_error", "retry_token"]
    left = _searched_facts(left.drop(*own), sort_by, retry)
    return known.unionByName(left).drop(*bodies)


def _facts_at_places(pages: DataFrame, sort_by: int, retry: str | None) -> DataFrame:
    """The facts from the declared places, and `_search`, whether they may be others."""
    keys = [SECTION_KEY, MENU_KEY, LIST_KEY, *COUNT_KEYS]
    df = _at_declared(pages, "data", keys, "_page")
    first = {k: F.get(F.col("_page")[k], F.lit(0)) for k in keys}
    df = df.select("*", first[SECTION_KEY].alias("_section"), first[LIST_KEY].alias("_list"),
                   _menu(first[MENU_KEY]).alias("_menu"), F.col("data").alias("_counted"),
                   F.col("_page._missed").alias("_search"))
    if retry:
        df = _at_declared(df, retry, [MENU_KEY, *COUNT_KEYS], "_retry")
        df = df.withColumn("_lacking", F.coalesce(F.size("_menu"), F.lit(0)) < 1)
        df = df.withColumns({
            "_search": F.col("_search") | (F.col("_lacking") & F.col("_retry._missed")),
            "_counted": F.when(F.col("_lacking"), F.col(retry)).otherwise(F.col("data")),
            "_menu": F.when(F.col("_lacking"), _menu(F.get(F.col("_retry")[MENU_KEY], F.lit(0))))
            .otherwise(F.col("_menu")),
            "_page": F.struct(*[
                F.when(F.col("_lacking"), F.col("_retry")[k]).otherwise(F.col("_page")[k])
                .alias(k) for k in COUNT_KEYS]),
        }).drop("_lacking", "_retry")
    df = _add_count(df, None, "_page", "page_total")
    section, listed = parsed(F.col("_section")), parsed(F.col("_list"))
    df = df.withColumns({
        "_item": at_places(section, F.col("_section"), NEXT_ITEM_KEY, SECTION_ITEMS),
        "_ends": F.size(F.concat(*[values_at(listed, f"{p}.{ENDPOINT_KEY}") for p in LIST_ITEMS])),
        # The texts of variants have their names sorted; the list as it stands is needed here.
        "_text": F.get_json_object("data", f"$.{LIST_KEY}"),
    })
    ends = F.coalesce(count_name(F.col("_list"), ENDPOINT_KEY), F.lit(0))
    last = F.regexp_extract("_text", f'(?s)\\A.*"{ENDPOINT_KEY}"\\s*:(.*)', 1)
    df = df.withColumns({
        "comments_enabled": ~is_empty(F.get(texts(F.col("_item.values")), F.lit(0))),
        "retry_token": F.when(ends > 0, token_of(last)),
        "_search": F.col("_search") | F.coalesce(F.col("_item.missed"), F.lit(False))
        | (ends != F.coalesce("_ends", F.lit(0))) | ((ends > 0) & F.col("_text").isNull())
        | (F.col("page_total").isNull() & _may_speak(F.col("_counted"))),
    })
    return _with_order(df, sort_by).drop("_page", "_counted", "_section", "_list", "_menu",
                                         "_item", "_ends", "_text")


def _searched_facts(pages: DataFrame, sort_by: int, retry: str | None) -> DataFrame:
    """The facts by a search; each page is searched once."""
    keys = [SECTION_KEY, MENU_KEY, LIST_KEY, *COUNT_KEYS]
    df = pages.withColumn("_page", find_many(F.col("data"), keys))
    first = {k: F.get(found(F.col("_page"), k), F.lit(0)) for k in keys}
    df = df.select("*", first[SECTION_KEY].alias("_section"), first[LIST_KEY].alias("_list"),
                   _menu(first[MENU_KEY]).alias("_menu"))
    df = df.withColumn("_counted", F.col("data"))
    if retry:
        lacking = F.coalesce(F.size("_menu"), F.lit(0)) < 1
        again = [MENU_KEY, *COUNT_KEYS]
        df = df.withColumn("_lacking", lacking).withColumn(
            "_retry", find_many(F.when(F.col("_lacking"), F.col(retry)), again))
        df = df.withColumns({
            "_counted": F.when(F.col("_lacking"), F.col(retry)).otherwise(F.col("data")),
            "_menu": F.when(F.col("_lacking"), _menu(F.get(found(F.col("_retry"), MENU_KEY),
                                                           F.lit(0)))).otherwise(F.col("_menu")),
            "_page": F.struct(*[
                F.when(F.col("_lacking"), F.col("_retry")[k]).otherwise(F.col("_page")[k])
                .alias(k) for k in COUNT_KEYS]),
        }).drop("_lacking", "_retry")
    df = _add_count(df, "_counted", "_page", "page_total")
    df = df.select(
        "*",
        (~is_empty(first_value(F.col("_section"), "continuationItemRenderer")))
        .alias("comments_enabled"),
        token_of(first_value(F.col("_list"), "continuationEndpoint")).alias("retry_token"),
    )
    return _with_order(df, sort_by).drop("_page", "_counted", "_section", "_list", "_menu")


def _with_order(df: DataFrame, sort_by: int) -> DataFrame:
    """The menu's entry for an order."""
    entry = F.get("_menu", F.lit(sort_by))
    return df.select(
        "*",
        entry["serviceEndpoint"]["continuationCommand"]["token"].alias("sort_token"),
        F.when(F.coalesce(F.size("_menu"), F.lit(0)) <= sort_by, F.lit(SORT_ERROR))
        .alias("sort_error"),
    )


def latest_facts(facts: DataFrame) -> DataFrame:
    """One row per video: `comments_enabled`, `sort_error`, `page_total` of its latest capture.

    Without `fetched_at` a video has one page; of several, the same one is always taken.
    """
    keys = ["channel_ref", "video_id"]
    stamp = ["fetched_at"] if "fetched_at" in facts.columns else []
    capture = F.struct(*stamp, "comments_enabled", "sort_error", "page_total")
    return facts.groupBy(*keys).agg(F.max(capture).alias("_c")).select(
        *keys, "_c.comments_enabled", "_c.sort_error", "_c.page_total")


def sort_failures(facts: DataFrame) -> DataFrame:
    """Videos whose comments are on but cannot be had in the chosen order, with the error."""
    return latest_facts(facts).filter("comments_enabled and sort_error is not null").select(
        "channel_ref", "video_id", F.col("sort_error").alias("error"))


def comment_totals(facts: DataFrame, responses: DataFrame,
                   sort_by: int = SORT_RECENT) -> DataFrame:
    """Announced number of comments per video: the page's, else the first response's.

    NULL where comments are off or the order asked for is not offered, since nothing is asked
    then. `facts` comes from `video_facts`; `responses` are comment responses, of which those in
    the order `sort_by` count (those that do not say their order are recent). Bodies are searched
    where they are read and never shuffled: the latest place at which any chain begins, one
    number found from the narrow columns, is pushed to the scan as a filter, and only counts
    meet the pages. Of captures of one page or response the latest counts, so the partitioning
    of the input makes no difference.
    """
    keys = ["channel_ref", "video_id"]
    of_page = latest_facts(facts).withColumn(
        "_asked", F.expr("comments_enabled and sort_error is null"))
    if "sort_by" in responses.columns:
        responses = responses.filter(
            F.coalesce("sort_by", F.lit(SORT_RECENT)) == sort_by)
    begins = responses.groupBy(*keys).agg(F.min("response_seq").alias("first"))
    latest = begins.agg(F.max("first")).first()[0]
    early = responses.filter(F.col("response_seq") <= (0 if latest is None else latest))
    place = [F.col("response_seq")]
    if "fetched_at" in responses.columns:
        place.append(-F.unix_micros("fetched_at"))
    of_first = add_comment_count(early, "body", "total").groupBy(*keys).agg(
        F.min_by("total", F.struct(*place)).alias("response_total"))
    return of_page.join(of_first, keys, "left").select(
        *keys, F.when(F.col("_asked"), F.coalesce("page_total", "response_total"))
        .alias("total_count")
    )


def expected_total(total: Column, limit: int | None = None) -> Column:
    """What progress is measured against: the limit if one is set, else the announced total."""
    return total if limit is None else F.lit(limit).cast("bigint")
