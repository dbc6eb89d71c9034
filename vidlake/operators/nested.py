"""Search in nested bodies: values by key, continuations, what is left to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake import schemas
from vidlake.functions.declared import at_places, parsed, readable, texts
from vidlake.functions.jsonscan import (
    body_error,
    count_name,
    find_items,
    find_many,
    find_values,
    first_value,
    parsed_body,
    suspect,
)
from vidlake.operators.unfold import unfold

# Names in the bodies.
ENDPOINT_KEY = "continuationEndpoint"
NEXT_ITEM_KEY = "continuationItemRenderer"
RELOAD_KEY = "reloadContinuationItemsCommand"
APPEND_KEY = "appendContinuationItemsAction"
COMMENT_SECTIONS = [
    "comments-section",
    "engagement-panel-comments-section",
    "shorts-engagement-panel-comments-section",
]
#: Where first pages have their continuations.
FIRST_PLACES = [
    "contents.twoColumnBrowseResultsRenderer.tabs.*.tabRenderer.content.richGridRenderer."
    f"contents.*.{NEXT_ITEM_KEY}",
    "contents.twoColumnWatchNextResults.results.results.contents.*.itemSectionRenderer."
    f"contents.*.{NEXT_ITEM_KEY}",
]
BUTTON_KEY = "buttonRenderer"
REPLIES_PREFIX = "comment-replies-item"

#: A body that is empty, or holds an empty value, ends its chain of responses.
_EMPTY = r'(?s)\A\s*(\{\s*\}|\[\s*\]|null|false|0|"")?\s*\z'


def is_empty(body: Column) -> Column:
    return body.isNull() | body.rlike(_EMPTY)


def search_key(df: DataFrame, body: str, key: str) -> DataFrame:
    """One row per value stored under `key` at any depth: `pos` in search order, `value` as JSON.

    A body that cannot be read has no values; `unsearched` lists those.
    """
    rest = [c for c in df.columns if c != body]
    found_values = df.withColumn("_values", find_values(F.col(body), key))
    return unfold(found_values, rest, "_values", "pos", "value")


def unsearched(df: DataFrame, body: str) -> DataFrame:
    """The rows whose body is no JSON, or nested too deep for any parser, with `body_error`.

    Only bodies that Spark's parser cannot read go to Python.
    """
    odd = F.col(body).isNotNull() & parsed(F.col(body)).isNull()
    matches = df.withColumn("_found", find_many(F.when(odd, F.col(body)), [], odd))
    rest = [c for c in df.columns if c != body]
    return matches.select(*rest, body_error(F.col("_found")).alias("body_error")).filter(
        "body_error is not null")


def _token(endpoint: Column) -> Column:
    return F.from_json(endpoint, schemas.ENDPOINT)["continuationCommand"]["token"]


def longest_continuation(body: Column) -> Column:
    """The endpoint with the longest token, the first found among equals; NULL if there is none.

    The comparison runs within the row, so nothing is shuffled. Every body is searched; see
    `add_longest`.
    """
    return _longest(find_values(body, ENDPOINT_KEY))


def _longest(endpoints: Column) -> Column:
    ranked = F.transform(
        endpoints,
        lambda e, i: F.struct(
            F.coalesce(F.length(_token(e)), F.lit(0)).alias("size"),
            (-i).alias("early"),
            e.alias("endpoint"),
        ),
    )
    return F.array_max(ranked)["endpoint"]


def add_longest(df: DataFrame, body: str, out: str,
                places: list[str] = FIRST_PLACES) -> DataFrame:
    """Add the endpoint with the longest token, the first found among equals.

    Bodies are parsed natively. Where `places` hold all endpoints that the text names, and only
    one of them has any, the answer is among those; other bodies are searched in Python, which
    gets a NULL for the rest.
    """
    text = F.col(body)
    df = df.withColumn("_node", parsed(text)).withColumn(
        "_at", at_places(F.col("_node"), text, ENDPOINT_KEY, places))
    missed = F.coalesce(~readable(F.col("_node"), text) | F.col("_at.missed"), F.lit(True))
    df = df.withColumn("_missed", text.isNotNull() & missed)
    df = df.withColumn("_searched", longest_continuation(F.when(F.col("_missed"), text)))
    return df.withColumn(out, F.when(F.col("_missed"), F.col("_searched")).otherwise(
        _longest(texts(F.col("_at.values"))))).drop("_node", "_at", "_missed", "_searched")


def token_of(endpoint: Column) -> Column:
    """The token of an endpoint given as JSON text."""
    return _token(endpoint)


def add_next_page(df: DataFrame, body: str, out: str) -> DataFrame:
    """Add the endpoint of the first continuation item found; NULL ends the paging.

    Search order starts at the end of a body. Where the declared places hold all continuation
    items there are, the last of them is the answer and nothing is searched.
    """
    df = df.withColumn("_doc", F.from_json(body, schemas.NEXT_BODY))
    endpoints, actions = (F.col(f"_doc.onResponseReceived{x}") for x in ("Endpoints", "Actions"))
    items = F.flatten(F.transform(F.coalesce(endpoints, actions), lambda a: F.coalesce(
        a["appendContinuationItemsAction"]["continuationItems"], F.array())))
    df = df.withColumn("_items", F.filter(
        F.transform(items, lambda i: i["continuationItemRenderer"]), lambda i: i.isNotNull()))
    seen = (endpoints.isNull() | actions.isNull()) & F.coalesce(
        F.size("_items") == count_name(F.col(body), NEXT_ITEM_KEY), F.lit(False))
    df = df.withColumn("_seen", seen)
    searched = F.get_json_object(
        first_value(F.when(~F.col("_seen"), F.col(body)), NEXT_ITEM_KEY), f"$.{ENDPOINT_KEY}")
    return df.withColumn("_searched", searched).withColumn(
        out,
        F.when(F.col("_seen"), F.try_element_at("_items", F.lit(-1))[ENDPOINT_KEY])
        .otherwise(F.col("_searched")),
    ).drop("_doc", "_items", "_seen", "_searched")


def next_tokens(df: DataFrame, body: str = "body", seq: str = "response_seq",
                places: list[str] = FIRST_PLACES) -> DataFrame:
    """Add `next_token`: longest continuation on the first page, next page on later ones."""
    first = F.col(seq) == 0
    df = df.withColumn("_first_body", F.when(first, F.col(body)))
    df = add_longest(df, "_first_body", "_first", places)
    df = add_next_page(
        df.withColumn("_later_body", F.when(~first, F.col(body))), "_later_body", "_later")
    return df.withColumn("next_token", token_of(F.coalesce("_first", "_later"))).drop(
        "_first_body", "_first", "_later_body", "_later"
    )


def _offer(action_pos: Column, item_pos: Column, target_id: Column, pos: Column, kind: str,
           token: Column) -> Column:
    return F.struct(
        action_pos.alias("action_pos"), item_pos.alias("item_pos"), target_id.alias("target_id"),
        pos.alias("pos"), F.lit(kind).alias("kind"), token.alias("token")).cast(schemas.OFFER)


def _in_section(target_id: Column) -> Column:
    return target_id.isin(COMMENT_SECTIONS)


def _in_replies(target_id: Column) -> Column:
    return target_id.startswith(REPLIES_PREFIX)


def _thread(item: Column) -> Column:
    return item["commentThreadRenderer"]["replies"]["commentRepliesRenderer"]["contents"]


def _read_natively(df: DataFrame, body: Column) -> DataFrame:
    """Add `_actions`, reload actions, then append actions, each group in search order, and
    `_seen`, whether they hold all actions and endpoints that the text names and, where there are
    reply threads, all buttons, an item one of each at most. Names are counted in a body as a
    whole, not in its items."""
    df = df.withColumn("_doc", parsed_body(body, schemas.ACTION_BODY))
    listed = F.col("_doc.onResponseReceivedEndpoints")
    none = F.array()

    def all_of(arrays: Column, kind: str) -> Column:
        return F.coalesce(F.flatten(F.array_compact(arrays)), none.cast(kind))

    def present(values: Column) -> Column:
        return F.coalesce(F.size(F.array_compact(values)), F.lit(0))

    native = {key: F.reverse(F.coalesce(F.array_compact(listed[key]), none.cast(schemas.ACTIONS)))
              for key in (RELOAD_KEY, APPEND_KEY)}
    df = df.withColumn("_actions", F.concat(*native.values()))
    df = df.withColumn("_items", all_of(
        F.col("_actions")["continuationItems"], schemas.CONTINUATION_ITEMS))
    own = F.col("_items")[NEXT_ITEM_KEY]
    replies = F.flatten(F.array_compact(_thread(F.col("_items"))))[NEXT_ITEM_KEY]
    one_each = ~F.exists("_items", lambda i: F.coalesce(F.size(_thread(i)) > 1, F.lit(False)) | (
        i[NEXT_ITEM_KEY][ENDPOINT_KEY].isNotNull() & _thread(i).isNotNull()))
    no_replies = ~F.exists(F.col("_actions")["targetId"], lambda t: F.coalesce(
        _in_replies(t), F.lit(False)))
    seen = (
        (present(listed[RELOAD_KEY]) == count_name(body, RELOAD_KEY))
        & (present(listed[APPEND_KEY]) == count_name(body, APPEND_KEY))
        & (present(own[ENDPOINT_KEY]) + present(replies[ENDPOINT_KEY])
           == count_name(body, ENDPOINT_KEY))
        & (no_replies | (present(own["button"][BUTTON_KEY]) == count_name(body, BUTTON_KEY)))
    )
    return df.withColumn("_seen", F.coalesce(
        ~suspect(F.col("_doc"), body) & ~body.rlike(r"\\u00[4-7]") & one_each & seen,
        F.lit(False))).drop("_doc", "_items")


def _seen_offers(actions: Column) -> Column:
    """The offers of actions that were read natively; an item has one at most."""
    def of_action(a: Column, at: Column) -> Column:
        target = a["targetId"]

        def of_item(i: Column, place: Column) -> Column:
            own = i[NEXT_ITEM_KEY]
            endpoint = F.coalesce(
                own[ENDPOINT_KEY], F.get(_thread(i), F.lit(0))[NEXT_ITEM_KEY][ENDPOINT_KEY])
            button = own["button"][BUTTON_KEY]
            first = F.lit(0)
            return F.when(
                _in_section(target) & endpoint.isNotNull(),
                _offer(at, place, target, first, "section",
                       endpoint["continuationCommand"]["token"]),
            ).when(
                _in_replies(target) & button.isNotNull(),
                _offer(at, place, target, first, "replies",
                       button["command"]["continuationCommand"]["token"]))

        return F.transform(F.coalesce(
            a["continuationItems"], F.array().cast(schemas.CONTINUATION_ITEMS)), of_item)

    return F.array_compact(F.flatten(F.transform(actions, of_action)))


def _searched_offers(actions: Column) -> Column:
    """The offers of actions that were searched, see `find_items`."""
    nothing = F.array().cast(f"array<{schemas.OFFER}>")

    def of_action(a: Column, at: Column) -> Column:
        target = a["target_id"]

        def of_item(i: Column, place: Column) -> Column:
            button = F.get(i[BUTTON_KEY], F.lit(0))
            return F.when(_in_section(target), F.transform(
                i[ENDPOINT_KEY], lambda e, n: _offer(at, place, target, n, "section", _token(e)))
            ).when(
                _in_replies(target) & F.array_contains(i["names"], NEXT_ITEM_KEY)
                & button.isNotNull(),
                F.array(_offer(at, place, target, F.lit(0), "replies", _token(
                    F.get_json_object(button, "$.command")))),
            ).otherwise(nothing)

        return F.flatten(F.transform(a["items"], of_item))

    return F.flatten(F.transform(actions, of_action))


def continuations(responses: DataFrame) -> DataFrame:
    """What each comment response offers to fetch next.

    Reload actions come before append actions. Items of a comment section offer every endpoint
    in them (`kind` = 'section'), items of a reply thread the command behind their button
    (`kind` = 'replies'). A body is parsed once with its items; one whose names count up to more
    than the usual shape holds is searched, once as a whole. Offers are made within the row, so
    no item becomes a row of its own before.
    """
    rest = [c for c in responses.columns if c != "body"]
    body = F.col("body")
    df = _read_natively(responses, body).select(
        *rest, F.when(F.col("_seen"), _seen_offers(F.col("_actions"))).alias("_offers"),
        F.when(~F.col("_seen"), body).alias("_missed"))
    df = df.withColumn("_found", find_items(
        F.col("_missed"), [RELOAD_KEY, APPEND_KEY], "continuationItems",
        [ENDPOINT_KEY, BUTTON_KEY]))
    searched = F.transform("_found", lambda a: F.struct(
        F.from_json(a["head"], schemas.ACTION_HEAD)["targetId"].alias("target_id"), a["items"]
        .alias("items")))
    df = df.select(*rest, "_offers", searched.alias("_searched"))
    offers = F.coalesce(F.col("_offers"), _searched_offers(F.col("_searched")))
    return unfold(df, rest, offers, "_at", "_offer").select(
        *rest, "_offer.action_pos", "_offer.item_pos", "_offer.target_id", "_offer.pos",
        "_offer.kind", "_offer.token")


def pending(offers: DataFrame, captures: DataFrame) -> DataFrame:
    """Offered continuations no capture has answered yet.

    Only the token column of the captures is read. Offers without a token cannot be asked for.
    """
    asked = captures.filter("request_token is not null").select(
        F.col("request_token").alias("token")
    )
    return offers.filter("token is not null").join(asked, "token", "left_anti")
