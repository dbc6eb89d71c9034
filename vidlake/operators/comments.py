"""Comments of a video, from the responses that carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake import SOURCE, schemas
from vidlake.functions.jsonscan import (
    body_error,
    count_name,
    find_many,
    found,
    json_scalar,
    mentions,
    parsed_body,
    suspect,
)
from vidlake.functions.refs import strip
from vidlake.operators.nested import is_empty
from vidlake.operators.places import placed
from vidlake.operators.unfold import unfold
from vidlake.session import staged

# Names in the bodies.
COMMENT_KEY = "commentEntityPayload"
TOOLBAR_KEY = "engagementToolbarStateEntityPayload"
ERROR_KEY = "externalErrorMessage"
HEARTED = "TOOLBAR_HEART_STATE_HEARTED"
SORT_POPULAR, SORT_RECENT = 0, 1

_KEYS = ["channel_ref", "video_id", "sort_by"]
RECORD = [c for c in schemas.COMMENT_FIELDS if c not in ("scraped_at", "source")]
_PAYLOADS = f"array<{schemas.COMMENT_PAYLOAD}>"
_STATES = f"array<{schemas.TOOLBAR_STATE}>"


def _present(mutations: Column, key: str, kind: str) -> Column:
    payloads = F.transform(mutations, lambda m: m["payload"][key])
    return F.coalesce(F.filter(payloads, lambda p: p.isNotNull()), F.array().cast(kind))


def problem(c: Column) -> Column:
    """What a comment lacks, NULL if it is complete."""
    required = [
        ("commentId", c["properties"]["commentId"]),
        ("toolbarStateKey", c["properties"]["toolbarStateKey"]),
        ("toolbar state", F.nullif(c["toolbar_at"], F.lit(0))),
        ("content", c["properties"]["content"]["content"]),
        ("publishedTime", c["properties"]["publishedTime"]),
        ("displayName", c["author"]["displayName"]),
        ("channelId", c["author"]["channelId"]),
        ("likeCountNotliked", c["toolbar"]["likeCountNotliked"]),
        ("replyCount", c["toolbar"]["replyCount"]),
        ("avatarThumbnailUrl", c["author"]["avatarThumbnailUrl"]),
    ]
    return F.coalesce(*[F.when(v.isNull(), F.lit(f"missing {name}")) for name, v in required])


def comment_record(c: Column) -> Column:
    """The fields of a comment and, in `record_error`, what it lacks."""
    text = c["properties"]["content"]["content"]
    cid = c["properties"]["commentId"]
    votes = c["toolbar"]["likeCountNotliked"]
    return F.struct(
        cid.alias("cid"),
        text.alias("text"),
        F.length(text).alias("text_length"),
        c["properties"]["publishedTime"].alias("time"),
        c["author"]["displayName"].alias("author"),
        c["author"]["channelId"].alias("channel"),
        F.when(votes.isNotNull(), F.coalesce(F.nullif(strip(votes), F.lit("")), F.lit("0")))
        .alias("votes"),
        c["toolbar"]["replyCount"].alias("replies"),
        c["author"]["avatarThumbnailUrl"].alias("photo"),
        F.coalesce(c["heart_state"] == HEARTED, F.lit(False)).alias("heart"),
        F.contains(cid, F.lit(".")).alias("reply"),
        problem(c).alias("record_error"),
    )


def server_error(value: Column) -> Column:
    """The failure of a response with the given error message, as JSON; NULL if it is empty."""
    message = F.nullif(json_scalar(value), F.lit(""))
    return F.concat(F.lit("Error returned from server: "), message)


def parse_comment_bodies(responses: DataFrame, sort_by: int = SORT_RECENT) -> DataFrame:
    """One row per comment response in the chosen order, its comments joined to their state.

    Responses that do not say their order are taken as recent, the order asked for by default.
    `n_comments`, `first_bad` (place of the first incomplete comment from 1, 0 for none) and
    `first_problem` sum up the comments, so that numbering and errors need not read them.

    Comments and toolbar states stand in one body, so their join is a lookup within the row
    (the first state of a key wins) and needs no shuffle. Bodies that hold either of them
    anywhere else than in the declared place are found by counting names, and searched, as are
    those nested too deep for Spark's parser. A body that is no JSON, or nested too deep for any
    parser, has no comments and says so in `body_error`.
    """
    chosen = F.col("sort_by") == sort_by
    if sort_by == SORT_RECENT:
        chosen = chosen | F.col("sort_by").isNull()
    rows = responses.filter((F.col("kind") == "comments") & chosen)
    rows = rows.withColumn("sort_by", F.lit(sort_by)).withColumn(
        "_doc", parsed_body(F.col("body"), schemas.COMMENT_BODY))
    mutations = F.col("_doc.frameworkUpdates.entityBatchUpdate.mutations")
    rows = rows.select(
        *_KEYS, "response_seq", "fetched_at", "body",
        _present(mutations, COMMENT_KEY, _PAYLOADS).alias("_comments"),
        _present(mutations, TOOLBAR_KEY, _STATES).alias("_states"),
        (suspect(F.col("_doc"), F.col("body")) & ~is_empty(F.col("body"))).alias("_suspect"),
    )
    deep = (count_name(F.col("body"), COMMENT_KEY) != F.size("_comments")) | (
        count_name(F.col("body"), TOOLBAR_KEY) != F.size("_states")
    )
    rows = rows.withColumn("_deep", deep)
    search = F.col("_deep") | F.col("_suspect") | mentions(F.col("body"), [ERROR_KEY])
    rows = rows.withColumn("_found", find_many(
        F.when(search, F.col("body")), [COMMENT_KEY, TOOLBAR_KEY, ERROR_KEY],
        anyway=F.col("_suspect")))

    def in_order(key: str, schema: str) -> Column:
        return F.transform(F.reverse(found(F.col("_found"), key)),
                           lambda v: F.from_json(v, schema))

    rows = rows.select(
        *_KEYS, "response_seq", "fetched_at", is_empty(F.col("body")).alias("empty"),
        server_error(F.get(found(F.col("_found"), ERROR_KEY), F.lit(0))).alias("server_error"),
        body_error(F.col("_found")).alias("body_error"),
        F.when(F.col("_deep"), in_order(COMMENT_KEY, schemas.COMMENT_PAYLOAD))
        .otherwise(F.col("_comments")).alias("_comments"),
        F.when(F.col("_deep"), in_order(TOOLBAR_KEY, schemas.TOOLBAR_STATE))
        .otherwise(F.col("_states")).alias("_states"),
    )
    keys = F.transform("_states", lambda s: s["key"])

    def joined(c: Column) -> Column:
        at = F.array_position(F.col("_state_keys"), c["properties"]["toolbarStateKey"])
        return F.struct(
            c["properties"].alias("properties"), c["author"].alias("author"),
            c["toolbar"].alias("toolbar"), at.alias("toolbar_at"),
            F.get(F.col("_states"), (at - 1).cast("int"))["heartState"].alias("heart_state"),
        )

    rows = rows.withColumn("_state_keys", keys).withColumn(
        "_joined", F.transform("_comments", joined))
    rows = rows.select(
        *_KEYS, "response_seq", "fetched_at", "empty", "server_error", "body_error",
        F.transform("_joined", comment_record).alias("comments"))
    bad = F.filter("comments", lambda c: c["record_error"].isNotNull())
    return rows.select(
        "*",
        F.size("comments").alias("n_comments"),
        F.array_position(F.transform("comments", lambda c: c["record_error"].isNotNull()), True)
        .cast("int").alias("first_bad"),
        F.get(bad, F.lit(0))["record_error"].alias("first_problem"),
    )


def ends_chain() -> Column:
    """Whether a parsed response ends its chain and does not count itself."""
    return F.expr("empty or server_error is not null or body_error is not null")


def number_responses(parsed: DataFrame, strict: bool = False, videos: DataFrame | None = None,
                     per_video_limit: int | None = None) -> DataFrame:
    """Responses that count, with the number of comments before each in its video.

    `parsed` comes from `parse_comment_bodies`, staged or not. With `videos`, only responses of
    those are kept and carry the video's number as `order`; the videos are joined to sums over
    thousands of responses, never to the comments, so the join adds no shuffle of them. With a
    limit, responses beyond it are left out.

    A video's chain ends at its first empty or unreadable body or server error. With `strict` it
    also ends at its first incomplete comment, which is dropped along with all after it.
    """
    if per_video_limit is not None and per_video_limit < 1:
        raise ValueError("per_video_limit must be at least 1")
    parsed = staged(parsed, "comment-pages")
    cut = F.col("first_bad") > 0
    # After a cut nothing follows, so counting the comments it drops moves no number.
    rows = placed(
        parsed, _KEYS, "n_comments", ends_chain(), "min",
        cut=cut if strict else None, limit=per_video_limit,
        lookup=None if videos is None else videos.select("channel_ref", "video_id", "order"),
    )
    if strict:
        rows = rows.withColumn("comments", F.when(
            cut, F.slice("comments", F.lit(1), F.col("first_bad") - 1)
        ).otherwise(F.col("comments")))
    return rows.select(
        *_KEYS, *([] if videos is None else ["order"]), "response_seq", "scraped_at", "comments",
        "before")


def comments(numbered: DataFrame, per_video_limit: int | None = None,
             source: str = SOURCE) -> DataFrame:
    """Comments in the order they were received, `pos` counting from 1 within their video.

    `numbered` comes from `number_responses`, best with the same limit, so that responses beyond
    it are left out before they are unfolded; its other columns are kept.
    """
    if per_video_limit is not None and per_video_limit < 1:
        raise ValueError("per_video_limit must be at least 1")
    if per_video_limit is not None:
        numbered = numbered.filter(F.col("before") < per_video_limit)
    rest = [c for c in numbered.columns if c not in ("comments", "before", "scraped_at")]
    rows = unfold(
        numbered, [*rest, "scraped_at", "before"], "comments", "_at", "_c"
    ).withColumn("pos", (F.col("before") + F.col("_at") + 1).cast("long"))
    if per_video_limit is not None:
        rows = rows.filter(F.col("pos") <= per_video_limit)
    return rows.select(
        *rest, "pos", *[f"_c.{c}" for c in RECORD], "scraped_at",
        F.lit(source).alias("source"), "_c.record_error",
    )


def video_errors(parsed: DataFrame) -> DataFrame:
    """The first failure of each video before its chain ends: an unreadable response, a server
    error or an incomplete comment. Where a response was captured more than once, the latest
    capture counts."""
    seq = F.col("response_seq")
    capture = F.struct("fetched_at", "empty",
                       F.coalesce("body_error", "server_error", "first_problem").alias("error"))
    rows = parsed.groupBy(*_KEYS, "response_seq").agg(F.max(capture).alias("_c")).select(
        *_KEYS, "response_seq", "_c.empty", "_c.error").filter("empty or error is not null")
    failed = F.col("error").isNotNull()
    return (
        rows.groupBy(*_KEYS)
        .agg(F.min(F.when(failed, seq)).alias("first_seq"),
             F.min(F.when(F.col("empty"), seq)).alias("_end"),
             F.min_by(F.col("error"), F.when(failed, seq)).alias("error"))
        .filter("first_seq is not null and (_end is null or first_seq < _end)")
        .drop("_end")
    )
