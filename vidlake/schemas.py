"""Declared schemas: capture tables, parsed bodies and the target tables.

Field names inside the bodies are those of the captured site; they are fixed values.
"""

from __future__ import annotations

# --- capture tables -----------------------------------------------------------------------

PAGE_CAPTURES = (
    "channel_ref string, video_id string, url string, html string, fetched_at timestamp"
)
RESPONSE_CAPTURES = (
    "channel_ref string, video_id string, kind string, sort_by int, response_seq int, "
    "request_token string, body string, fetched_at timestamp"
)
RUN_LOG = (
    "run_id string, idx int, channel string, status string, error string, "
    "started_at timestamp, finished_at timestamp"
)
VIDEO_LOG = (
    "channel string, total_videos int, order int, video_id string, status string, "
    "comments bigint, bytes bigint, elapsed_sec double, expected_total bigint"
)

# --- parsed bodies ------------------------------------------------------------------------

_TEXT = "struct<runs:array<struct<text:string>>,simpleText:string>"

VIDEO_RENDERER = (
    "struct<videoId:string,"
    f"title:{_TEXT},"
    "ownerText:struct<runs:array<struct<navigationEndpoint:"
    "struct<browseEndpoint:struct<browseId:string>>>>>,"
    f"viewCountText:{_TEXT},"
    "lengthText:struct<simpleText:string>,"
    "thumbnail:struct<thumbnails:array<struct<url:string>>>>"
)
# A declared string keeps whatever JSON stands there, which is enough to see that a key exists.
_ITEM = (
    "struct<continuationItemRenderer:string,"
    f"richItemRenderer:struct<content:struct<videoRenderer:{VIDEO_RENDERER}>>>"
)
_APPEND = f"array<struct<appendContinuationItemsAction:struct<continuationItems:array<{_ITEM}>>>>"

#: First pages (tabs) and both layouts of later pages.
VIDEO_BODY = (
    "struct<contents:struct<twoColumnBrowseResultsRenderer:struct<tabs:array<struct<tabRenderer:"
    "struct<selected:boolean,content:struct<richGridRenderer:struct<contents:"
    f"array<{_ITEM}>>>>>>>>,"
    f"onResponseReceivedEndpoints:{_APPEND},"
    f"onResponseReceivedActions:{_APPEND}>"
)
RICH_ITEM = f"struct<content:struct<videoRenderer:{VIDEO_RENDERER}>>"

COMMENT_PAYLOAD = (
    "struct<properties:struct<commentId:string,content:struct<content:string>,"
    "publishedTime:string,toolbarStateKey:string>,"
    "author:struct<displayName:string,channelId:string,avatarThumbnailUrl:string>,"
    "toolbar:struct<likeCountNotliked:string,replyCount:string>>"
)
TOOLBAR_STATE = "struct<key:string,heartState:string>"
COMMENT_BODY = (
    "struct<frameworkUpdates:struct<entityBatchUpdate:struct<mutations:array<struct<payload:"
    f"struct<commentEntityPayload:{COMMENT_PAYLOAD},"
    f"engagementToolbarStateEntityPayload:{TOOLBAR_STATE}>>>>>>"
)

_COUNT_TEXT = "struct<runs:array<struct<text:string>>,simpleText:string>"
COUNT_RENDERER = f"struct<text:{_COUNT_TEXT}>"
COUNT_HEADER = f"struct<countText:{_COUNT_TEXT},title:{_COUNT_TEXT}>"
COUNT_TEXT = _COUNT_TEXT
ENDPOINT = "struct<continuationCommand:struct<token:string>>"
SORT_MENU = f"struct<subMenuItems:array<struct<serviceEndpoint:{ENDPOINT}>>>"
#: An item of a comment section or a reply thread, as far as it leads on.
CONTINUATION_ITEM = (
    f"struct<continuationItemRenderer:struct<continuationEndpoint:{ENDPOINT},"
    f"button:struct<buttonRenderer:struct<command:{ENDPOINT}>>>,"
    "commentThreadRenderer:struct<replies:struct<commentRepliesRenderer:struct<contents:array<"
    f"struct<continuationItemRenderer:struct<continuationEndpoint:{ENDPOINT}>>>>>>>"
)
_ACTION = f"struct<targetId:string,continuationItems:array<{CONTINUATION_ITEM}>>"
_ACTIONS = (
    f"array<struct<reloadContinuationItemsCommand:{_ACTION},"
    f"appendContinuationItemsAction:{_ACTION}>>"
)
#: Actions of a comment response.
ACTION_BODY = f"struct<onResponseReceivedEndpoints:{_ACTIONS}>"
ACTION_HEAD = "struct<targetId:string>"
ACTIONS = f"array<{_ACTION}>"
CONTINUATION_ITEMS = f"array<{CONTINUATION_ITEM}>"
OFFER = (
    "struct<action_pos:int,item_pos:int,target_id:string,pos:int,kind:string,token:string>"
)
_NEXT = (
    "array<struct<appendContinuationItemsAction:struct<continuationItems:"
    "array<struct<continuationItemRenderer:struct<continuationEndpoint:string>>>>>>"
)
#: The continuation items of a later page of videos.
NEXT_BODY = f"struct<onResponseReceivedEndpoints:{_NEXT},onResponseReceivedActions:{_NEXT}>"

# --- target tables ------------------------------------------------------------------------

#: Fields of an exported video, in their documented order.
VIDEO_FIELDS = [
    "video_id", "title", "title_length", "channel_id", "view_count", "view_count_raw",
    "length", "length_minutes", "thumbnail_url", "url", "order",
]
#: Fields of an exported comment, in their documented order.
COMMENT_FIELDS = [
    "cid", "text", "text_length", "time", "author", "channel", "votes", "replies", "photo",
    "heart", "reply", "scraped_at", "source",
]
