"""What responses offer, found within the row, and odd bodies."""

from __future__ import annotations

import json

from vidlake.operators import nested

RELOAD, APPEND = "reloadContinuationItemsCommand", "appendContinuationItemsAction"


def _token(t: str) -> dict:
    return {"continuationEndpoint": {"continuationCommand": {"token": t}}}


def _next(t: str) -> dict:
    return {"continuationItemRenderer": _token(t)}


def _button(t: str) -> dict:
    return {"continuationItemRenderer": {"button": {"buttonRenderer": {
        "command": _token(t)["continuationEndpoint"]}}}}


def _body(*actions: tuple[str, str, list], **more) -> str:
    return json.dumps({"onResponseReceivedEndpoints": [
        {name: {"targetId": target, "continuationItems": items}}
        for name, target, items in actions], **more})


def _offers(spark, *bodies: str | None) -> list[tuple]:
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    return sorted(tuple(r) for r in nested.continuations(rows).collect())


def test_one_search_and_no_row_for_an_item(spark):
    rows = spark.createDataFrame([(0, _body((RELOAD, "comments-section", [_next("a")])))],
                                 "i int, body string")
    plan = nested.continuations(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("Generate ") == 1


def test_places_of_offers(spark):
    section, replies = "comments-section", "comment-replies-item-1"
    body = _body((RELOAD, "header", [_next("no")]),
                 (RELOAD, section, [None, _next("a"), {"x": 1}, _next("b")]),
                 (APPEND, replies, [_button("c")]))
    moved = json.dumps({"deep": json.loads(body)})
    expected = [(0, 1, section, 0, "section", "a"), (0, 3, section, 0, "section", "b"),
                (2, 0, replies, 0, "replies", "c")]
    assert _offers(spark, body) == [(0, *o) for o in expected]
    assert _offers(spark, moved) == [(0, *o) for o in expected]


def test_names_spelled_with_escapes_are_found(spark):
    body = _body((RELOAD, "comments-section", [_next("a")]),
                 deep={RELOAD: {"targetId": "comments-section", "continuationItems": [_next("b")]}})
    at = body.rindex(RELOAD)
    hidden = body[:at] + body[at:].replace("reloadC", "reload\\u0043", 1)
    assert json.loads(hidden) == json.loads(body)
    assert {r[-1] for r in _offers(spark, hidden)} == {"a", "b"}


def test_odd_bodies_offer_what_can_be_read(spark):
    section, replies = "comments-section", "comment-replies-item-1"
    two = {"commentThreadRenderer": {"replies": {"commentRepliesRenderer": {"contents": [
        _next("t")]}}}, "z": _token("z")}
    assert _offers(
        spark, None, "", "{}", _body((RELOAD, section, [_next("cut")]))[:-3],
        _body((RELOAD, section, [7, "text", two])),
        _body((APPEND, replies, [{"continuationItemRenderer": None, "x": _button("no")}])),
        _body((APPEND, replies, [{"continuationItemRenderer": {"button": {
            "buttonRenderer": {}}}}])),
        _body((APPEND, replies, [_button("c") | {"z": {"buttonRenderer": {"command": _token(
            "last")["continuationEndpoint"]}}}])),
    ) == [(4, 0, 2, section, 0, "section", "z"), (4, 0, 2, section, 1, "section", "t"),
          (5, 0, 0, replies, 0, "replies", "no"), (6, 0, 0, replies, 0, "replies", None),
          (7, 0, 0, replies, 0, "replies", "last")]
