from __future__ import annotations

import json
import math
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vidlake.functions.jsonscan import balanced_object, values_of
from vidlake.operators import nested
from vidlake.operators.embedded import extract_config, extract_data

KEYS = st.sampled_from(["k", "a", "b", "c"])
TREES = st.recursive(
    st.integers() | st.text("ab{}\"\\", max_size=4) | st.none(),
    lambda t: st.lists(t, max_size=4) | st.dictionaries(KEYS, t, max_size=4), max_leaves=25)


def by_place(tree, key):
    """All values of a key with their place, sorted: own values first, then from the last child."""
    places = []

    def walk(node, place):
        children = (node.items() if isinstance(node, dict)
                    else enumerate(node) if isinstance(node, list) else ())
        for i, (name, child) in enumerate(children):
            if isinstance(node, dict) and name == key:
                places.append((place + (-math.inf,), child))
            else:
                walk(child, place + (-i,))

    walk(tree, ())
    return [child for _, child in sorted(places, key=lambda p: p[0])]


@given(TREES)
def test_search_order(tree):
    assert list(values_of(tree, "k")) == by_place(tree, "k")


@given(st.dictionaries(KEYS, TREES, max_size=4), st.text("x{}\"\\", max_size=6))
def test_balanced_object_is_the_whole_object(tree, tail):
    text = json.dumps(tree)
    assert balanced_object("go(" + text + tail, re.compile(r"go\(\{")) == text


def test_balanced_object_that_never_closes():
    assert balanced_object('go({"a": {"}"}', re.compile(r"go\(\{")) is None
    assert balanced_object("nothing", re.compile(r"go\(\{")) is None


def rows(spark, bodies, **columns):
    return spark.createDataFrame(
        [(i, b if b is None or isinstance(b, str) else json.dumps(b))
         for i, b in enumerate(bodies)], "i int, body string")


def test_search_key(spark):
    df = rows(spark, [
        {"k": {"k": 1}, "x": [{"k": "é"}, {"k": None}]}, {"x": 1}, None, "not json \"k\":",
        '{"\\u006b": 5}'])
    got = [(r.i, r.pos, json.loads(r.value))
           for r in nested.search_key(df, "body", "k").orderBy("i", "pos").collect()]
    assert got == [(0, 0, {"k": 1}), (0, 1, None), (0, 2, "é"), (4, 0, 5)]


def token(t):
    return {"continuationEndpoint": {"continuationCommand": {"token": t}}}


def test_continuations_to_follow(spark):
    item = "continuationItemRenderer"
    bodies = [
        {"a": [token("xx"), token("yyy"), token("zzz")]},  # the later of two longest is met first
        {"a": [{"continuationEndpoint": {}}]},
        {"a": 1},
        {"a": [{item: token("first")}, {item: token("last")}]},
        {"onResponseReceivedActions": [{"appendContinuationItemsAction": {"continuationItems": [
            {item: token("one")}, {item: token("two")}]}}]},
        {"onResponseReceivedActions": [{"appendContinuationItemsAction": {"continuationItems": [
            {item: token("declared")}]}}], "z": {item: token("elsewhere")}},
        {"onResponseReceivedActions": [{"appendContinuationItemsAction": {"continuationItems": [
            {item: {"other": 1}}]}}]},
    ]
    df = rows(spark, bodies)
    longest = [r[0] for r in df.select("i", nested.token_of(
        nested.longest_continuation(F.col("body"))).alias("t")).orderBy("i").select("t").collect()]
    assert longest[:3] == ["zzz", None, None]
    df = nested.add_next_page(df, "body", "next").select("i", nested.token_of(F.col("next")))
    assert [r[1] for r in df.orderBy("i").collect()] == [
        None, None, None, "last", "two", "elsewhere", None]


def test_longest_at_declared_places(spark):
    item = "continuationItemRenderer"
    bodies = [
        {"a": [{item: token("xx")}, {item: token("yyy")}, {item: token("zzz")}]},
        {"a": [{item: {"continuationEndpoint": {}}}]}, {"a": 1}, None, "not json",
        {"a": [{item: token("é")}], "b": token("elsewhere")},  # searched
        {"a": [{item: token("one")}], "c": [{item: token("two")}]},  # at two places: searched
        '{"a": [{"continuationItemRenderer": {"continuation\\u0045ndpoint": {'
        '"continuationCommand": {"token": "escaped"}}}}]}',
    ]
    df = rows(spark, bodies)
    places = [f"a.*.{item}", f"c.*.{item}"]
    df = nested.add_longest(df, "body", "endpoint", places)
    got = df.select("i", nested.token_of(F.col("endpoint"))).orderBy("i").collect()
    assert [r[1] for r in got] == ["zzz", None, None, None, None, "elsewhere", "two", "escaped"]
    lost = nested.unsearched(rows(spark, bodies), "body").collect()
    assert [(r.i, r.body_error) for r in lost] == [(4, "Failed to parse response JSON")]


def test_offers_and_what_is_pending(spark):
    thread = {"commentThreadRenderer": {"replies": {"commentRepliesRenderer": {"contents": [
        {"continuationItemRenderer": token("r1")}]}}}}
    button = {"continuationItemRenderer": {"button": {"buttonRenderer": {
        "command": token("more")["continuationEndpoint"]}}}}
    body = {"onResponseReceivedEndpoints": [
        {"appendContinuationItemsAction": {"targetId": "comment-replies-item-7",
                                           "continuationItems": [{"x": token("no")}, button]}},
        {"reloadContinuationItemsCommand": {"targetId": "comments-section", "continuationItems": [
            thread, {"odd": [token("o1"), token("o2")]},
            {"continuationItemRenderer": token("next")}]}},
        {"reloadContinuationItemsCommand": {"targetId": "header", "continuationItems": [
            {"continuationItemRenderer": token("ignored")}]}},
    ]}
    moved = {"deep": body["onResponseReceivedEndpoints"][1]}
    df = nested.continuations(rows(spark, [body, moved, {}]))
    got = [(r.i, r.kind, r.token) for r in
           df.orderBy("i", "action_pos", "item_pos", "pos").collect()]
    section = [("section", "r1"), ("section", "o2"), ("section", "o1"), ("section", "next")]
    assert got == [(0, *o) for o in section] + [(0, "replies", "more")] + [(1, *o) for o in section]

    asked = spark.createDataFrame([("r1",), ("next",), (None,)], "request_token string")
    left = {(r.i, r.token) for r in nested.pending(df, asked).collect()}
    assert left == {(0, "o1"), (0, "o2"), (0, "more"), (1, "o1"), (1, "o2")}


def test_embedded_json(spark):
    pages = [
        'a ytcfg.set({"A": {"b": 1}}); b',
        'ytcfg . set({"A": 1})',
        'ytcfg.set({"A": "}"})',
        'ytcfg.set({"A": "}); x"}); y',
        'ytcfg.set({"A": ',
        "ytcfg.set({A});",
        None,
        'ytcfg.set(\n{"A":\n"é😀"}\n) ;',
    ]
    df = rows(spark, pages)
    got = {r.i: (r.config, r.config_error) for r in extract_config(df, "body").collect()}
    none = "Failed to extract ytcfg"
    bad = "Failed to parse ytcfg JSON"
    assert got == {
        0: ('{"A": {"b": 1}}', None), 1: (None, none), 2: ('{"A": "}"}', None), 3: (None, bad),
        4: (None, none), 5: (None, bad), 6: (None, none), 7: ('{"A":\n"é😀"}', None),
    }
    robust = {r.i: r.config for r in extract_config(df, "body", robust=True).collect()}
    assert robust[3] == '{"A": "}); x"}' and robust[0] == '{"A": {"b": 1}}'

    data = rows(spark, [
        'var ytInitialData = {"x": 1};</script>', "window['ytInitialData']={\"x\": 2} ;\n",
        'ytInitialData = {"x": 3}; var  meta', 'ytInitialData = {"x": "};"} // no end', "{}"])
    got = [(r.data, r.data_error)
           for r in extract_data(data, "body").orderBy("i").collect()]
    assert got == [('{"x": 1}', None), ('{"x": 2}', None), ('{"x": 3}', None),
                   ('{"x": "};"}', None), (None, "Failed to extract ytInitialData")]


def test_search_of_deep_bodies():
    from vidlake.functions.jsonscan import values_of

    node = {"k": 1}
    for _ in range(20_000):
        node = {"a": [node], "b": 0}
    assert list(values_of({"k": 0, "z": node}, "k")) == [0, 1]
