"""Tool calls with identifiers that are missing or used again."""

from __future__ import annotations

from vidlake.llm import chat, queries

CALL = "conv_id long, turn long, call_id string, name string, arguments string"
RESULT = "conv_id long, turn long, call_id string, content string"
GOOD = '{"turn":%d,"text":"x"}'


def linked(spark, calls, results):
    rows = chat.linked(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT),
                       queries.TOOLS).collect()
    return sorted((r.conv_id is None, r.conv_id or 0, r.call_id or "", r.turn, r.depth, r.status)
                  for r in rows if r.depth is not None) + sorted(
        (r.conv_id is None, r.conv_id or 0, r.call_id or "", r.turn, r.status)
        for r in rows if r.depth is None), rows


def test_identifier_used_in_every_turn(spark):
    calls = [(1, 2 * k, "call_0", "search", GOOD % k) for k in range(30)]
    results = [(1, 2 * k + 1, "call_0", f"r{k}") for k in range(30)]
    got, rows = linked(spark, [*calls, calls[3]], [*results, results[4]])  # equal rows count once
    assert got == [(False, 1, "call_0", 2 * k, 0, "done") for k in range(30)]
    assert all(f'"result":"r{r.turn // 2}"' in r.json for r in rows)


def test_surplus_calls_and_results(spark):
    calls = [(1, 1, "a", "search", GOOD % 1), (1, 3, "a", "search", GOOD % 3),
             (2, 1, "b", "search", GOOD % 1), (3, 1, "c", "search", "no json"),
             (3, 2, "c", "search", "no json either")]
    results = [(1, 4, "a", "one"), (2, 2, "b", "one"), (2, 3, "b", "two"),
               (4, 1, "z", "lost"), (4, 2, "z", "lost again")]
    got, _ = linked(spark, calls, results)
    assert got == [
        (False, 1, "a", 1, 0, "done"), (False, 1, "a", 3, 0, "duplicate"),
        (False, 2, "b", 1, 0, "done"), (False, 3, "c", 1, 0, "invalid"),
        (False, 3, "c", 2, 0, "invalid"),
        (False, 2, "b", 3, "duplicate"), (False, 4, "z", 1, "orphan"),
        (False, 4, "z", 2, "duplicate")]


def test_null_identifiers_stay_apart(spark):
    calls = [(1, k, None, "search", GOOD % k) for k in range(5)] + [
        (None, k, "a", "search", GOOD % k) for k in range(5)] + [(1, 0, None, "search", GOOD % 0)]
    results = [(1, k, None, f"r{k}") for k in range(4)] + [(1, 9, None, "same")] * 2
    got, _ = linked(spark, calls, results)
    assert got == [
        *((False, 1, "", k, 0, "open") for k in range(5)),
        *((True, 0, "a", k, 0, "open") for k in range(5)),
        *((False, 1, "", k, "orphan") for k in (0, 1, 2, 3, 9))]


def test_needs_name_the_latest_earlier_call(spark):
    after = '{"text":"y","after":"$%s"}'
    calls = [(1, 1, "a", "search", GOOD % 1), (1, 2, "a", "lookup", after % "a"),
             (1, 3, "b", "lookup", after % "a"), (1, 4, "a", "lookup", after % "b"),
             (1, 5, "s", "lookup", after % "s"), (1, 6, None, "lookup", after % "b"),
             (1, 7, None, "lookup", after % "none")]
    results = [(1, 10 + k, i, "ok") for k, i in enumerate("aabas")]
    got, rows = linked(spark, calls, results)
    assert got == [
        (False, 1, "", 6, 3, "open"), (False, 1, "", 7, 0, "invalid"),
        (False, 1, "a", 1, 0, "done"), (False, 1, "a", 2, 1, "done"),
        (False, 1, "a", 4, 3, "done"), (False, 1, "b", 3, 2, "done"),
        (False, 1, "s", 5, "circular")]
    assert [r.problems for r in rows if r.turn == 7] == [["no call none"]]
