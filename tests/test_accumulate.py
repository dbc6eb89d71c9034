from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vidlake.operators.accumulate import accumulate
from vidlake.sources import until_empty


def brute(rows):
    out, sums, totals = {}, {}, {}
    for key, at, n in sorted(rows):
        sums[key] = sums.get(key, 0) + n
        out[key, at] = sums[key]
        totals[key] = max(totals.get(key, n), n)
    return {k: (v, totals[k[0]]) for k, v in out.items()}


@pytest.mark.parametrize("positions", [range(20000), range(-9000, 9000, 7),
                                       [i * 10**7 for i in range(500)]])
def test_running_sums_with_a_hot_key(spark, positions):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(50)}", p, rng.randrange(-3, 9))
            for p in positions]
    df = spark.createDataFrame(rows, "key string, at long, n long").repartition(5)
    got = accumulate(df, ["key"], "at", {"upto": F.col("n")}, {"top": ("max", F.col("n"))})
    assert got.columns == ["key", "at", "n", "upto", "top"]
    assert {(r.key, r["at"]): (r.upto, r.top) for r in got.collect()} == brute(rows)


def test_rows_of_a_key_are_spread_by_bucket(spark):
    """No window over the rows themselves is partitioned by the key alone."""
    df = spark.range(10).select(F.col("id").cast("string").alias("key"), F.col("id").alias("at"))
    plan = accumulate(df, ["key"], "at", {"n": F.col("at")})._jdf.queryExecution().optimizedPlan()
    windows = [line.split("], [")[1] for line in plan.toString().splitlines()
               if "Window [" in line]
    # The only window over whole keys works on sums per bucket.
    assert ["_bucket" in w for w in windows] == [True, False]


def test_chain_ends_at_its_first_empty_body(spark):
    rows = [("a", 0, '{"x":1}'), ("a", 1, " { } "), ("a", 2, '{"x":1}'), ("b", 0, '{"x":1}'),
            ("b", 5, '{"x":1}'), ("c", 0, None), ("d", 3, "null"), ("e", 0, "[1]"), ("e", 1, "[]"),
            ("f", 0, '"x"'), ("f", 1, '""')]
    df = spark.createDataFrame(rows, "key string, response_seq int, body string")
    kept = {(r.key, r.response_seq) for r in until_empty(df, ["key"]).collect()}
    assert kept == {("a", 0), ("b", 0), ("b", 5), ("e", 0), ("f", 0)}


def test_a_later_capture_replaces_an_empty_one(spark):
    rows = [("a", 0, "{}", 1), ("a", 0, '{"x":2}', 2), ("a", 1, '{"x":1}', 2),
            ("b", 0, '{"x":1}', 1), ("b", 0, "{}", 2), ("b", 1, '{"x":1}', 1)]
    df = spark.createDataFrame(rows, "key string, response_seq int, body string, fetched_at int")
    kept = {(r.key, r.response_seq, r.body) for r in until_empty(df, ["key"]).collect()}
    assert kept == {("a", 0, '{"x":2}'), ("a", 1, '{"x":1}')}
