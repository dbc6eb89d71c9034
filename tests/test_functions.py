from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vidlake import functions as fn

VIEWS = [
    ("123,874 views", 123874), ("1.2M views", 1200000), ("500K views", 500000),
    ("1.1b", 1100000000), ("32.3K", 32299), ("5 bananas", 5000000000), ("No views", None),
    ("1.2.3", None), (".", None), ("", None), (None, None), ("approx. 5", 0),
    ("12 345 views", 12345), ("12\xa0345 views", 12345), ("7 K views", 7000),
    ("99999999999999999999B", None),
]
COUNTS = [
    ("28,999", 28999), ("28.9K", 28900), ("28,999 Comments", 28999), ("1 comment", 1),
    ("28.999", 28), ("12.5 k x", 12), ("about 12.5 k", 12500), ("1.2M", 1200000), ("3b", 3 * 10**9),
    ("k", None), ("Comments", None), ("", None), (None, None), ("\xa012\t", 12), ("1e3", 1000),
    ("-5", -5), ("+5k", 5000), ("1_000", 1000), ("5 k", 5000), ("2,5 of 3", 2),
]
LENGTHS = [
    ("21:47", 21 + 47 / 60), ("1:05:30", 65.5), ("10:25", 10 + 25 / 60), ("0:00", 0.0),
    (" 1:05 ", 1 + 5 / 60), ("1: 05", 1 + 5 / 60), ("\xa01:05 ", 1 + 5 / 60),
    ("+1:05", 1 + 5 / 60), ("1:", None), (":5", None),
    ("x:1", None), ("5.0:1", None), ("1e1:1", None), ("1:2:3:4", None), ("12", None), ("", None),
    (None, None), ("LIVE", None),
]
REFS = [
    ("@skryp", "@skryp"), ("  @a b\t", "@a b"), ("https://www.youtube.com/@realmadrid", "@realmadrid"),
    ("youtube.com/@x-y_z/videos?v=1", "@x-y_z"),
    ("https://www.youtube.com/channel/UC1234567890", "UC1234567890"),
    ("/channel/UC9-_", "UC9-_"), ("channel/UC8/about", "UC8"), ("UC1234567890", "UC1234567890"),
    ("UC12 3", None), ("a/channel/UC8", None), ("plain", None), ("", None), (None, None),
]


@pytest.mark.parametrize("table, function, kind", [
    (VIEWS, fn.parse_view_count, "string"), (COUNTS, fn.parse_comment_count, "string"),
    (LENGTHS, fn.length_to_minutes, "string"), (REFS, fn.channel_ref, "string"),
])
def test_table(column, table, function, kind):
    assert column([v for v, _ in table], kind, function) == [want for _, want in table]


@pytest.mark.parametrize("name, table", [
    ("view_count", VIEWS), ("comment_count", COUNTS), ("length_to_minutes", LENGTHS),
    ("channel_ref", REFS),
])
def test_sql_form(spark, column, name, table):
    assert name in fn.register(spark)
    got = column([v for v, _ in table], "string", lambda c: F.call_function(name, c))
    assert got == [want for _, want in table]


def test_names_and_paths(column):
    names = ["@testchannel", "a/b\\c@d", "plain", None]
    assert column(names, "string", fn.safe_name) == ["testchannel", "a_b_cd", "plain", None]
    assert column(["@testchannel"], "string", fn.channel_videos_path) == [
        "data/testchannel/videos.json"]
    assert column(["@testchannel"], "string", lambda c: fn.channel_videos_path(c, "output")) == [
        "output/testchannel/videos.json"]
    assert column(["dQw4w9WgXcQ"], "string", fn.video_comments_path) == [
        "data/dQw4w9WgXcQ/comments.jsonl"]

    def name(fmt):
        return lambda c: fn.comments_file_name(c, F.lit("abc"), fmt)

    numbers = [1, 42, 999, 9999, 12345, None]
    assert column(numbers, "int", name("jsonl")) == [
        "0001_abc.jsonl", "0042_abc.jsonl", "0999_abc.jsonl", "9999_abc.jsonl",
        "12345_abc.jsonl", None]
    assert column([1], "int", name("csv")) == ["0001_abc.csv"]
    assert column([1], "int", name("parquet")) == ["0001_abc.parquet"]
    assert column([1], "int", name("json")) == ["0001_abc.jsonl"]


def human_bytes(n: int) -> str:
    for limit, unit, digits, suffix in ((2**20, 2**10, 1, "KB"), (2**30, 2**20, 1, "MB"),
                                        (math.inf, 2**30, 2, "GB")):
        if n < 1024:
            return f"{n}B"
        if n < limit:
            return f"{n / unit:.{digits}f}{suffix}"
    raise AssertionError


@settings(max_examples=5, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2**45) | st.integers(0, 2**21) | st.sampled_from(
    [0, 1023, 1024, 1280, 1311, 2**20 - 1, 2**20, 5 * 2**18, 2**30 - 1, 2**30, 2**30 + 2**29]),
    min_size=200, max_size=200))
def test_bytes(column, sizes):
    assert column(sizes, "bigint", fn.format_bytes) == [human_bytes(n) for n in sizes]


@settings(max_examples=5, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1e7) | st.integers(0, 10**6).map(lambda n: n / 200), min_size=200,
                max_size=200))
def test_rounding_follows_the_binary_value(column, values):
    values += [2.675, 0.25, 1.005, 99.95, 6.25, 33.35, 0.05, 100.0]
    assert column(values, "double", lambda c: fn.round_exact(c, 2)) == [
        round(v, 2) for v in values]
    assert column(values, "double", lambda c: fn.round_exact(c, 1)) == [
        round(v, 1) for v in values]
    assert column(values, "double", fn.percent_text) == [f"{v:.1f}%" for v in values]


def test_times(column):
    seconds = [0.0, 0.9, 59.9, 60.0, 61.5, 300.0, 3599.9, 3600.0, 7199.0, 7260.0, None]
    assert column(seconds, "double", fn.format_time) == [
        "0s", "0s", "59s", "1m 0s", "1m 1s", "5m 0s", "59m 59s", "1h 0m", "1h 59m", "2h 1m", None]
    assert column(seconds, "double", fn.format_duration) == [
        "0s", "0s", "59s", "1m", "1m 1s", "5m", "59m 59s", "1h", "1h 59m", "2h 1m", None]
    assert column([942.0], "double", fn.format_duration) == ["15m 42s"]
    assert column([1240331, -5], "bigint", fn.format_number) == ["1,240,331", "-5"]


def test_iso_does_not_depend_on_the_session_zone(spark, column):
    micros = [1736080496000000, 1736080496123456]
    want = ["2025-01-05T12:34:56+00:00", "2025-01-05T12:34:56.123456+00:00"]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert column(micros, "bigint", lambda c: fn.iso_utc(F.timestamp_micros(c))) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
