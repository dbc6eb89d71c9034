"""Counts and durations written for people, as numbers.

All arithmetic is on doubles and cut off towards zero, so `32.3K` is 32299: that is what the
binary value of 32.3 times 1000 gives, and results must agree with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vidlake.functions.refs import strip

# Magnitude letters.
MAGNITUDES = {"K": 1e3, "M": 1e6, "B": 1e9}
# What a view count looks like, and blanks and separators dropped before it.
VIEW_COUNT = r"(?i)([\d.]+)\s*([KMB]?)"
VIEW_SEPARATORS = " ,\u202f\u00a0"

_BLANK = r"[\s\x1c-\x1f]"
BLANK_AROUND_PART = rf"(?U){_BLANK}+(?=:|\z)|(?<![^:]){_BLANK}+"
# What a number may carry besides its digits: the letter at its end, commas, underscores.
NUMBER_TRIM = rf"(?U){_BLANK}*[kmb]\z|,|(?<=\d)_(?=\d)"
FLOAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*\z"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed a single time per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _magnitude(letter: Column) -> Column:
    cases = F
    for symbol, factor in MAGNITUDES.items():
        cases = cases.when(letter == symbol, F.lit(factor))
    return cases.otherwise(F.lit(1.0))


def parse_view_count(raw: Column) -> Column:
    """`123,874 views` -> 123874, `1.2M views` -> 1200000; NULL where there is no number."""
    s = F.translate(raw, VIEW_SEPARATORS, "")
    # Digits and dots only, so the cast fails just where they form no number, as in 1.2.3.
    number = F.regexp_extract(s, VIEW_COUNT, 1).try_cast("double")
    factor = _magnitude(F.upper(F.regexp_extract(s, VIEW_COUNT, 2)))
    return (number * factor).try_cast("bigint")


def _count_of(text: Column) -> Column:
    """Number in a text that is lower-case, stripped and free of the word "comments"."""
    body = F.regexp_replace(text, NUMBER_TRIM, "")
    whole = F.when(body.rlike(FLOAT), body).try_cast("double")
    runs = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))
    first, second = F.get(runs, F.lit(0)), F.get(runs, F.lit(1))
    decimals = F.when(
        F.contains(text, F.lit(".")),
        second.try_cast("double") / F.pow(F.lit(10.0), F.length(second)),
    )
    fallback = first.try_cast("double") + F.coalesce(decimals, F.lit(0.0))
    factor = _magnitude(F.upper(F.right(text, F.lit(1))))
    return (F.coalesce(whole, fallback) * factor).try_cast("bigint")


def parse_comment_count(raw: Column) -> Column:
    """`28,999 Comments` -> 28999, `28.9K` -> 28900; the magnitude letter must stand last.

    Text that is no number as a whole falls back to its first run of digits, with the second
    run as decimals if there is a dot anywhere.
    """
    words = F.replace(F.replace(F.lower(raw), F.lit("comments"), F.lit("")),
                      F.lit("comment"), F.lit(""))
    return once(strip(words), _count_of)


def length_to_minutes(length: Column) -> Column:
    """`21:47` or `1:05:30` as minutes; NULL for anything else."""

    def minutes(parts: Column) -> Column:
        def part(i: int) -> Column:
            return F.get(parts, F.lit(i)).try_cast("bigint")

        # A part that is no integer makes the sum NULL.
        return (
            F.when(F.size(parts) == 2, part(0) + part(1) / F.lit(60.0))
            .when(F.size(parts) == 3, part(0) * 60 + part(1) + part(2) / F.lit(60.0))
        )

    return once(F.split(F.regexp_replace(length, BLANK_AROUND_PART, ""), ":"), minutes)
