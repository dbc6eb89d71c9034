"""Numbers, sizes and times as text for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30


def format_number(n: Column) -> Column:
    """Thousands separators."""
    return F.format_number(n, 0)


def _nearest(value: Column, digits: int) -> Column:
    """`value * 10**digits` as the nearest integer, ties to even, for a double >= 0.

    Spark's own rounding works on the shortest decimal text of a double; here the binary value
    itself decides. Splitting it into a float and the rest makes both products exact, so the
    sign of the distance to the midpoint is exact too.
    """
    scale = F.lit(float(10**digits))
    high = value.cast("float").cast("double")
    low = value - high
    floor = F.floor(value * scale)
    gap = (high * scale - (floor.cast("double") + 0.5)) + low * scale
    up = (gap > 0) | ((gap == 0) & (F.pmod(floor, F.lit(2)) == 1))
    return floor + up.cast("bigint")


def round_exact(value: Column, digits: int) -> Column:
    """Round a double >= 0 by its binary value: 2.675 -> 2.67, 0.25 to one digit -> 0.2."""
    return _nearest(value, digits).cast("double") / float(10**digits)


def _fixed(scaled: Column, digits: int) -> Column:
    """An integer holding `digits` decimals, as text."""
    scale = F.lit(10**digits)
    rest = F.pmod(scaled, scale)
    whole = ((scaled - rest) / scale).cast("bigint")
    return F.concat(
        whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), digits, "0"))


def percent_text(value: Column) -> Column:
    """A percentage with one decimal."""
    return F.concat(_fixed(_nearest(value, 1), 1), F.lit("%"))


def _in_units(size: Column, bits: int, digits: int, suffix: str) -> Column:
    """`size / 2**bits` with `digits` decimals, ties to even, for a size of at least one unit.

    The sum carries into the quotient exactly where rounding goes up: by half a unit less one,
    and by one more if the quotient is odd.
    """
    scaled = size.cast("bigint") * 10**digits
    odd = F.shiftright(scaled, bits).bitwiseAND(F.lit(1))
    text = F.shiftright(scaled + ((1 << (bits - 1)) - 1) + odd, bits).cast("string")
    return F.concat(
        F.substring(text, F.lit(1), F.length(text) - digits), F.lit("."),
        F.right(text, F.lit(digits)), F.lit(suffix))


def format_bytes(size: Column) -> Column:
    """`512B`, `1.2KB`, `8.7MB`, `1.34GB`."""
    return (
        F.when(size < KB, F.concat(size.cast("string"), F.lit("B")))
        .when(size < MB, _in_units(size, 10, 1, "KB"))
        .when(size < GB, _in_units(size, 20, 1, "MB"))
        .when(size >= GB, _in_units(size, 30, 2, "GB"))
    )


def _quotient(n: Column, unit: int) -> Column:
    return F.floor(n / F.lit(unit))


def _unit(n: Column, letter: str) -> Column:
    return F.concat(n.cast("bigint").cast("string"), F.lit(letter))


def format_time(seconds: Column) -> Column:
    """Elapsed time, always with both units: `42s`, `5m 0s`, `2h 0m`."""
    s = seconds.cast("bigint")
    return (
        F.when(seconds < 60, _unit(s, "s"))
        .when(seconds < 3600, F.concat_ws(" ", _unit(_quotient(s, 60), "m"), _unit(s % 60, "s")))
        .when(seconds >= 3600, F.concat_ws(
            " ", _unit(_quotient(s, 3600), "h"), _unit(_quotient(s % 3600, 60), "m")))
    )


def format_duration(seconds: Column) -> Column:
    """Duration without a zero second unit: `42s`, `5m`, `5m 3s`, `2h`, `2h 10m`."""
    s = seconds.cast("bigint")
    secs, minutes = s % 60, _quotient(s % 3600, 60)
    # concat_ws leaves out the second unit where it is NULL.
    return (
        F.when(seconds < 60, _unit(s, "s"))
        .when(seconds < 3600, F.concat_ws(
            " ", _unit(_quotient(s, 60), "m"), F.when(secs > 0, _unit(secs, "s"))))
        .when(seconds >= 3600, F.concat_ws(
            " ", _unit(_quotient(s, 3600), "h"), F.when(minutes > 0, _unit(minutes, "m"))))
    )


def batch_folder(started: Column) -> Column:
    """Name of a batch's folder: its start in UTC, to the second."""
    return F.date_format(
        F.to_utc_timestamp(started, F.current_timezone()), "yyyy-MM-dd_HH-mm-ss")


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text in UTC; the fraction is left out when it is zero."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    base = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(utc, "SSSSSS")
    return F.concat(
        base,
        F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.lit("+00:00"),
    )
