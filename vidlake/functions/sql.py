"""The column functions as SQL functions of the session.

They are SQL functions with an expression for a body, so the optimizer inlines them and no
Python runs. `register` returns their names.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from vidlake.functions import numbers, refs

_STRIP = r"regexp_replace({}, r'(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z', '')"


def _once(value: str, name: str, use: str) -> str:
    """`use` with `name` standing for `value`, computed a single time."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def _magnitude(letter: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v:.0f}D" for k, v in numbers.MAGNITUDES.items())
    return f"(CASE upper({letter}) {whens} ELSE 1D END)"


def _in_units(bits: int, digits: int, suffix: str) -> str:
    """`size / 2**bits`, ties to even; see the column form."""
    scaled = f"size * {10**digits}"
    text = (f"CAST(shiftright({scaled} + {(1 << (bits - 1)) - 1} "
            f"+ (shiftright({scaled}, {bits}) & 1), {bits}) AS STRING)")
    return (f"concat(substring({text}, 1, length({text}) - {digits}), '.', "
            f"right({text}, {digits}), '{suffix}')")


def _view_count() -> str:
    s = f"translate(raw, '{numbers.VIEW_SEPARATORS}', '')"
    digits = f"regexp_extract({s}, r'{numbers.VIEW_COUNT}', 1)"
    letter = f"regexp_extract({s}, r'{numbers.VIEW_COUNT}', 2)"
    return f"try_cast(try_cast({digits} AS DOUBLE) * {_magnitude(letter)} AS BIGINT)"


def _comment_count() -> str:
    text = _STRIP.format("replace(replace(lower(raw), 'comments', ''), 'comment', '')")
    body = f"regexp_replace(t, r'{numbers.NUMBER_TRIM}', '')"
    runs = r"regexp_extract_all(t, r'\d+', 0)"
    return _once(text, "t", rf"""
        try_cast(coalesce(
          try_cast(CASE WHEN {body} RLIKE r'{numbers.FLOAT}' THEN {body} END AS DOUBLE),
          try_cast(get({runs}, 0) AS DOUBLE) + coalesce(
            CASE WHEN contains(t, '.') THEN
              try_cast(get({runs}, 1) AS DOUBLE) / pow(10D, length(get({runs}, 1))) END, 0D)
        ) * {_magnitude('right(t, 1)')} AS BIGINT)""")


def _length() -> str:
    def part(i: int) -> str:
        return f"try_cast(get(p, {i}) AS BIGINT)"

    return _once(
        f"split(regexp_replace(length, r'{numbers.BLANK_AROUND_PART}', ''), ':')", "p",
        f"CASE WHEN size(p) = 2 THEN {part(0)} + {part(1)} / 60D "
        f"WHEN size(p) = 3 THEN {part(0)} * 60 + {part(1)} + {part(2)} / 60D END")


def _channel_ref() -> str:
    t = _STRIP.format("text")
    return f"""
        coalesce(
          CASE WHEN startswith({t}, '@') THEN {t} END,
          concat('@', nullif(regexp_extract({t}, r'{refs.HANDLE_URL}', 1), '')),
          nullif(regexp_extract({t}, r'{refs.CHANNEL_URL}', 1), ''),
          nullif(regexp_extract({t}, r'{refs.CHANNEL_PATH}', 1), ''),
          CASE WHEN {t} RLIKE r'{refs.CHANNEL_ID}' THEN {t} END)"""


def _definitions() -> dict[str, tuple[str, str, str]]:
    s = "CAST(seconds AS BIGINT)"
    return {
        "channel_ref": ("text STRING", "STRING", _channel_ref()),
        "safe_name": ("name STRING", "STRING", r"translate(name, r'/\@', '__')"),
        "view_count": ("raw STRING", "BIGINT", _view_count()),
        "comment_count": ("raw STRING", "BIGINT", _comment_count()),
        "length_to_minutes": ("length STRING", "DOUBLE", _length()),
        "comments_file_name": (
            "ord INT, id STRING, fmt STRING", "STRING",
            "format_string('%04d_%s.%s', ord, id, "
            "CASE WHEN fmt IN ('csv', 'parquet') THEN fmt ELSE 'jsonl' END)",
        ),
        "human_number": ("n BIGINT", "STRING", "format_number(n, 0)"),
        "human_bytes": (
            "size BIGINT", "STRING",
            f"CASE WHEN size < {1 << 10} THEN concat(size, 'B') "
            f"WHEN size < {1 << 20} THEN {_in_units(10, 1, 'KB')} "
            f"WHEN size < {1 << 30} THEN {_in_units(20, 1, 'MB')} "
            f"WHEN size >= {1 << 30} THEN {_in_units(30, 2, 'GB')} END",
        ),
        "human_time": (
            "seconds DOUBLE", "STRING",
            f"CASE WHEN seconds < 60 THEN format_string('%ds', {s}) "
            f"WHEN seconds < 3600 THEN format_string('%dm %ds', {s} DIV 60, {s} % 60) "
            f"WHEN seconds >= 3600 THEN "
            f"format_string('%dh %dm', {s} DIV 3600, {s} % 3600 DIV 60) END",
        ),
        "human_duration": (
            "seconds DOUBLE", "STRING",
            f"CASE WHEN seconds < 60 THEN format_string('%ds', {s}) "
            f"WHEN seconds < 3600 AND {s} % 60 > 0 THEN "
            f"format_string('%dm %ds', {s} DIV 60, {s} % 60) "
            f"WHEN seconds < 3600 THEN format_string('%dm', {s} DIV 60) "
            f"WHEN seconds >= 3600 AND {s} % 3600 DIV 60 > 0 THEN "
            f"format_string('%dh %dm', {s} DIV 3600, {s} % 3600 DIV 60) "
            f"WHEN seconds >= 3600 THEN format_string('%dh', {s} DIV 3600) END",
        ),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session, for use in `spark.sql`."""
    definitions = _definitions()
    for name, (parameters, returns, body) in definitions.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) "
            f"RETURNS {returns} RETURN {body}"
        )
    return list(definitions)
