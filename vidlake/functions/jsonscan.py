"""Two small Arrow-batched helpers for what Spark's JSON functions cannot say.

Both take a NULL where the native path already gave the answer and skip it, because Spark
evaluates Python functions for every row, whatever `when` surrounds them.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The helpers travel with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of bodies whose results a worker holds before it hands them on.
SLICE_BYTES = 1 << 20

_MARKS = re.compile(r'\\.|["{}]', re.DOTALL)

#: Field of a parsed body that is set if Spark's parser did not read all of it as declared.
CORRUPT = "_corrupt"
BODY_ERROR = "Failed to parse response JSON"


def _single(udf):
    """The function, marked so that Spark computes it once where it stands.

    Filters on a deterministic function's result are pushed below it by computing it again.
    """
    return udf.asNondeterministic()


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch in slices of about `SLICE_BYTES`, at least one body each."""
    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and held + n > SLICE_BYTES:
            yield texts.slice(start, i - start)
            start, held = i, 0
        held += n
    yield texts.slice(start)


def sliced(batches: Iterator[pa.Array],
           work: Callable[[Iterator[str | None]], pa.Array]) -> Iterator[pa.Array]:
    """Results of `work` slice by slice, so that a worker's memory does not grow with a batch.

    A batch holds up to 10,000 bodies, or 64 MB, by Spark's own settings. As Python text, parsed
    and as results it would take many times that; each body is taken out of the batch as its
    turn comes instead.
    """
    for texts in batches:
        for part in _slices(texts):
            yield work(t.as_py() for t in part)


def balanced_object(text: str, opening: re.Pattern) -> str | None:
    """The JSON object whose brace ends the first match of `opening`; None if it never closes."""
    found = opening.search(text)
    if not found:
        return None
    start, depth, quoted = found.end() - 1, 0, False
    for mark in _MARKS.finditer(text, start):
        symbol = mark.group()
        if symbol == '"':
            quoted = not quoted
        elif quoted or symbol[0] == "\\":
            continue
        elif symbol == "{":
            depth += 1
        else:
            depth -= 1
            if depth == 0:
                return text[start:mark.end()]
    return None


def balanced_object_column(text: Column, opening: str) -> Column:
    pattern = re.compile(opening)

    @F.arrow_udf("string")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return sliced(batches, lambda texts: pa.array(
            [None if t is None else balanced_object(t, pattern) for t in texts], pa.string()))

    return _single(scan)(text)


def values_of(node, key: str):
    """Values stored under `key` at any depth, last branch first; found values are not entered."""
    waiting = [node]  # as deep as the body is; the last one is entered next
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            if key in node:
                yield node[key]
            waiting.extend(value for name, value in node.items() if name != key)
        elif isinstance(node, list):
            waiting.extend(node)


def _search(body: str | None, keys: list[str]) -> list[list[str] | str | None]:
    """The values of each key and, last, why the body cannot be searched."""
    if body is None:
        return [None] * (len(keys) + 1)
    try:
        node = json.loads(body)
        return [*[[json.dumps(v, ensure_ascii=False) for v in values_of(node, key)]
                  for key in keys], None]
    except (ValueError, RecursionError):
        return [*[[] for _ in keys], BODY_ERROR]


def parsed_body(body: Column, schema: str) -> Column:
    """A body parsed against a declared `struct<...>`. Its field `CORRUPT` is set if the body is
    no JSON, nested too deep for Spark's parser, or holds other types than declared."""
    return F.from_json(body, f"{schema[:-1]},{CORRUPT}:string>",
                       {"columnNameOfCorruptRecord": CORRUPT})


def suspect(doc: Column, body: Column) -> Column:
    """Whether `parsed_body` may have missed something, so that the body has to be searched."""
    return body.isNotNull() & (doc.isNull() | doc[CORRUPT].isNotNull())


def mentions(body: Column, keys: list[str]) -> Column:
    """Whether one of the names may occur in a body."""
    # A name may be spelled with escapes; bodies with escaped Latin letters are searched too.
    hit = body.rlike(r"\\u00[4-7]")
    for key in reversed(keys):
        hit = F.contains(body, F.lit(f'"{key}"')) | hit
    return hit


def find_many(body: Column, keys: list[str], anyway: Column | None = None) -> Column:
    """A struct with one field per key: JSON texts of all its values, in search order.

    Each body is parsed once, and only if one of the names occurs in it or if `anyway` says so.
    What cannot be parsed has no values and an error, see `body_error`.
    """
    names = [*keys, "_error"]
    kinds = [pa.list_(pa.string())] * len(keys) + [pa.string()]
    fields = ", ".join([*[f"{key} array<string>" for key in keys], "_error string"])

    def work(bodies: Iterator[str | None]) -> pa.Array:
        rows = [_search(b, keys) for b in bodies]
        columns = zip(*rows) if rows else [[] for _ in names]
        return pa.StructArray.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    @F.arrow_udf(fields)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return sliced(batches, work)

    wanted = mentions(body, keys)
    return _single(search)(F.when(wanted if anyway is None else anyway | wanted, body))


def _search_items(body: str | None, keys: list[str], listed: str, inner: list[str]):
    """What the values under `keys` hold besides their list, and the items in it."""
    if body is None:
        return None
    try:
        node = json.loads(body)
        found_values = [v if isinstance(v, dict) else {} for k in keys for v in values_of(node, k)]
        items = [v.get(listed) if isinstance(v.get(listed), list) else [] for v in found_values]
        return [{
            "head": json.dumps({k: x for k, x in v.items() if k != listed}, ensure_ascii=False),
            "items": [{"names": list(i) if isinstance(i, dict) else []} | {
                k: [json.dumps(x, ensure_ascii=False) for x in values_of(i, k)] for k in inner}
                for i in inside],
        } for v, inside in zip(found_values, items)]
    except (ValueError, RecursionError):
        return None


def find_items(body: Column, keys: list[str], listed: str, inner: list[str]) -> Column:
    """The values of `keys` in search order and the items they list under `listed`, in one search.

    An array of `head` (the value without its list, as JSON) and `items`, each with its own
    `names` and, under each of `inner`, the JSON texts of that name's values in search order.
    NULL where a body names none of the keys or cannot be parsed.
    """
    fields = ["names", *inner]
    kind = pa.list_(pa.struct([("head", pa.string()), ("items", pa.list_(pa.struct(
        [(name, pa.list_(pa.string())) for name in fields])))]))
    inside = ",".join(f"{name}:array<string>" for name in fields)

    def work(bodies: Iterator[str | None]) -> pa.Array:
        return pa.array([_search_items(b, keys, listed, inner) for b in bodies], kind)

    @F.arrow_udf(f"array<struct<head:string,items:array<struct<{inside}>>>>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return sliced(batches, work)

    return _single(search)(F.when(mentions(body, keys), body))


def body_error(matches: Column) -> Column:
    """Why a body that `find_many` looked at cannot be read; NULL if it can."""
    return matches["_error"]


def count_name(body: Column, key: str) -> Column:
    """How often `key` stands as a name; quotes inside JSON strings are escaped and don't count.

    Tells whether a native parse of the declared places has seen every value of that name.
    """
    return F.regexp_count(body, F.lit(f'"{key}"\\s*:'))


def found(matches: Column, key: str) -> Column:
    """One field of `find_many`, empty where the body was not searched."""
    return F.coalesce(matches[key], F.array().cast("array<string>"))


def find_values(body: Column, key: str) -> Column:
    """JSON texts of all values under `key`, in search order."""
    return found(find_many(body, [key]), key)


def first_value(body: Column, key: str) -> Column:
    """JSON text of the value found first, NULL if there is none."""
    return F.get(find_values(body, key), F.lit(0))


def json_scalar(value: Column) -> Column:
    """A JSON string or number as text."""
    return F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(0))
