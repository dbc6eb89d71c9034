"""Values under names at declared places of a body that is parsed once, as a variant.

A name may stand anywhere; the declared places are where it is known to stand. Counting the name
in the text tells whether the places hold all there is: then the values they have, in the order
of a search, are what a search would find. Other bodies are searched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vidlake.functions.jsonscan import count_name

#: A step of a path that stands for every element of an array.
EACH = "*"


def parsed(body: Column) -> Column:
    """The body as a variant; NULL if it cannot be read, is nested too deep, or repeats a name."""
    return F.try_parse_json(body)


def _elements(step: str) -> Callable[[Column], Column]:
    return lambda node: F.coalesce(
        F.reverse(F.try_variant_get(node, f"$.{step}", "array<variant>")),
        F.array().cast("array<variant>"))


def values_at(node: Column, path: str) -> Column:
    """The values at a path like `a.*.b`, as variants, those of later array elements first."""
    *arrays, last = [p.strip(".") for p in path.split(EACH)]
    nodes = F.array(node)
    for step in arrays:
        nodes = F.flatten(F.transform(nodes, _elements(step)))
    if last:
        nodes = F.transform(nodes, lambda n: F.try_variant_get(n, f"$.{last}", "variant"))
    return F.filter(nodes, lambda n: n.isNotNull())


def _times(body: Column, key: str) -> Column:
    """How often a name stands in a text; the pattern runs only where the text has it at all."""
    return F.when(F.contains(body, F.lit(f'"{key}"')), count_name(body, key)).otherwise(0)


def at_places(node: Column, body: Column, key: str, places: list[str]) -> Column:
    """A struct: `values` (variants under `key` in the order of a search) and `missed`, whether
    there may be others, or values at two of the places, whose order is not known."""
    found = [values_at(node, f"{place}.{key}" if place else key) for place in places]
    sizes = reduce(lambda a, b: a + b, [F.size(f) for f in found])
    at_once = reduce(lambda a, b: a + b, [F.when(F.size(f) > 0, 1).otherwise(0) for f in found])
    return F.struct(F.concat(*found).alias("values"),
                    ((sizes != _times(body, key)) | (at_once > 1)).alias("missed"))


def readable(node: Column, body: Column) -> Column:
    """Whether names of a body can be counted: it is parsed, and no Latin letter is escaped."""
    return node.isNotNull() & ~body.rlike(r"\\u00[4-7]")


def texts(values: Column) -> Column:
    """JSON texts of variants."""
    return F.transform(values, lambda v: F.to_json(v))
