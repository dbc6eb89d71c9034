"""Column expressions shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a missing document id: such a row counts as the last document.
NO_ID = 2**63 - 1

#: Bytes x20 and x09 to x0D, the white space of all word and line rules here.
BLANKS = " \t\n\x0b\x0c\r"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character unchanged."""
    # lower() has a fast way for ASCII; it would change other letters too.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def known_id(name: str = "doc_id") -> Column:
    """The id as a long; null counts as the largest one."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def text_hash(text: Column) -> Column:
    """With the id this names a document; rows equal in both are treated alike."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without columns of these names, in any letter case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def schema_with(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of `df` and more fields; `df`'s own one, which it keeps, is left alone."""
    schema = T.StructType(list(df.schema.fields))
    for name, kind in kinds.items():
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return schema
