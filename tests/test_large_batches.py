"""Batches of many large bodies: what a worker holds, and that nothing is lost or moved."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F

from vidlake.functions import jsonscan


def _bodies(n: int, size: int) -> list[str | None]:
    return [None if i % 5 == 4 else json.dumps({"name": f"{i}-" + "x" * size}) for i in range(n)]


def test_a_worker_holds_a_slice_not_a_batch():
    bodies = _bodies(400, 50_000)
    held = []

    def work(texts):
        held.append(list(texts))
        return pa.array([t and len(t) for t in held[-1]], pa.int64())

    results = jsonscan.sliced(iter([pa.array(bodies), pa.array([], pa.string())]), work)
    assert [n for r in results for n in r.to_pylist()] == [b and len(b) for b in bodies]
    assert max(sum(len(t or "") for t in part) for part in held) <= jsonscan.SLICE_BYTES
    assert len(held) > 10


def test_a_body_larger_than_a_slice_is_worked_on_alone():
    bodies = ["a", "b" * (2 * jsonscan.SLICE_BYTES), None, "c"]
    parts = []
    list(jsonscan.sliced(iter([pa.array(bodies)]), lambda texts: parts.append(list(texts))))
    assert [t for part in parts for t in part] == bodies
    assert ["b" * (2 * jsonscan.SLICE_BYTES)] in parts


def test_sliced_batches_keep_every_row_in_place(spark):
    rows = spark.range(0, 300, 1, 2).withColumn("body", F.when(F.col("id") % 5 != 4, F.to_json(
        F.struct(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 30_000))
                 .alias("name")))))
    found = rows.select(
        "id", jsonscan.first_value(F.col("body"), "name").alias("name"),
        jsonscan.balanced_object_column(F.col("body"), r"\{").alias("object"))
    shown = found.select("id", F.regexp_extract("name", r"\d+", 0).alias("name"),
                         F.regexp_extract("object", r"\d+", 0).alias("object")).collect()
    assert len(shown) == 300
    for r in shown:
        assert r.name == r.object == (None if r.id % 5 == 4 else str(r.id))
