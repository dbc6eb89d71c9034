"""Values sent to every task, and taken back from the executors once they are used."""

from __future__ import annotations

from typing import Any

from pyspark import Broadcast
from pyspark.sql import SparkSession

_sent: list[Broadcast] = []


def send(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast that `take_back` knows of."""
    _sent.append(spark.sparkContext.broadcast(value))
    return _sent[-1]


def take_back() -> None:
    """Free all that was sent so far on the executors. The driver keeps its copy, so a plan that
    is run again gets it once more."""
    while _sent:
        _sent.pop().unpersist()
