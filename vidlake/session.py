"""Session settings and the shared folder that jobs stage tables in."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings the plans in this package are written for. All are ordinary Spark settings, and
#: the library also runs on a session that was built without them.
SETTINGS = {
    # The JVM does not compile methods beyond 8,000 bytes; Spark splits wide projections up
    # if it does not generate one method for a whole stage.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Column that numbers the rows of a staged table.
ROW_ID = "row_id"

_own_folders: dict[str, tempfile.TemporaryDirectory] = {}


def builder(app: str = "vidlake") -> SparkSession.Builder:
    """A session builder carrying `SETTINGS`; master, memory and shuffle width are the caller's."""
    b = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    return b


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    A cluster must name one that every node reaches. Only a local session, where driver and
    executors are one process, gets a folder of its own when none is named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.TemporaryDirectory(prefix="vidlake-")
    return _own_folders[app].name


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str, row_id: bool = False) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and return a scan of it.

    Used where a costly parse feeds several branches of a plan: the bodies are read once, the
    branches read only the columns they need, and a lost executor costs a re-read of the
    small table instead of another parse. With `row_id`, rows are numbered uniquely as they are
    written, so that every branch sees the same numbers.
    """
    path = new_path(df.sparkSession, name)
    if row_id:
        df = df.withColumn(ROW_ID, F.monotonically_increasing_id())
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` itself if it is a staged table with row ids, else staged as one."""
    return df if ROW_ID in df.columns else stage(df, name, row_id=True)
