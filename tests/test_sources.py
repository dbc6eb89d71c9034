from __future__ import annotations

import json

import pytest

from vidlake import session, sources
from vidlake.schemas import PAGE_CAPTURES, RESPONSE_CAPTURES


def test_channel_list(spark, tmp_path):
    text = "# list\n@skryp\r\n\n  \t\nhttps://www.youtube.com/@realmadrid\nbad line\n@skryp\n #x\nUC12"
    (tmp_path / "channels.txt").write_bytes(text.encode())
    rows = sources.read_channel_list(spark, str(tmp_path)).orderBy("line_number").collect()
    assert [(r.line_number, r.channel, r.reject) for r in rows] == [
        (2, "@skryp", None), (5, "@realmadrid", None), (6, None, "bad line"), (7, "@skryp", None),
        (9, "UC12", None)]


def test_line_numbers_of_files_read_in_splits(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 500)):
        (tmp_path / name).write_text("".join(f"@{name}{i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = sources.read_channel_list(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        rows = lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 3500
    assert all(r.channel == f"@{r.file[-1]}{r.line_number}" for r in rows)


def test_captures(spark, tmp_path):
    rows = [{"channel_ref": "@a", "kind": "comments", "response_seq": 1, "body": "{}",
             "fetched_at": "2025-01-05T12:00:00Z", "unknown": 1}]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(r) for r in rows))
    df = sources.read_responses(spark, str(tmp_path / "r.json"), "json")
    assert df.schema == spark.createDataFrame([], RESPONSE_CAPTURES).schema
    assert df.first().response_seq == 1
    df.write.parquet(str(tmp_path / "p"))
    assert sources.read_responses(spark, str(tmp_path / "p")).count() == 1
    pages = spark.createDataFrame([("@a", None, "u", "<html>", None)], PAGE_CAPTURES)
    pages.write.parquet(str(tmp_path / "pages"))
    assert sources.read_pages(spark, str(tmp_path / "pages")).collect() == pages.collect()


def test_page_files(spark, tmp_path):
    (tmp_path / "one.html").write_text("<html>\n1\n</html>")
    (tmp_path / "two.html").write_text("<html>2</html>")
    rows = sources.read_page_files(spark, str(tmp_path)).orderBy("url").collect()
    assert [r.html for r in rows] == ["<html>\n1\n</html>", "<html>2</html>"]
    assert rows[0].url.endswith("/one.html") and rows[0].fetched_at is not None


def test_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == named
    assert session.new_path(spark, "x") != session.new_path(spark, "x")
    staged = session.stage(spark.range(3), "numbers")
    assert staged.count() == 3 and named in staged.inputFiles()[0]


class Cluster:
    """A session on a cluster without a shared folder."""

    master, applicationId = "spark://host:7077", "app"

    @property
    def conf(self):
        return self

    @property
    def sparkContext(self):  # noqa: N802 - Spark's name
        return self

    def get(self, key, default):
        return default

    def getCheckpointDir(self):  # noqa: N802 - Spark's name
        return None


def test_cluster_must_name_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())
    local = Cluster()
    local.master = "local[2]"
    assert session.shared_dir(local) == session.shared_dir(local)
