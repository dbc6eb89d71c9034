from __future__ import annotations

from test_comments import bar, body, comment, responses

from vidlake import streaming
from vidlake.operators.comments import parse_comment_bodies


def land(spark, path, rows):
    responses(spark, rows).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, job, state="state"):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    stream = streaming.read_landing(spark, landing, files_per_batch=1)
    job(stream, out, str(tmp_path / state)).awaitTermination()
    return out


def test_comments_arrive_once(spark, tmp_path):
    def cids():
        out = run(spark, tmp_path, streaming.stream_comments)
        rows = streaming.landed_comments(spark, out).orderBy("video_id", "pos").collect()
        return streaming.written_comments(spark, out), [(r.cid, r.pos) for r in rows]

    landing = str(tmp_path / "landing")
    land(spark, landing, [("v", 0, body(comment("a"), comment("b"), bar())), ("v", 1, "{}")])
    land(spark, landing, [("v", 2, body(comment("late"), bar())), ("w", 0, {"z": [
        comment("c"), bar()]})])
    assert cids() == (4, [("a", 1), ("b", 2), ("c", 1)])  # the chain of v ended before
    land(spark, landing, [("w", 1, body(comment("d"), bar()))])
    assert cids() == (5, [("a", 1), ("b", 2), ("c", 1), ("d", 2)])
    assert cids()[0] == 5


def test_written_comments_of_many_batches(spark, tmp_path):
    rows = [("v", i, body(comment(f"c{i}"), bar())) for i in range(110)]
    responses(spark, rows).repartition(110, "response_seq").write.option(
        "maxRecordsPerFile", 1).parquet(str(tmp_path / "landing"))
    out = run(spark, tmp_path, streaming.stream_comments)
    assert streaming.written_comments(spark, out) == 110
    assert streaming.landed_comments(spark, out).count() == 110


def test_live_totals(spark, tmp_path):
    def totals():
        out = run(spark, tmp_path, streaming.live_totals)
        return [tuple(r) for r in streaming.latest_totals(spark, out).collect()]

    landing, heart = str(tmp_path / "landing"), "TOOLBAR_HEART_STATE_HEARTED"
    land(spark, landing, [("v", 0, body(comment("a", text="12"), bar("k", heart)))])
    land(spark, landing, [("w", 0, body(comment("b", text="345"), comment("c", text=""), bar()))])
    assert totals() == [("@c", 3, 5, 1)]
    land(spark, landing, [("v", 1, body(comment("d", text="x"), bar("k", heart))),
                          ("w", 1, "{"), ("w", 2, body(comment("e"), bar()))])
    assert totals() == [("@c", 4, 6, 2)]  # w ended where it could not be read
    again = responses(spark, [("v", 1, body(comment("d", text="xyz"), bar()))])
    again.selectExpr("* except (fetched_at)", "fetched_at + INTERVAL 1 DAY AS fetched_at").write.mode(
        "append").parquet(landing)
    assert totals() == [("@c", 4, 8, 1)]  # captured again


def test_parsing_is_stateless(spark):
    rows = parse_comment_bodies(responses(spark, [("v", 0, body(comment("a"), bar()))]))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert plan.count("ArrowEvalPython") == 1


def test_progress_counts_every_batch_once(spark, tmp_path):
    rows = [("v", i, body(*[comment(f"c{i}-{k}") for k in range(i % 3)], bar()))
            for i in range(12)]
    landing, out, state, seen = (str(tmp_path / n) for n in ("landing", "out", "state", "seen"))

    def follow(some, forget=False):
        land(spark, landing, some)
        progress = streaming.Progress(spark, out, state, seen)
        told = []
        progress.follow(streaming.stream_comments(
            streaming.read_landing(spark, landing, files_per_batch=1), out, state), told.append)
        assert told == sorted(told)
        return progress, told

    for row in rows[:6]:
        land(spark, landing, [row])
    progress, told = follow(rows[6:9])
    assert progress.total() == told[-1] == 9 and len(progress.batches()) == 7
    progress, told = follow(rows[9:])  # goes on where it was
    assert progress.total() == told[-1] == 12 and len(progress.batches()) == 8
    # The count of a committed batch is lost with the driver: the rows themselves tell.
    lost = next((tmp_path / "seen").glob("0-*"))
    lost.unlink()
    again = streaming.Progress(spark, out, state, seen)
    assert sum(again.batches().values()) == 12 and again.total() == 12
    next((tmp_path / "seen").glob("2-*")).unlink()
    assert sum(streaming.Progress(spark, out, state, seen).batches().values()) == 10
    assert streaming.Progress(spark, out, state, seen).total() == 12
