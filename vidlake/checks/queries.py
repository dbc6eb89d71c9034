"""The registered queries: operators over captures of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidlake.checks import captures as cap
from vidlake.checks.captures import table
from vidlake.functions import (
    channel_videos_path,
    comments_file_name,
    format_bytes,
    format_duration,
    format_number,
    format_time,
    length_to_minutes,
    parse_comment_count,
    parse_view_count,
    register,
    safe_name,
    video_comments_path,
)
from vidlake.functions.jsonscan import BODY_ERROR
from vidlake.operators import comments as com
from vidlake.operators import discussion, nested, progress, stats
from vidlake.operators import videos as vid
from vidlake.operators.embedded import extract_config, extract_data, page_errors
from vidlake.plans.channels import channel_tables, comment_responses, video_pages, video_table
from vidlake.schemas import COMMENT_FIELDS, VIDEO_FIELDS
from vidlake.session import new_path, staged
from vidlake.sinks import export_comments, export_videos, videos_json_lines
from vidlake.sinks.tables import csv_cell
from vidlake.sources import (
    parse_channel_lines,
    read_channel_list,
    read_pages,
    read_responses,
    until_empty,
)
from vidlake.streaming import (
    Progress,
    landed_comments,
    latest_totals,
    live_totals,
    read_landing,
    stream_comments,
)

_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    _REGISTRY[fn.__name__] = fn
    return fn


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_REGISTRY)


# --- references, names, numbers -----------------------------------------------------------


def _reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    s = n.cast("string")
    text = (
        F.when(n % 6 == 0, F.concat(F.lit("https://www.youtube.com/@h_"), s, F.lit("/v?u="), "url"))
        .when(n % 6 == 1, F.concat(F.lit(" \t@name "), s, F.lit(" ")))
        .when(n % 6 == 2, F.concat(F.lit("http://youtube.com/channel/UC"), s, F.lit("-x?u="), "url"))
        .when(n % 6 == 3, F.concat(F.lit("/channel/UC"), s, F.lit("/about")))
        .when(n % 6 == 4, F.concat(F.lit(" UC"), s, F.lit("_z  ")))
        .when(n % 12 == 5, F.concat(F.lit(" # "), "url"))
        .otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", text.alias("text"))


@query
def channel_refs(spark, sf_dir):
    return parse_channel_lines(_reference_lines(spark, sf_dir)).select(
        "page_id", "channel", "reject")


@query
def channel_list(spark, sf_dir):
    path = new_path(spark, "channel-list")
    _reference_lines(spark, sf_dir).select("text").write.text(path)
    lines = read_channel_list(spark, path)
    return lines.groupBy("channel", "reject").agg(F.count("*").alias("listed"))


@query
def safe_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("@"), "source", F.lit("/"), "lang", F.lit("\\@"),
                    F.col("doc_id").cast("string"))
    return docs.select(
        "doc_id", safe_name(name).alias("safe_key"),
        channel_videos_path(name, "out", "csv").alias("videos_path"),
        video_comments_path(name).alias("comments_path"))


@query
def comment_paths(spark, sf_dir):
    k = F.col("p_partkey")
    number = (k * 7).cast("int")
    name = F.concat(F.lit("v"), k.cast("string"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", comments_file_name(number, name).alias("jsonl"),
        comments_file_name(number, name, "csv").alias("csv"),
        comments_file_name(number, name, "parquet").alias("parquet"))


def _view_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    d = F.col("l_partkey") % 10
    raw = (
        F.when(n == 1, F.concat(F.format_number(cents, 0), F.lit(" views")))
        .when(n == 2, F.format_string("%d.%dK views", q, d))
        .when(n == 3, F.format_string("%dM", q))
        .when(n == 4, F.format_string("about %d.%d%db of them", q, d, d))
        .when(n == 5, F.format_string(" %d  k", q))
        .when(n == 6, F.format_string("%d\u202f%03d\u00a0%03d views", q, d, d))
        .otherwise(F.lit("No views"))
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", raw.alias("raw"))


@query
def view_counts(spark, sf_dir):
    return _view_texts(spark, sf_dir).withColumn("views", parse_view_count(F.col("raw")))


def _count_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    text = (
        F.when(k % 7 == 0, F.concat(F.format_number(cents, 0), F.lit(" Comments")))
        .when(k % 7 == 1, F.format_string("%d.%dK", k % 1000, k % 10))
        .when(k % 7 == 2, F.format_string("%dm", k % 100))
        .when(k % 7 == 3, F.format_string("%d.%03d", k % 100, k % 1000))
        .when(k % 7 == 4, F.format_string("about %d or so", k))
        .when(k % 7 == 5, F.format_string("x %d.%d y b", k % 50, k % 10))
        .otherwise(F.lit("Comments"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("raw"))


@query
def comment_counts(spark, sf_dir):
    return _count_texts(spark, sf_dir).withColumn("counted", parse_comment_count(F.col("raw")))


@query
def durations(spark, sf_dir):
    seconds = F.floor("l_extendedprice") % 20000
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 7, F.lit("LIVE")).otherwise(cap.clock(seconds))
        .alias("length"))
    return rows.withColumn("minutes", length_to_minutes(F.col("length")))


@query
def text_lengths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    talks = table(spark, sf_dir, "conversations").select(
        F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("id"), "text")
    return docs.unionByName(talks).select("id", F.length("text").alias("text_length"))


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    size = (
        F.when(k % 4 == 0, F.floor(cents / 100000)).when(k % 4 == 1, F.floor(cents / 100))
        .when(k % 4 == 2, cents).otherwise(cents * 1000)
    ).cast("bigint")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", size.alias("size"), (cents % 90000 / F.lit(8.0)).alias("seconds"))


@query
def human_figures(spark, sf_dir):
    size, seconds = F.col("size"), F.col("seconds")
    return _figures(spark, sf_dir).select(
        "o_orderkey", format_number(size).alias("number"), format_bytes(size).alias("bytes"),
        format_time(seconds).alias("time"), format_duration(seconds).alias("duration"))


@query
def sql_functions(spark, sf_dir):
    register(spark)
    rows = _figures(spark, sf_dir).join(_count_texts(spark, sf_dir), "o_orderkey")
    return rows.selectExpr(
        "o_orderkey", "human_number(size) AS number", "human_bytes(size) AS bytes",
        "human_time(seconds) AS time", "human_duration(seconds) AS duration",
        "comment_count(raw) AS counted",
        "safe_name(concat('@', raw, '/x')) AS safe_key",
        "comments_file_name(CAST(o_orderkey AS INT), 'x', 'csv') AS file",
        "channel_ref(concat(' UC', o_orderkey)) AS channel",
        "view_count(concat(o_orderkey % 100, '.5K views')) AS views",
        "length_to_minutes(concat(o_orderkey % 60, ':30')) AS minutes",
    )


# --- embedded JSON and nested search ------------------------------------------------------


def _config_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    note = (
        F.when(n % 4 == 1, F.lit('a "}{" b \\ {'))
        .when(n % 4 == 2, F.lit("x }) ; y"))
        .otherwise(F.lit("plain"))
    )
    config = F.to_json(F.struct(
        F.col("url").alias("URL"), n.alias("N"),
        F.struct(note.alias("note"), F.lit("{").alias("brace")).alias("inner")))
    script = (
        F.when(n % 8 == 7, F.concat(F.lit("ytcfg.set({\"URL\": {\"open\": \""), "url"))
        .when(n % 4 == 3, F.concat(F.lit("ytcfg.set ( "), config, F.lit("\n)")))
        .otherwise(F.concat(F.lit("ytcfg.set( "), config, F.lit(" ) ;")))
    )
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.concat("html", F.lit("<script>"), script).alias("html"))


def _config_fields(df: DataFrame) -> DataFrame:
    return df.select(
        "page_id", F.get_json_object("config", "$.URL").alias("config_url"),
        F.get_json_object("config", "$.N").cast("bigint").alias("config_n"),
        F.get_json_object("config", "$.inner.note").alias("note"), "config_error")


@query
def embedded_config(spark, sf_dir):
    return _config_fields(extract_config(_config_pages(spark, sf_dir)))


@query
def embedded_config_robust(spark, sf_dir):
    return _config_fields(extract_config(_config_pages(spark, sf_dir), robust=True))


def _data_script() -> Column:
    n = F.col("page_id")
    data = F.to_json(F.struct(F.col("url").alias("url"), F.col("html").alias("copy")))
    opening = F.when(n % 2 == 0, F.lit("var ytInitialData = ")).otherwise(
        F.lit("window[\"ytInitialData\"] ="))
    ending = (
        F.when(n % 4 == 0, F.lit(";</script>")).when(n % 4 == 1, F.lit(" ;\n"))
        .when(n % 4 == 2, F.lit("; var meta = 1")).otherwise(F.lit(" // the end"))
    )
    return F.when(n % 9 != 8, F.concat(F.lit("<script>"), opening, data, ending)).otherwise(
        F.lit(""))


@query
def embedded_data(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.concat("html", _data_script()).alias("html"))
    return extract_data(pages).select(
        "page_id", F.get_json_object("data", "$.url").alias("url"),
        F.length(F.get_json_object("data", "$.copy")).alias("copied"), "data_error")


@query
def page_errors_listed(spark, sf_dir):
    scripts = table(spark, sf_dir, "pages").select("page_id", _data_script().alias("script"))
    pages = _config_pages(spark, sf_dir).join(scripts, "page_id").select(
        "page_id", F.concat(F.lit("@p"), F.col("page_id").cast("string")).alias("channel_ref"),
        F.lit(None).cast("string").alias("video_id"),
        F.concat("script", F.lit("\n"), "html").alias("html"),
        F.timestamp_seconds(F.lit(1700000000)).alias("fetched_at"))
    before = pages.filter("page_id % 5 = 0").withColumns({
        "html": F.lit(""), "fetched_at": F.timestamp_seconds(F.lit(1600000000))})
    return page_errors(pages.union(before)).select("page_id", "error")


@query
def deep_search(spark, sf_dir):
    return nested.search_key(cap.customer_bodies(spark, sf_dir), "body", "name")


@query
def deep_bodies(spark, sf_dir):
    deep = F.concat(F.repeat(F.lit("["), 1500), "body", F.repeat(F.lit("]"), 1500))
    return nested.search_key(
        cap.customer_bodies(spark, sf_dir).withColumn("body", deep), "body", "name")


@query
def longest_token(spark, sf_dir):
    return nested.add_longest(
        cap.endpoint_bodies(spark, sf_dir), "body", "endpoint", cap.ENDPOINT_PLACES).select(
        "o_custkey", "response_seq", nested.token_of(F.col("endpoint")).alias("token"))


@query
def next_tokens(spark, sf_dir):
    return nested.next_tokens(
        cap.endpoint_bodies(spark, sf_dir), places=cap.ENDPOINT_PLACES).select(
        "o_custkey", "response_seq", "next_token")


@query
def continuation_offers(spark, sf_dir):
    responses, _ = cap.offer_captures(spark, sf_dir)
    return nested.continuations(responses).select("order_key", "kind", "token")


@query
def pending_pages(spark, sf_dir):
    responses, asked = cap.offer_captures(spark, sf_dir)
    return nested.pending(nested.continuations(responses), asked).select(
        "order_key", "kind", "token")


# --- videos -------------------------------------------------------------------------------


def _videos(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return video_table(*cap.video_captures(spark, sf_dir), **options)


@query
def videos_flat(spark, sf_dir):
    return _videos(spark, sf_dir).select("channel_ref", *VIDEO_FIELDS)


@query
def videos_limited(spark, sf_dir):
    return _videos(spark, sf_dir, max_videos=10, fill_first_page=True).select(
        "channel_ref", "video_id", "channel_id", "order")


@query
def videos_fallback(spark, sf_dir):
    parsed = staged(vid.parse_video_bodies(cap.shelf_bodies(spark, sf_dir)), "shelves")
    return vid.videos(parsed).select("channel_ref", "video_id", "title", "view_count", "order")


@query
def channel_totals(spark, sf_dir):
    return _videos(spark, sf_dir).groupBy("channel_ref").agg(
        F.count("*").alias("videos"), F.sum("view_count").alias("views"),
        F.sum(F.round(F.col("length_minutes") * 60).cast("bigint")).alias("seconds"))


# --- comments -----------------------------------------------------------------------------


def _parsed(spark: SparkSession, sf_dir: str, sort_by: int = com.SORT_RECENT) -> DataFrame:
    return comment_responses(cap.comment_captures(spark, sf_dir), sort_by)


_SHOWN = [c for c in COMMENT_FIELDS if c not in ("scraped_at", "source")]


@query
def comments_flat(spark, sf_dir):
    rows = com.comments(com.number_responses(_parsed(spark, sf_dir)))
    return rows.select("channel_ref", "video_id", "pos", *_SHOWN, "record_error")


@query
def comments_limited(spark, sf_dir):
    numbered = com.number_responses(_parsed(spark, sf_dir), per_video_limit=4)
    rows = com.comments(numbered, per_video_limit=4)
    return rows.select("video_id", "pos", "cid",
                       F.unix_seconds("scraped_at").alias("scraped_at"))


@query
def comments_popular(spark, sf_dir):
    rows = com.comments(com.number_responses(_parsed(spark, sf_dir, com.SORT_POPULAR)))
    return rows.select("video_id", "pos", "cid")


@query
def comments_of_videos(spark, sf_dir):
    numbered = com.number_responses(
        _parsed(spark, sf_dir), videos=cap.known_talks(spark, sf_dir))
    return com.comments(numbered).select("channel_ref", "video_id", "order", "pos", "cid")


@query
def comments_per_video(spark, sf_dir):
    listed = cap.listed_talks(spark, sf_dir).select("channel_ref", "video_id")
    silent = listed.withColumn("video_id", F.concat(F.lit("no-"), "video_id"))
    return stats.comments_per_video(
        com.comments(com.number_responses(_parsed(spark, sf_dir))), listed.union(silent))


@query
def counted_comments(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    return stats.counted_comments(
        com.comments(com.number_responses(parsed)), com.video_errors(parsed))


@query
def server_errors(spark, sf_dir):
    return com.video_errors(_parsed(spark, sf_dir)).select("video_id", "first_seq", "error")


@query
def unreadable_responses(spark, sf_dir):
    listed = vid.channel_errors(video_pages(*cap.video_captures(spark, sf_dir)))
    talks = com.video_errors(_parsed(spark, sf_dir)).filter(F.col("error") == BODY_ERROR)
    shown = ["channel_ref", "video_id", "first_seq", "error"]
    return listed.withColumn("video_id", F.lit(None).cast("string")).select(*shown).unionByName(
        talks.select(*shown))


@query
def channel_job(spark, sf_dir):
    paths = []
    for name, rows in zip(("pages", "responses"), cap.talk_captures(spark, sf_dir)):
        paths.append(new_path(spark, name))
        rows.write.parquet(paths[-1])
    t = channel_tables(read_pages(spark, paths[0]), read_responses(spark, paths[1]))

    def rows(df: DataFrame, name: str, number: Column, text: Column) -> DataFrame:
        return df.select(F.lit(name).alias("kind"), "channel_ref", "video_id",
                         number.cast("bigint").alias("number"), text.alias("text"))

    none = F.lit(None).cast("string")
    return (
        rows(t.videos, "video", F.col("order"), F.col("url"))
        .union(rows(t.comments, "comment", F.col("pos"), F.col("cid")))
        .union(rows(t.errors, "error", none, F.col("error")))
        .union(rows(t.totals, "total", F.col("total_count"), none))
    )


@query
def response_chains(spark, sf_dir):
    keys = ["channel_ref", "video_id", "sort_by"]
    kept = until_empty(cap.comment_captures(spark, sf_dir), keys)
    return kept.groupBy("video_id", "sort_by").agg(F.count("*").alias("responses"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discussion.video_facts(cap.talk_pages(spark, sf_dir), com.SORT_RECENT, "retry_body")


@query
def comment_totals(spark, sf_dir):
    totals = discussion.comment_totals(
        _facts(spark, sf_dir), cap.counting_responses(spark, sf_dir))
    return totals.select(
        "video_id", "total_count",
        discussion.expected_total(F.col("total_count"), 100).alias("limited"),
        discussion.expected_total(F.col("total_count")).alias("expected"))


@query
def disabled_videos(spark, sf_dir):
    return _facts(spark, sf_dir).select("video_id", "comments_enabled")


@query
def sort_tokens(spark, sf_dir):
    return _facts(spark, sf_dir).select("video_id", "sort_token", "sort_error", "retry_token")


# --- statistics and progress --------------------------------------------------------------


def _stats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    listed, log = cap.run_logs(spark, sf_dir)
    videos = cap.order_videos(spark, sf_dir)
    lines = cap.line_comments(spark, sf_dir).join(videos, "video_id").select("channel_ref")
    return listed, log, stats.channel_stats(log, videos, lines, videos)


@query
def channel_stats(spark, sf_dir):
    return _stats(spark, sf_dir)[2]


@query
def channel_stats_failed(spark, sf_dir):
    _, log = cap.run_logs(spark, sf_dir)
    videos = cap.order_videos(spark, sf_dir)
    lines = cap.line_comments(spark, sf_dir).join(videos, "video_id").select(
        "channel_ref", "video_id")
    return stats.channel_stats(log, videos, lines, videos, videos.filter("video_id % 10 = 3"))


@query
def batch_report(spark, sf_dir):
    listed, log, rows = _stats(spark, sf_dir)
    return stats.batch_report(listed, log, rows).withColumns({
        c: F.unix_micros(c) for c in ("started_at", "finished_at")})


@query
def report_channels(spark, sf_dir):
    return stats.reported_channels(_stats(spark, sf_dir)[2])


@query
def channel_lines(spark, sf_dir):
    listed, _, rows = _stats(spark, sf_dir)
    return stats.channel_lines(listed, rows)


@query
def fail_fast(spark, sf_dir):
    return progress.until_failure(cap.run_logs(spark, sf_dir)[1]).select(
        "run_id", "idx", "channel", "status")


@query
def listed_channels(spark, sf_dir):
    listed, log = cap.run_logs(spark, sf_dir)
    return stats.listed_channels(listed, progress.until_failure(log))


@query
def error_log(spark, sf_dir):
    return stats.error_log(cap.run_logs(spark, sf_dir)[1])


@query
def error_counts(spark, sf_dir):
    log = cap.run_logs(spark, sf_dir)[1]
    return stats.error_counts(log.filter("status = 'failed'"))


@query
def dry_run(spark, sf_dir):
    videos = table(spark, sf_dir, "part").select(
        cap.brand_channel().alias("channel_ref"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_size") % 2 == 0).alias("has_comments"))
    free = stats.dry_run(videos)
    limited = stats.dry_run(videos.drop("has_comments"), 100).select(
        "channel_ref", F.col("estimated_comments").alias("limited_comments"))
    return free.join(limited, "channel_ref")


@query
def channel_progress(spark, sf_dir):
    return progress.channel_progress(cap.event_log(spark, sf_dir)).select(
        "channel", "order", "video_id", "completed", "total_comments", "total_bytes",
        "elapsed", "percent", "eta_sec")


@query
def status_lines(spark, sf_dir):
    return progress.status_lines(progress.channel_progress(cap.event_log(spark, sf_dir)))


@query
def comment_progress(spark, sf_dir):
    return progress.comment_progress(cap.event_log(spark, sf_dir)).select(
        "video_id", "expected", "percent", "percent_text", "eta")


@query
def comment_progress_limited(spark, sf_dir):
    return progress.comment_progress(cap.event_log(spark, sf_dir), limit=40).select(
        "video_id", "expected", "percent", "percent_text", "eta")


@query
def final_summary(spark, sf_dir):
    return stats.final_summary(cap.event_log(spark, sf_dir))


# --- sinks --------------------------------------------------------------------------------


@query
def csv_cells(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text",
        F.nullif(F.col("lang"), F.lit("en")).alias("lang"),
        (F.col("n_chars") > 500).alias("long"),
        (F.col("n_chars") / F.lit(4.0)).alias("quarter"),
        F.array("doc_id", "n_chars").alias("pair"),
        F.struct("source", F.lit(None).cast("string").alias("none")).alias("origin"))
    return docs.select(*[csv_cell(docs, c) for c in docs.columns])


def _exported(spark: SparkSession, sf_dir: str, fmt: str) -> str:
    path = new_path(spark, f"comments-{fmt}")
    numbered = com.number_responses(
        _parsed(spark, sf_dir), videos=cap.listed_talks(spark, sf_dir))
    export_comments(com.comments(numbered), fmt, path)
    return path


_READ_BACK = ["channel_key", "file_name", *COMMENT_FIELDS]


def _read_back(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in _READ_BACK])


@query
def export_json(spark, sf_dir):
    schema = ", ".join(f"{c} string" for c in _READ_BACK)
    return _read_back(spark.read.schema(schema).json(_exported(spark, sf_dir, "json")))


@query
def export_csv(spark, sf_dir):
    files = spark.read.option("header", True).option("multiLine", True).option(
        "escape", '"').csv(_exported(spark, sf_dir, "csv"))
    return _read_back(files)


@query
def export_parquet(spark, sf_dir):
    return _read_back(spark.read.parquet(_exported(spark, sf_dir, "parquet")))


@query
def export_rerun(spark, sf_dir):
    path = _exported(spark, sf_dir, "json")
    listed = cap.listed_talks(spark, sf_dir)
    numbered = com.number_responses(
        _parsed(spark, sf_dir), videos=listed.filter("channel_ref <> '@talk1'"))
    export_comments(com.comments(numbered), "json", path, channels=listed)
    schema = ", ".join(f"{c} string" for c in _READ_BACK)
    return _read_back(spark.read.schema(schema).json(path))


@query
def export_sizes(spark, sf_dir):
    return stats.file_sizes(spark, _exported(spark, sf_dir, "json"))


@query
def export_videos_csv(spark, sf_dir):
    path = new_path(spark, "videos-csv")
    export_videos(_videos(spark, sf_dir), "csv", path)
    files = spark.read.option("header", True).option("escape", '"').csv(path)
    return files.select(
        "channel_key", F.col("order").cast("int").alias("order"), "video_id", "title",
        "title_length", "thumbnail_url", "channel_id", "view_count", "view_count_raw", "length",
        F.col("length_minutes").cast("double").alias("length_minutes"), "url")


@query
def videos_documents(spark, sf_dir):
    lines = videos_json_lines(_videos(spark, sf_dir))
    element = F.from_json(
        F.concat(F.regexp_replace("line", r"\A    \},\n", ""), F.lit("}")),
        "video_id string, title string, title_length int, channel_id string, view_count bigint, "
        "view_count_raw string, length string, length_minutes double, thumbnail_url string, "
        "url string, `order` int")
    return lines.select(
        "channel_key", "part", F.when(F.col("part") != 1, F.col("line")).alias("line"),
        F.when(F.col("part") == 1, F.col("line").startswith("    {")).alias("begins"),
        F.when(F.col("part") == 1, element).alias("v"),
    ).select("channel_key", "part", "line", "begins", "v.*")


# --- streams ------------------------------------------------------------------------------


def _landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "landing")
    cap.comment_captures(spark, sf_dir).write.parquet(path)
    return read_landing(spark, path)


@query
def streamed_comments(spark, sf_dir):
    out = new_path(spark, "streamed")
    job = stream_comments(_landing(spark, sf_dir), out, new_path(spark, "streamed-state"))
    job.awaitTermination()
    return landed_comments(spark, out).select(
        "channel_ref", "video_id", "pos", *_SHOWN, "record_error")


@query
def observed_comments(spark, sf_dir):
    landing, out = new_path(spark, "landing"), new_path(spark, "streamed")
    cap.comment_captures(spark, sf_dir).repartition(104).write.parquet(landing)
    state, seen = new_path(spark, "streamed-state"), new_path(spark, "progress")
    progress = Progress(spark, out, state, seen)
    progress.follow(stream_comments(
        read_landing(spark, landing, files_per_batch=1), out, state))
    counts = progress.batches()
    files = spark.read.parquet(landing).select("_metadata.file_name").distinct().count()
    return spark.range(1).select(
        F.lit(progress.total()).cast("long").alias("comments"),
        F.lit(sum(counts.values()) == progress.total() and len(counts) == files)
        .alias("by_batch"))


@query
def streamed_totals(spark, sf_dir):
    out = new_path(spark, "totals")
    job = live_totals(_landing(spark, sf_dir), out, new_path(spark, "totals-state"))
    job.awaitTermination()
    return latest_totals(spark, out)
