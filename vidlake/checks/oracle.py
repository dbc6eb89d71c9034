"""For each registered query, the same result in SQL straight from the given tables."""

from __future__ import annotations

from vidlake import SOURCE
from vidlake.checks.captures import LAST_TURN

_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


def _clock(s: str) -> str:
    return (
        f"CASE WHEN {s} < 3600 THEN printf('%d:%02d', {s} // 60, {s} % 60) "
        f"ELSE printf('%d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60) END"
    )


def _minutes(s: str) -> str:
    return (
        f"(CASE WHEN {s} < 3600 THEN {s} // 60 ELSE {s} // 3600 * 60 + {s} % 3600 // 60 END)"
        f" + ({s} % 60) / 60::DOUBLE"
    )


def _bytes(b: str, small: str = "B") -> str:
    return (
        f"CASE WHEN {b} < 1024 THEN {b} || '{small}' "
        f"WHEN {b} < 1048576 THEN printf('%.1fKB', {b} / 1024::DOUBLE) "
        f"WHEN {b} < 1073741824 THEN printf('%.1fMB', {b} / 1048576::DOUBLE) "
        f"ELSE printf('%.2fGB', {b} / 1073741824::DOUBLE) END"
    )


def _time(x: str) -> str:
    s = f"CAST(floor({x}) AS BIGINT)"
    return (
        f"CASE WHEN {x} < 60 THEN {s} || 's' "
        f"WHEN {x} < 3600 THEN ({s} // 60) || 'm ' || ({s} % 60) || 's' "
        f"WHEN {x} >= 3600 THEN ({s} // 3600) || 'h ' || ({s} % 3600 // 60) || 'm' END"
    )


def _duration(x: str) -> str:
    s = f"CAST(floor({x}) AS BIGINT)"
    return (
        f"CASE WHEN {x} < 60 THEN {s} || 's' "
        f"WHEN {x} < 3600 THEN ({s} // 60) || 'm' || "
        f"CASE WHEN {s} % 60 > 0 THEN ' ' || ({s} % 60) || 's' ELSE '' END "
        f"ELSE ({s} // 3600) || 'h' || CASE WHEN {s} % 3600 // 60 > 0 "
        f"THEN ' ' || ({s} % 3600 // 60) || 'm' ELSE '' END END"
    )


_SIZE = (
    f"CASE o_orderkey % 4 WHEN 0 THEN {_CENTS} // 100000 WHEN 1 THEN {_CENTS} // 100 "
    f"WHEN 2 THEN {_CENTS} ELSE {_CENTS} * 1000 END"
)
_SECONDS = f"({_CENTS} % 90000) / 8::DOUBLE"
_COUNT_RAW = f"""CASE o_orderkey % 7
    WHEN 0 THEN format('{{:,}}', {_CENTS}) || ' Comments'
    WHEN 1 THEN (o_orderkey % 1000) || '.' || (o_orderkey % 10) || 'K'
    WHEN 2 THEN (o_orderkey % 100) || 'm'
    WHEN 3 THEN (o_orderkey % 100) || '.' || printf('%03d', o_orderkey % 1000)
    WHEN 4 THEN 'about ' || o_orderkey || ' or so'
    WHEN 5 THEN 'x ' || (o_orderkey % 50) || '.' || (o_orderkey % 10) || ' y b'
    ELSE 'Comments' END"""
_COUNTED = f"""CASE o_orderkey % 7
    WHEN 0 THEN {_CENTS}
    WHEN 1 THEN CAST(trunc(CAST((o_orderkey % 1000) || '.' || (o_orderkey % 10) AS DOUBLE)
                           * 1000::DOUBLE) AS BIGINT)
    WHEN 2 THEN (o_orderkey % 100) * 1000000
    WHEN 3 THEN o_orderkey % 100
    WHEN 4 THEN o_orderkey
    WHEN 5 THEN CAST(trunc(((o_orderkey % 50)::DOUBLE + (o_orderkey % 10) / 10::DOUBLE)
                           * 1000000000::DOUBLE) AS BIGINT)
    END"""

_REF_LINES = """
    SELECT page_id,
      CASE page_id % 6 WHEN 0 THEN '@h_' || page_id WHEN 1 THEN '@name ' || page_id
        WHEN 2 THEN 'UC' || page_id || '-x' WHEN 3 THEN 'UC' || page_id
        WHEN 4 THEN 'UC' || page_id || '_z' END AS channel,
      CASE WHEN page_id % 6 = 5 THEN url END AS reject
    FROM pages WHERE page_id % 12 <> 5"""

_VIEW_COUNT = """CASE p_partkey % 6
      WHEN 0 THEN p_partkey * 7919
      WHEN 1 THEN CAST(trunc(CAST((p_partkey % 1000 // 10) || '.' || (p_partkey % 10) AS DOUBLE)
                             * 1000::DOUBLE) AS BIGINT)
      WHEN 2 THEN CAST(trunc(CAST(p_size || '.' || (p_partkey % 10) AS DOUBLE)
                             * 1000000::DOUBLE) AS BIGINT)
      WHEN 5 THEN (p_partkey + 1) * 1000 + p_partkey % 1000 END"""
_SECS = "(p_size * 97 + p_partkey % 4001)"
_VIDEOS = f"""
    SELECT '@' || replace(p_brand, '#', '-') AS channel_ref, 'v' || p_partkey AS video_id,
      p_name || ' é ' || p_type AS title,
      CAST(length(p_name || ' é ' || p_type) AS INTEGER) AS title_length,
      CASE WHEN p_partkey % 3 <> 0 THEN 'UC' || p_size
        WHEN p_partkey >= 750 THEN '@' || replace(p_brand, '#', '-') ELSE '' END AS channel_id,
      {_VIEW_COUNT} AS view_count,
      CASE p_partkey % 6
        WHEN 0 THEN format('{{:,}}', p_partkey * 7919) || ' views'
        WHEN 1 THEN (p_partkey % 1000 // 10) || '.' || (p_partkey % 10) || 'K views'
        WHEN 2 THEN p_size || '.' || (p_partkey % 10) || 'M'
        WHEN 3 THEN 'No views' WHEN 4 THEN ''
        ELSE (p_partkey + 1) || chr(160) || printf('%03d', p_partkey % 1000) || ' views'
        END AS view_count_raw,
      CASE WHEN p_partkey % 11 = 3 THEN '' ELSE {_clock(_SECS)} END AS length,
      CASE WHEN p_partkey % 11 <> 3 THEN {_minutes(_SECS)} END AS length_minutes,
      CASE WHEN p_partkey % 13 = 1 THEN ''
        ELSE 'https://img.example/l/' || p_partkey END AS thumbnail_url,
      'https://www.youtube.com/watch?v=v' || p_partkey AS url,
      CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS "order",
      p_partkey, {_SECS} AS secs
    FROM part WHERE p_partkey % 37 <> 5"""

_HEART = "(conv_id + turn) % 4 = 0"
_VOTES = "CASE WHEN turn % 3 = 0 THEN '0' ELSE (turn * conv_id)::VARCHAR END"
_CID = "'t' || conv_id || CASE WHEN turn % 2 = 1 THEN '.' ELSE '-' END || turn"
#: Turns received before their video's chain ends.
_KEPT = """
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations
    WHERE NOT (conv_id % 9 = 4 AND turn >= 3) AND NOT (conv_id % 11 = 7 AND turn >= 6)
      AND NOT (conv_id % 13 = 5 AND turn >= 3)"""
#: Conversations whose chain ends at a response cut short or at a server error.
_BROKEN = """
    SELECT DISTINCT conv_id, CASE WHEN conv_id % 13 = 5 THEN 1 ELSE 2 END AS first_seq,
      CASE WHEN conv_id % 13 = 5 THEN 'Failed to parse response JSON'
        ELSE 'Error returned from server: quota "used" up' END AS error
    FROM conversations WHERE conv_id % 9 <> 4 AND (
      (conv_id % 13 = 5 AND turn BETWEEN 3 AND 5)
      OR (conv_id % 13 <> 5 AND conv_id % 11 = 7 AND turn BETWEEN 6 AND 8))"""


def _exported(ext: str, more: str = "") -> str:
    return f"""
    SELECT 'talk' || (conv_id % 5) AS channel_key,
      printf('%04d', conv_id // 5 + 1) || '_c' || conv_id || '.{ext}' AS file_name,
      {_CID} AS cid, text, length(text)::VARCHAR AS text_length, {_VOTES} AS votes,
      (turn % 4)::VARCHAR AS replies, ({_HEART})::VARCHAR AS heart,
      (turn % 2 = 1)::VARCHAR AS reply, '2023-11-14T22:13:20+00:00' AS scraped_at,
      turn || ' days ago' AS time, '@' || role AS author, 'UC' || conv_id AS channel,
      'https://img.example/a/' || role AS photo, '{SOURCE}' AS source{more}
    FROM ({_KEPT})"""


_RUN_LOG = """
    SELECT printf('run-%02d', c_nationkey) AS run_id, CAST(c_custkey AS INTEGER) AS idx,
      '@' || c_name AS channel, c_custkey,
      CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'ok' END AS status,
      CASE WHEN c_acctbal < 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Failed to set sorting'
        ELSE 'Failed to extract ytInitialData' END END AS error,
      c_custkey AS started, c_custkey + (c_custkey % 1000) / 4::DOUBLE AS finished
    FROM customer"""
_UNTIL_FAILURE = f"""
    SELECT * FROM (SELECT *, count(*) FILTER (status = 'failed') OVER (
        PARTITION BY run_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f
      FROM ({_RUN_LOG})) WHERE f = 0"""
def _stats_of(counted: str) -> str:
    return f"""
    SELECT run_id, idx, channel, status, error,
      CASE WHEN status = 'ok' THEN coalesce(v, 0) ELSE 0 END AS videos,
      CASE WHEN status = 'ok' THEN coalesce(c, 0) ELSE 0 END AS comments,
      CASE WHEN status = 'ok' THEN coalesce(b, 0) ELSE 0 END AS bytes,
      CASE WHEN status = 'ok' THEN coalesce(b, 0) / 1048576::DOUBLE ELSE 0::DOUBLE END AS bytes_mb,
      CASE WHEN status = 'ok' THEN finished - started ELSE 0::DOUBLE END AS duration_sec
    FROM ({_RUN_LOG}) r
    LEFT JOIN (SELECT o_custkey, count(*) AS v, CAST(sum({_CENTS}) FILTER ({counted}) AS BIGINT) AS b
               FROM orders GROUP BY 1) o ON o.o_custkey = r.c_custkey
    LEFT JOIN (SELECT o_custkey, count(*) AS c FROM lineitem JOIN orders
               ON l_orderkey = o_orderkey WHERE {counted} GROUP BY 1) l
      ON l.o_custkey = r.c_custkey"""


_STATS = _stats_of("TRUE")

_EVENTS = """
    SELECT 'u' || user_id AS channel, 'e' || event_id AS video_id, event_id,
      count(*) OVER (PARTITION BY user_id) AS total_videos,
      CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS "order",
      event_type <> 'error' AS ok, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
      (event_id % 40) / 4::DOUBLE AS sec
    FROM events"""
_PROGRESS = f"""
    SELECT * FROM (
      SELECT *,
        count(*) FILTER (ok) OVER w AS completed,
        CAST(coalesce(sum(k) FILTER (ok) OVER w, 0) AS BIGINT) AS total_comments,
        CAST(coalesce(sum(k * k * (event_id % 97) * 64) FILTER (ok) OVER w, 0) AS BIGINT)
          AS total_bytes,
        sum(sec) OVER w AS elapsed,
        sum(sec) FILTER (ok) OVER w AS worked
      FROM ({_EVENTS})
      WINDOW w AS (PARTITION BY channel ORDER BY "order"
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    ) WHERE ok"""
_PERCENT = "(completed / total_videos::DOUBLE * 100)"
_ETA = ("CASE WHEN total_videos > completed "
        "THEN worked / completed * (total_videos - completed) END")


def _comment_progress(expected: str) -> str:
    known = "coalesce(expected, 0) > 0"
    left = "(expected - k) / (k / sec)"
    return f"""
    SELECT video_id, expected,
      CASE WHEN {known} THEN k / expected::DOUBLE * 100 END AS percent,
      CASE WHEN {known} THEN printf('%.1f%%', k / expected::DOUBLE * 100) END AS percent_text,
      CASE WHEN {known} AND k > 0 AND sec >= 1 THEN
        CASE WHEN expected <= k THEN 'almost done' ELSE {_time(left)} END END AS eta
    FROM (SELECT *, {expected} AS expected FROM ({_EVENTS}))"""


_TALKS = "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1"
_TOTAL = """CASE
      WHEN conv_id % 7 IN (0, 2, 4, 5) THEN n * 1234 + conv_id
      WHEN conv_id % 7 = 1 THEN CAST(trunc(CAST(n || '.3' AS DOUBLE) * 1000::DOUBLE) AS BIGINT)
      WHEN conv_id % 2 = 0 THEN n * 10 * 1000000 END"""

_TOKEN = "repeat('x', CAST(o_orderkey % 4 AS INTEGER)) || printf('%012d', o_orderkey)"
_LONGEST = f"""
    SELECT o_custkey, CAST(o_orderkey // 10000 AS INTEGER) AS response_seq,
      arg_max({_TOKEN}, (length({_TOKEN}), o_orderkey)) AS token,
      arg_max({_TOKEN}, o_orderkey) AS last_token
    FROM orders GROUP BY 1, 2"""
_OFFERS = """
    SELECT DISTINCT l_orderkey AS order_key, l_linenumber,
      CASE WHEN l_linenumber <= 4 THEN 'section' ELSE 'replies' END AS kind,
      l_orderkey || '-' || l_linenumber AS token
    FROM lineitem"""


def _config(robust: bool) -> str:
    bad = "page_id % 8 = 7" if robust else "page_id % 8 = 7 OR page_id % 4 = 2"
    parse = "" if robust else "WHEN page_id % 4 = 2 THEN 'Failed to parse ytcfg JSON'"
    return f"""
    SELECT page_id, CASE WHEN NOT ({bad}) THEN url END AS config_url,
      CASE WHEN NOT ({bad}) THEN page_id END AS config_n,
      CASE WHEN {bad} THEN NULL WHEN page_id % 4 = 1 THEN 'a "}}{{" b \\ {{'
        WHEN page_id % 4 = 2 THEN 'x }}) ; y' ELSE 'plain' END AS note,
      CASE WHEN page_id % 8 = 7 THEN 'Failed to extract ytcfg' {parse} END AS config_error
    FROM pages"""


_DEEP = """
    SELECT c_nationkey, CAST(c_custkey // 2000 AS INTEGER) AS part,
      CAST(row_number() OVER (PARTITION BY c_nationkey, c_custkey // 2000
                              ORDER BY c_custkey DESC) AS INTEGER) AS pos,
      CASE WHEN c_custkey % 2 = 0 THEN '"' || c_name || '"'
        ELSE '{"name": "' || c_name || '"}' END AS value
    FROM customer
    UNION ALL
    SELECT DISTINCT c_nationkey, CAST(c_custkey // 2000 AS INTEGER), 0,
      '"nation \\"é\\" ' || c_nationkey || '"' FROM customer"""

_ORACLE = {
    "channel_refs": _REF_LINES,
    "channel_list": f"SELECT channel, reject, count(*) AS listed FROM ({_REF_LINES}) GROUP BY 1, 2",
    "safe_keys": """
        SELECT doc_id, source || '_' || lang || '_' || doc_id AS safe_key,
          'out/' || source || '_' || lang || '_' || doc_id || '/videos.csv' AS videos_path,
          'data/' || source || '_' || lang || '_' || doc_id || '/comments.jsonl' AS comments_path
        FROM documents""",
    "comment_paths": """
        SELECT p_partkey, printf('%04d', p_partkey * 7) || '_v' || p_partkey || '.jsonl' AS jsonl,
          printf('%04d', p_partkey * 7) || '_v' || p_partkey || '.csv' AS csv,
          printf('%04d', p_partkey * 7) || '_v' || p_partkey || '.parquet' AS parquet
        FROM part""",
    "view_counts": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
          CASE l_linenumber WHEN 1 THEN format('{:,}', cents) || ' views'
            WHEN 2 THEN q || '.' || d || 'K views' WHEN 3 THEN q || 'M'
            WHEN 4 THEN 'about ' || q || '.' || d || d || 'b of them'
            WHEN 5 THEN ' ' || q || '  k'
            WHEN 6 THEN q || chr(8239) || printf('%03d', d) || chr(160) || printf('%03d', d)
              || ' views'
            ELSE 'No views' END AS raw,
          CASE l_linenumber WHEN 1 THEN cents
            WHEN 2 THEN CAST(trunc(CAST(q || '.' || d AS DOUBLE) * 1000::DOUBLE) AS BIGINT)
            WHEN 3 THEN q * 1000000
            WHEN 4 THEN CAST(trunc(CAST(q || '.' || d || d AS DOUBLE) * 1000000000::DOUBLE)
                             AS BIGINT)
            WHEN 5 THEN q * 1000
            WHEN 6 THEN q * 1000000 + d * 1001 END AS views
        FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q, l_partkey % 10 AS d,
                CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)""",
    "comment_counts": f"SELECT o_orderkey, {_COUNT_RAW} AS raw, {_COUNTED} AS counted FROM orders",
    "durations": f"""
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
          CASE WHEN l_linenumber = 7 THEN 'LIVE' ELSE {_clock('s')} END AS length,
          CASE WHEN l_linenumber <> 7 THEN {_minutes('s')} END AS minutes
        FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) % 20000 AS s FROM lineitem)""",
    "text_lengths": """
        SELECT 'd' || doc_id AS id, CAST(length(text) AS INTEGER) AS text_length FROM documents
        UNION ALL
        SELECT conv_id || '.' || turn, CAST(length(text) AS INTEGER) FROM conversations""",
    "human_figures": f"""
        SELECT o_orderkey, format('{{:,}}', size) AS number, {_bytes('size')} AS bytes,
          {_time('seconds')} AS time, {_duration('seconds')} AS duration
        FROM (SELECT o_orderkey, {_SIZE} AS size, {_SECONDS} AS seconds FROM orders)""",
    "sql_functions": f"""
        SELECT o_orderkey, format('{{:,}}', size) AS number, {_bytes('size')} AS bytes,
          {_time('seconds')} AS time, {_duration('seconds')} AS duration, counted,
          replace(raw, '/', '_') || '_x' AS safe_key,
          printf('%04d', o_orderkey) || '_x.csv' AS file, 'UC' || o_orderkey AS channel,
          o_orderkey % 100 * 1000 + 500 AS views, o_orderkey % 60 + 0.5::DOUBLE AS minutes
        FROM (SELECT o_orderkey, {_SIZE} AS size, {_SECONDS} AS seconds, {_COUNTED} AS counted,
                {_COUNT_RAW} AS raw FROM orders)""",
    "embedded_config": _config(False),
    "embedded_config_robust": _config(True),
    "embedded_data": """
        SELECT page_id, CASE WHEN page_id % 9 <> 8 THEN url END AS url,
          CASE WHEN page_id % 9 <> 8 THEN CAST(length(html) AS INTEGER) END AS copied,
          CASE WHEN page_id % 9 = 8 THEN 'Failed to extract ytInitialData' END AS data_error
        FROM pages""",
    "page_errors_listed": """
        SELECT page_id, CASE WHEN page_id % 8 = 7 THEN 'Failed to extract ytcfg'
          WHEN page_id % 4 = 2 THEN 'Failed to parse ytcfg JSON'
          ELSE 'Failed to extract ytInitialData' END AS error
        FROM pages WHERE page_id % 8 = 7 OR page_id % 4 = 2 OR page_id % 9 = 8""",
    "deep_search": _DEEP,
    "deep_bodies": _DEEP,
    "longest_token": f"SELECT o_custkey, response_seq, token FROM ({_LONGEST})",
    "next_tokens": f"""
        SELECT o_custkey, response_seq,
          CASE WHEN response_seq = 0 THEN token ELSE last_token END AS next_token
        FROM ({_LONGEST})""",
    "continuation_offers": f"SELECT order_key, kind, token FROM ({_OFFERS})",
    "pending_pages": f"""
        SELECT order_key, kind, token FROM ({_OFFERS}) o WHERE NOT EXISTS (
          SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.order_key
            AND l.l_linenumber = o.l_linenumber AND l.l_returnflag = 'R')""",
    "videos_flat": f"SELECT * EXCLUDE (p_partkey, secs) FROM ({_VIDEOS})",
    "videos_limited": f"""
        SELECT channel_ref, video_id, coalesce(nullif(channel_id, ''), channel_ref) AS channel_id,
          "order" FROM ({_VIDEOS}) WHERE "order" <= 10""",
    "videos_fallback": f"""
        SELECT '@' || replace(p_brand, '#', '-') AS channel_ref, 'v' || p_partkey AS video_id,
          p_name || ' é ' || p_type AS title, {_VIEW_COUNT} AS view_count,
          CAST(row_number() OVER (PARTITION BY p_brand
            ORDER BY p_partkey // 750, p_partkey % 5 = 0, p_partkey DESC) AS INTEGER) AS "order"
        FROM part WHERE p_partkey % 37 <> 5""",
    "channel_totals": f"""
        SELECT channel_ref, count(*) AS videos, CAST(sum(view_count) AS BIGINT) AS views,
          CAST(sum(secs) FILTER (length <> '') AS BIGINT) AS seconds
        FROM ({_VIDEOS}) GROUP BY 1""",
    "comments_flat": f"""
        SELECT '@talk' || (conv_id % 5) AS channel_ref, 'c' || conv_id AS video_id, pos,
          {_CID} AS cid, text, CAST(length(text) AS INTEGER) AS text_length,
          turn || ' days ago' AS time, '@' || role AS author, 'UC' || conv_id AS channel,
          {_VOTES} AS votes, (turn % 4)::VARCHAR AS replies,
          'https://img.example/a/' || role AS photo, {_HEART} AS heart, turn % 2 = 1 AS reply,
          NULL::VARCHAR AS record_error
        FROM ({_KEPT})""",
    "comments_limited": f"""
        SELECT 'c' || conv_id AS video_id, pos, {_CID} AS cid, 1700000000::BIGINT AS scraped_at
        FROM ({_KEPT}) WHERE pos <= 4""",
    "comments_popular": f"""
        SELECT 'c' || conv_id AS video_id,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pos, {_CID} AS cid
        FROM conversations""",
    "comments_of_videos": f"""
        SELECT '@talk' || (conv_id % 5) AS channel_ref, 'c' || conv_id AS video_id,
          CAST(conv_id // 5 + 1 AS INTEGER) AS "order", pos, {_CID} AS cid
        FROM ({_KEPT}) WHERE conv_id % 4 <> 3""",
    "comments_per_video": f"""
        SELECT '@talk' || (conv_id % 5) AS channel_ref, kind || conv_id AS video_id,
          CASE WHEN kind = 'c' THEN (SELECT count(*) FROM ({_KEPT}) k WHERE k.conv_id = t.conv_id)
            ELSE 0 END AS comments
        FROM (SELECT DISTINCT conv_id FROM conversations) t,
          (VALUES ('c'), ('no-c')) kinds(kind)""",
    "counted_comments": f"""
        SELECT '@talk' || (conv_id % 5) AS channel_ref, count(*) AS comments FROM ({_KEPT})
        WHERE conv_id NOT IN (SELECT conv_id FROM ({_BROKEN}))
        GROUP BY 1""",
    "server_errors": f"SELECT 'c' || conv_id AS video_id, first_seq, error FROM ({_BROKEN})",
    "unreadable_responses": f"""
        SELECT '@talk' || (conv_id % 5) AS channel_ref, 'c' || conv_id AS video_id, first_seq,
          error FROM ({_BROKEN}) WHERE conv_id % 13 = 5
        UNION ALL
        SELECT DISTINCT '@' || replace(p_brand, '#', '-'), NULL, 10000,
          'Failed to parse response JSON'
        FROM part WHERE p_partkey < 750
          AND CAST(regexp_extract(p_brand, '\\d+') AS INTEGER) % 4 = 1""",
    "channel_job": f"""
        WITH talks AS (SELECT *, '@talk' || (conv_id % 5) AS channel_ref, 'c' || conv_id AS video_id,
            row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id) AS place,
            conv_id % 10 <> 6 AND conv_id % 8 <> 5 AS found FROM ({_TALKS}))
        SELECT 'video' AS kind, channel_ref, video_id, place AS number,
          'https://www.youtube.com/watch?v=' || video_id AS text FROM talks
        UNION ALL
        SELECT 'comment', '@talk' || (conv_id % 5), 'c' || conv_id, pos, {_CID} FROM ({_KEPT})
        UNION ALL
        SELECT 'error', '@talk' || (conv_id % 5), 'c' || conv_id, NULL, error FROM ({_BROKEN})
        UNION ALL
        SELECT 'error', channel_ref, video_id, NULL, 'Failed to set sorting' FROM talks
        WHERE conv_id % 7 <> 3 AND NOT found
        UNION ALL
        SELECT 'error', '@gone', NULL, NULL, 'Failed to extract ytcfg'
        UNION ALL
        SELECT 'total', channel_ref, video_id,
          CASE WHEN found AND conv_id % 7 NOT IN (3, 6) THEN {_TOTAL} END, NULL FROM talks""",
    "response_chains": f"""
        SELECT 'c' || conv_id AS video_id, 1 AS sort_by, count(DISTINCT turn // 3) AS responses
        FROM conversations WHERE NOT (conv_id % 9 = 4 AND turn >= 3) GROUP BY 1
        UNION ALL
        SELECT 'c' || conv_id, 0, count(DISTINCT ({LAST_TURN} - turn) // 3) FROM conversations
        GROUP BY 1""",
    "comment_totals": f"""
        SELECT 'c' || conv_id AS video_id, total AS total_count, 100::BIGINT AS limited,
          total AS expected
        FROM (SELECT conv_id, CASE WHEN conv_id % 7 = 3 OR conv_id % 10 = 6 THEN NULL
                WHEN conv_id % 16 = 5 THEN 900 + conv_id * 3 WHEN conv_id % 8 = 5 THEN NULL
                ELSE {_TOTAL} END AS total FROM ({_TALKS}))""",
    "disabled_videos": f"""
        SELECT 'c' || conv_id AS video_id, conv_id % 7 <> 3 AS comments_enabled
        FROM ({_TALKS})""",
    "sort_tokens": f"""
        SELECT 'c' || conv_id AS video_id, CASE WHEN found THEN 's' || conv_id || '-1' END
            AS sort_token,
          CASE WHEN NOT found THEN 'Failed to set sorting' END AS sort_error,
          's' || conv_id || '-retry' AS retry_token
        FROM (SELECT conv_id, conv_id % 10 <> 6 AND (conv_id % 8 <> 5 OR conv_id % 16 = 5)
              AS found FROM ({_TALKS}))""",
    "channel_stats": f"SELECT * EXCLUDE (bytes) FROM ({_STATS})",
    "channel_stats_failed":
        f"SELECT * EXCLUDE (bytes) FROM ({_stats_of('o_orderkey % 10 <> 3')})",
    "batch_report": f"""
        SELECT run_id, any_value(folder) AS folder, count(*) AS channels_total,
          any_value(first_at) AS started_at, any_value(last_at) AS finished_at,
          count(*) FILTER (status = 'ok') AS channels_ok,
          count(*) FILTER (status = 'failed') AS channels_failed,
          CAST(sum(videos) AS BIGINT) AS total_videos,
          CAST(sum(comments) AS BIGINT) AS total_comments,
          CAST(printf('%.2f', sum(bytes_mb)) AS DOUBLE) AS total_bytes_mb,
          CAST(printf('%.1f', any_value(span)) AS DOUBLE) AS total_duration_sec
        FROM ({_STATS}) JOIN (SELECT run_id, max(finished) - min(started) AS span,
                                CAST(1735689600000000 + min(started) * 1000000 AS BIGINT)
                                  AS first_at,
                                CAST(1735689600000000 + max(finished) * 1000000 AS BIGINT)
                                  AS last_at,
                                strftime(TIMESTAMP '2025-01-01' + to_seconds(min(started)),
                                         '%Y-%m-%d_%H-%M-%S') AS folder
                              FROM ({_RUN_LOG}) GROUP BY 1) USING (run_id)
        GROUP BY 1""",
    "report_channels": f"""
        SELECT run_id, idx, channel, status, error,
          CASE WHEN status = 'ok' THEN videos END AS videos,
          CASE WHEN status = 'ok' THEN comments END AS comments,
          CASE WHEN status = 'ok' THEN CAST(printf('%.2f', bytes_mb) AS DOUBLE) END AS bytes_mb,
          CASE WHEN status = 'ok' THEN CAST(printf('%.1f', duration_sec) AS DOUBLE) END
            AS duration_sec
        FROM ({_STATS})""",
    "channel_lines": f"""
        SELECT run_id, idx, '[' || idx || '/' || count(*) OVER (PARTITION BY run_id) || '] '
          || channel || ' — ' || CASE WHEN status = 'failed' THEN 'ERROR: ' || error
          ELSE format('{{:,}}', videos) || ' videos — ' || format('{{:,}}', comments)
            || ' comments — OK (' || {_bytes('bytes', '.0B')} || ', '
            || {_duration('duration_sec')} || ')' END AS line
        FROM ({_STATS})""",
    "fail_fast": f"SELECT run_id, idx, channel, status FROM ({_UNTIL_FAILURE})",
    "listed_channels": f"""
        SELECT run_id, idx, l.channel, d.status, d.error FROM ({_RUN_LOG}) l
        LEFT JOIN ({_UNTIL_FAILURE}) d USING (run_id, idx)""",
    "error_log": f"""
        SELECT run_id, idx,
          strftime(stamp, '%Y-%m-%dT%H:%M:%S') || CASE WHEN finished = floor(finished) THEN ''
            ELSE '.' || printf('%06d', CAST((finished - floor(finished)) * 1000000 AS BIGINT)) END
          || '+00:00 | ' || channel || ' | ' || error AS line
        FROM (SELECT *, TIMESTAMP '2025-01-01' + to_seconds(CAST(floor(finished) AS BIGINT)) AS stamp
              FROM ({_RUN_LOG})) WHERE status = 'failed'""",
    "error_counts": f"""
        SELECT error, count(*) AS failures FROM ({_RUN_LOG}) WHERE status = 'failed' GROUP BY 1""",
    "dry_run": """
        SELECT '@' || replace(p_brand, '#', '-') AS channel_ref, count(*) AS videos,
          count(*) FILTER (p_size % 3 <> 0 OR p_size % 2 = 0) AS videos_with_comments,
          count(*) FILTER (p_size % 3 <> 0 OR p_size % 2 = 0) * 500 AS estimated_comments,
          count(*) * 100 AS limited_comments
        FROM part GROUP BY 1""",
    "channel_progress": f"""
        SELECT channel, "order", video_id, completed, total_comments, total_bytes, elapsed,
          {_PERCENT} AS percent, {_ETA} AS eta_sec FROM ({_PROGRESS})""",
    "status_lines": f"""
        SELECT channel, "order", 'Videos: ' || completed || '/' || total_videos || ' ('
          || printf('%.1f%%', {_PERCENT}) || ') | Comments: ' || format('{{:,}}', total_comments)
          || ' | Data: ' || {_bytes('total_bytes')} || ' | Time: ' || {_time('elapsed')}
          || coalesce(' | ETA: ' || {_time('eta')}, '') AS line
        FROM (SELECT *, {_ETA} AS eta FROM ({_PROGRESS}))
        WHERE "order" % 5 = 0 OR "order" = total_videos""",
    "comment_progress": _comment_progress(
        "CASE WHEN event_id % 5 <> 0 THEN k * (event_id % 5) - 1 END"),
    "comment_progress_limited": _comment_progress("40::BIGINT"),
    "final_summary": f"""
        SELECT channel, videos, comments, bytes, elapsed,
          '  Total Videos:   ' || format('{{:,}}', videos) || chr(10)
          || '  Total Comments: ' || format('{{:,}}', comments) || chr(10)
          || '  Total Data:     ' || {_bytes('bytes')} || chr(10)
          || '  Total Time:     ' || {_time('elapsed')} AS summary
        FROM (SELECT channel, count(*) FILTER (ok) AS videos,
                CAST(coalesce(sum(k) FILTER (ok), 0) AS BIGINT) AS comments,
                CAST(coalesce(sum(k * k * (event_id % 97) * 64) FILTER (ok), 0) AS BIGINT)
                  AS bytes,
                sum(sec) AS elapsed
              FROM ({_EVENTS}) GROUP BY 1)""",
    "csv_cells": """
        SELECT doc_id::VARCHAR AS id, text, CASE WHEN lang = 'en' THEN '' ELSE lang END AS lang,
          (n_chars > 500)::VARCHAR AS long, (n_chars / 4::DOUBLE)::VARCHAR AS quarter,
          '[' || doc_id || ',' || n_chars || ']' AS pair,
          '{"source":"' || source || '","none":null}' AS origin
        FROM documents""",
    "export_json": _exported("jsonl"),
    "export_csv": _exported("csv"),
    "export_parquet": _exported("parquet"),
    "export_rerun": f"SELECT * FROM ({_exported('jsonl')}) WHERE channel_key <> 'talk1'",
    "export_sizes": f"""
        SELECT channel_key, CAST(sum(strlen('{{"cid":"' || cid || '","text":' || to_json(text)
            || ',"text_length":' || text_length || ',"time":"' || turn || ' days ago","author":"@'
            || role || '","channel":"UC' || conv_id || '","votes":"' || votes || '","replies":"'
            || replies || '","photo":"https://img.example/a/' || role || '","heart":' || heart
            || ',"reply":' || reply || ',"scraped_at":"' || scraped_at
            || '","source":"{SOURCE}","file_name":"' || file_name || '"}}') + 1) AS BIGINT)
          AS bytes
        FROM ({_exported('jsonl', ', turn, role, conv_id')}) GROUP BY 1""",
    "export_videos_csv": f"""
        SELECT ltrim(channel_ref, '@') AS channel_key, "order", video_id, title,
          title_length::VARCHAR AS title_length, nullif(thumbnail_url, '') AS thumbnail_url,
          nullif(channel_id, '') AS channel_id, view_count::VARCHAR AS view_count,
          nullif(view_count_raw, '') AS view_count_raw, nullif(length, '') AS length,
          length_minutes, url FROM ({_VIDEOS})""",
    "videos_documents": f"""
        SELECT ltrim(channel_ref, '@') AS channel_key, 1 AS part, NULL AS line,
          "order" = 1 AS begins, video_id, title, title_length, channel_id, view_count,
          view_count_raw, length, length_minutes, thumbnail_url, url, "order" FROM ({_VIDEOS})
        UNION ALL
        SELECT ltrim(channel_ref, '@'), part, CASE part
            WHEN 0 THEN '{{' || chr(10) || '  "channel_id": "' || channel_ref || '",' || chr(10)
              || '  "total_videos": ' || n || ',' || chr(10) || '  "videos": ['
            ELSE '    }}' || chr(10) || '  ],' || chr(10) || '  "scraped_at": "'
              || strftime(TIMESTAMP '2023-11-14 22:13:20' + to_seconds(last), '%Y-%m-%dT%H:%M:%S')
              || '+00:00",' || chr(10) || '  "source": "{SOURCE}"' || chr(10) || '}}' END,
          NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
        FROM (SELECT channel_ref, count(*) AS n FROM ({_VIDEOS}) GROUP BY 1)
          JOIN (SELECT '@' || replace(p_brand, '#', '-') AS channel_ref,
                  max(p_partkey // 750) AS last FROM part GROUP BY 1) USING (channel_ref),
          (VALUES (0), (2)) parts(part)""",
    "observed_comments": """
        SELECT count(*) AS comments, true AS by_batch FROM conversations
        WHERE NOT ((conv_id % 9 = 4 OR conv_id % 13 = 5) AND turn BETWEEN 3 AND 5)""",
    "streamed_totals": f"""
        SELECT '@talk' || (conv_id % 5) AS channel_ref, count(*) AS comments,
          CAST(sum(length(text)) AS BIGINT) AS characters, count(*) FILTER ({_HEART}) AS hearts
        FROM ({_KEPT}) GROUP BY 1""",
}


_ORACLE["streamed_comments"] = _ORACLE["comments_flat"]


def oracle() -> dict[str, str]:
    return dict(_ORACLE)
