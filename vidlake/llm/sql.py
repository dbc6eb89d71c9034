"""What the registered queries must return, as DuckDB SQL, where SQL can say it."""

from __future__ import annotations

_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SOLID = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_OP3 = f"""
with bw as (select cast(item_id as varchar) item,
        regexp_extract_all(translate(coalesce(text, ''), {_UP}, {_LOW}), {_ALNUM}) w from benchmark),
windows as (select distinct item, len(w) n, array_to_string(w, ' ') k from bw
        where len(w) between 1 and 9
    union select distinct item, 10, array_to_string(w[i:i + 9], ' ')
        from (select item, w, unnest(range(1, len(w) - 8)) i from bw where len(w) >= 10)),
dw as (select rowid r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), {_UP}, {_LOW}), {_ALNUM}) w
    from (select row_number() over () rowid, * from documents)),
sizes as (select distinct n from windows),
places as (select r, i, n, array_to_string(w[i:i + n - 1], ' ') k
    from (select r, w, n, unnest(range(1, len(w) - n + 2)) i from dw, sizes where len(w) >= n)),
found as (select r, i, n, item from places join windows using (n, k)),
hits as (select r, count(distinct p) n_hit
    from (select r, unnest(range(i, i + n)) p from found) group by r),
items as (select r, count(*) n_items, string_agg(item, ',' order by item) s
    from (select distinct r, item from found) group by r)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit,
    coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256,
    coalesce(n_hit, 0) > 0 contaminated
from dw left join hits using (r) left join items using (r)
"""

_OP4 = f"""
with dw as (select r, doc_id, regexp_extract_all(coalesce(text, ''), {_SOLID}) w
    from (select row_number() over () r, * from documents)),
places as (select r, i, array_to_string(w[i:i + 34], ' ') k
    from (select r, w, unnest(range(1, len(w) - 33)) i from dw where len(w) >= 35)),
again as (select k from places group by k having count(*) > 1),
gone as (select distinct r, unnest(range(i, i + 35)) p from places join again using (k)),
words as (select r, unnest(w) word, unnest(range(1, len(w) + 1)) p from dw),
kept as (select r, count(*) n, string_agg(word, ' ' order by p) s
    from words anti join gone using (r, p) group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n, 0) as bigint) n_removed,
    sha256(coalesce(s, '')) kept_sha256
from dw left join kept using (r)
"""

_OP5 = f"""
with recursive dw as (select doc_id,
        regexp_extract_all(translate(coalesce(text, ''), {_UP}, {_LOW}), {_SOLID}) w
    from documents),
sets as (select distinct doc_id, array_to_string(w, ' ') k from dw where len(w) in (1, 2)
    union select distinct doc_id, array_to_string(w[i:i + 2], ' ')
        from (select doc_id, w, unnest(range(1, len(w) - 1)) i from dw where len(w) >= 3)),
sizes as (select doc_id, count(*) n from sets group by doc_id),
common as (select x.doc_id a, y.doc_id b, count(*) c from sets x join sets y using (k)
    where x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from common join sizes sa on a = sa.doc_id join sizes sb on b = sb.doc_id
    where 100 * c >= 90 * (sa.n + sb.n - c)),
reach as (select doc_id, doc_id other from documents
    union select reach.doc_id, links.b from reach join links on reach.other = links.a)
select dw.doc_id, coalesce(any_value(n), 0) n_shingles, min(other) component_id
from dw join reach using (doc_id) left join sizes using (doc_id) group by dw.doc_id
"""

_OP6 = """
with calls as (select conv_id, turn, 'call_' || conv_id || '_' || turn call_id,
        ['search', 'lookup', 'count'][cast((conv_id + turn) % 3 as int) + 1] as tool, text,
        case when turn >= 2 and (turn // 2) % 4 <> 0 then turn - 2 end as before
    from conversations where role = 'assistant'),
results as (select conv_id, turn, 'call_' || conv_id || '_' || (turn - 1) call_id, text
    from conversations where role = 'user' and turn > 0),
chain as (select c.*, p.call_id is not null as has
    from calls c left join calls p on c.conv_id = p.conv_id and c.before = p.turn),
leveled as (select c.*, case when not c.has then 0 when not p.has then 1 when not q.has then 2
        else 3 end depth
    from chain c left join chain p on c.has and p.conv_id = c.conv_id and p.turn = c.before
    left join chain q on p.has and q.conv_id = p.conv_id and q.turn = p.before),
checked as (select *, list_concat(case tool
        when 'lookup' then list_sort(list_concat(
            case when before is null then ['missing after'] else [] end,
            case when text is null then ['missing text'] else [] end, ['unknown turn']))
        when 'count' then list_concat(
            case when before is null then [] else ['unknown after'] end,
            case when text is null then [] else ['unknown text'] end)
        else case when text is null then ['missing text'] else [] end end,
        case when before is not null and not has
            then ['no call call_' || conv_id || '_' || before] else [] end) problems
    from leveled),
full_ as (select coalesce(c.conv_id, r.conv_id) conv_id, coalesce(c.call_id, r.call_id) call_id,
        coalesce(c.turn, r.turn) turn, case when c.call_id is not null then depth end depth,
        tool, c.text, before, c.turn cturn, coalesce(problems, []) problems, r.text content,
        case when c.call_id is null then 'orphan' when len(problems) > 0 then 'invalid'
            when r.call_id is null then 'open' else 'done' end status,
        c.call_id is not null called
    from checked c full join results r on c.conv_id = r.conv_id and c.call_id = r.call_id)
select conv_id, call_id, turn, cast(depth as bigint) depth, status,
    array_to_string(problems, '; ') problems,
    sha256('{"arguments":' || case when not called then 'null' else '{' || concat_ws(',',
            case when before is not null
                then '"after":' || to_json('$call_' || conv_id || '_' || before) end,
            case when text is not null then '"text":' || to_json(text) end,
            '"turn":' || cturn) || '}' end
        || ',"depth":' || coalesce(cast(depth as varchar), 'null')
        || ',"id":' || to_json(call_id) || ',"name":' || coalesce(to_json(tool), 'null')
        || ',"problems":' || to_json(problems)
        || ',"result":' || coalesce(to_json(content), 'null')
        || ',"status":' || to_json(status) || '}') json_sha256
from full_
"""

_OP7 = f"""
with rows_ as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
lines as (select r, doc_id, unnest(string_split(t, chr(10))) line,
        unnest(range(1, len(string_split(t, chr(10))) + 1)) p from rows_),
keyed as (select *, translate(trim(line, {_BLANKS}), {_UP}, {_LOW}) k from lines),
shared as (select k, min(doc_id) first from keyed where length(k) >= 10
    group by k having count(distinct doc_id) > 1),
marked as (select r, p, line, first is not null and doc_id <> first as gone
    from keyed left join shared using (k)),
kept as (select r, count(*) n_lines, count(*) filter (gone) n_dropped,
        coalesce(string_agg(line, chr(10) order by p) filter (not gone), '') s
    from marked group by r)
select doc_id, n_lines, n_dropped, sha256(s) kept_sha256 from rows_ join kept using (r)
"""

_OP8 = rf"""
with parts as (select page_id, case when instr(url, '://') > 0
        then substr(url, instr(url, '://') + 3) else '' end rest from pages),
places as (select page_id,
        translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), {_UP}, {_LOW}) host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path from parts),
rules(rule, rhost, rpath, verdict) as (values
    ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
    ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
    ('com/de/', 'com', '/de/', 'block')),
best as (select page_id, arg_max(rule, length(rule)) rule, arg_max(verdict, length(rule)) verdict
    from places join rules on (host = rhost or ends_with(host, '.' || rhost))
        and starts_with(path, rpath) group by page_id)
select page_id, host, path, rule, coalesce(verdict, case when regexp_matches(host || path,
    '^([^/]*\.)?(ads-track|spam-farm)\.') then 'block' else 'allow' end) verdict
from places left join best using (page_id)
"""


_OP11 = rf"""
with pieces as (select row_number() over () p, lang, regexp_extract_all(piece, '[^\x20\x09]+') w
    from (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), {_UP}, {_LOW}), '[.,;:!?\x0A-\x0D]')) piece
        from documents)),
sizes as (select lang, cast(sum(len(w)) as bigint) n from pieces group by lang),
grams as (select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase, count(*) f from (
        select lang, w, k, unnest(range(1, len(w) - k + 2)) i
        from pieces, (select unnest([1, 2, 3, 4]) k) where len(w) >= k)
    group by all having count(*) >= 30),
parts as (select *, string_split(phrase, ' ') w from grams),
cuts as (select lang, phrase, k, f, unnest(range(1, k)) c, w from parts where k > 1),
scored as (select cuts.lang, cuts.phrase, c, cuts.f a, x.f l, y.f r,
        cast(2000000 as hugeint) * cuts.f // (x.f + y.f) score
    from cuts join grams x on x.lang = cuts.lang and x.phrase = array_to_string(w[:c], ' ')
    join grams y on y.lang = cuts.lang and y.phrase = array_to_string(w[c + 1:], ' ')),
best as (select * from scored qualify row_number() over (
    partition by lang, phrase order by score, c) = 1),
around as (select lang, phrase, max(f) longer from (
        select lang, f, array_to_string(w[i:i + m - 1], ' ') phrase
        from (select lang, f, w, m, unnest(range(1, k - m + 2)) i
            from parts, (select unnest([2, 3]) m) where m < k))
    group by all),
ranked as (select lang, row_number() over (partition by lang
        order by score desc, a desc, encode(phrase)) rank, phrase, a, l, r, score
    from best left join around using (lang, phrase)
    where longer is null or cast(100 as hugeint) * longer < 80 * a)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) score
from ranked join sizes using (lang) where rank <= 2000
"""

_NEAREST = """
    select r, p, min(d * 64 + i) % 64 i, min(d * 64 + i) // 64 d from (
        select r, cells.p, i, list_sum(list_transform(range(1, len(x) + 1),
            lambda j: (x[j] - e[j]) * (x[j] - e[j]))) d
        from cells join {} books on cells.p = books.p) group by r, p
"""
_MOVED = """
    select p, i, coalesce(m.e, b.e) e from {books} b left join (
        select p, i, list(v order by j) e from (
            select p, i, j, cast(floor(sum(x[j]) / count(*)) as bigint) v from (
                select p, i, x, unnest(range(1, len(x) + 1)) j
                from {found} join cells using (r, p)) group by p, i, j)
        group by p, i) m using (p, i)
"""
_OP12 = f"""
with kept as (select row_number() over (order by vec_id) r, vec_id, label, list_transform(
        embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
    where len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cells as (select r, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] x
    from (select r, v, unnest(range(16)) p from kept)),
books0 as (select p, r - 1 i, x e from cells where r <= 64),
found0 as ({_NEAREST.format('books0')}),
books1 as ({_MOVED.format(books='books0', found='found0')}),
found1 as ({_NEAREST.format('books1')}),
books2 as ({_MOVED.format(books='books1', found='found1')}),
found2 as ({_NEAREST.format('books2')}),
coded as (select r, string_agg(printf('%02x', i), '' order by p) code,
        cast(sum(d) as bigint) error from found2 group by r),
hash as (select sha256(string_agg(array_to_string(e, ','), ',' order by p, i)) codebooks_sha256
    from books2)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error,
    codebooks_sha256
from coded join kept using (r), hash
"""


def oracle() -> dict[str, str]:
    return {
        "op3_decontamination": _OP3, "op4_substring_dedup": _OP4, "op5_jaccard_join": _OP5,
        "op6_tool_calls": _OP6, "op7_line_dedup": _OP7, "op8_url_filter": _OP8,
        "op11_phrase_mining": _OP11, "op12_vector_codes": _OP12,
    }
