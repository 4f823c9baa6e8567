"""SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"

LINE_DEDUP = r"""
with raw as (
    select row_number() over () as r, doc_id, text, coalesce(doc_id, 9223372036854775807) as doc,
        case when doc_id is null then cast('0x' || substr(md5(text), 1, 15) as bigint) + 1 else 0 end as anon from documents
),
lines as (
    select r, doc, anon, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
    from raw where text is not null
),
plain as (
    select r, doc, anon, line, pos,
        regexp_replace(trim(regexp_replace(line, '[ \t\r\f\v]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') as masked
    from lines
),
tokens as (
    select *, string_split(masked, ' ') as t, len(string_split(masked, ' ')) as n
    from plain where regexp_matches(masked, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')
),
placed as (
    select r, doc, anon, pos, n, array_to_string(t[1:8], ' ') as leaf, t, cast(ceil((n - 8) / 8.0) as bigint) as w,
        case when n >= 9 and len(list_filter(t[1:8], lambda x: x <> '<*>')) >= 6 then 2 else 5 end as bar
    from tokens
),
pieces as (
    select r, doc, anon, pos, n, leaf, bar, i, case when n > 8 then array_to_string(t[9 + i * w : 8 + (i + 1) * w], ' ') else '' end as piece
    from placed, unnest(range(0, case when n > 8 then cast(ceil((n - 8) / w) as bigint) else 1 end)) as s(i)
),
seen as (
    select n, leaf, i, piece, count(distinct (doc, anon)) as docs, min((doc, anon)) as first from pieces group by n, leaf, i, piece
),
gone as (
    select p.r, p.pos from pieces p join seen s on p.n = s.n and p.leaf = s.leaf and p.i = s.i and p.piece = s.piece
    group by p.r, p.pos having 2 * count(*) filter (where s.docs >= p.bar and s.first <> (p.doc, p.anon)) >= count(*)
),
kept as (
    select l.r, string_agg(l.line, chr(10) order by l.pos) as text
    from lines l anti join gone g on l.r = g.r and l.pos = g.pos group by l.r
),
counts as (select r, count(*) as n from gone group by r)
select w.doc_id, cast(coalesce(len(string_split(w.text, chr(10))), 0) as bigint) as n_lines,
    cast(coalesce(c.n, 0) as bigint) as n_dropped, sha256(coalesce(k.text, '')) as kept_sha256
from raw w left join kept k on w.r = k.r left join counts c on w.r = c.r
"""

WARC_ROUND_TRIP = """
with p as (
    select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
),
bits as (
    select page_id, payload_bytes, array_to_string(list_transform(range(1, 41), lambda i:
        right(bin(strpos('0123456789abcdef', hex[i]) - 1 + 16), 4)), '') as b from p
),
named as (
    select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda j:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * b[5 * j + 1]::int + 8 * b[5 * j + 2]::int + 4 * b[5 * j + 3]::int
            + 2 * b[5 * j + 4]::int + b[5 * j + 5]::int]), '') as payload_digest from bits
),
best as (
    select *, first_value(page_id) over by_digest as original, row_number() over by_digest = 1 as is_response
    from named window by_digest as (partition by payload_digest order by page_id desc nulls last)
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
    case when is_response then 'response' else 'revisit' end as record_type,
    case when not is_response then original end as refers_to,
    case when is_response then true end as payload_ok
from best
"""

DECONTAMINATION = f"""
with d as (
    select row_number() over () as r, doc_id,
        regexp_extract_all(coalesce(translate(text, '{UPPER}', '{LOWER}'), ''), '{WORD}') as w from documents
),
b as (
    select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') as w
    from benchmark where text is not null
),
grams as (
    select distinct item_id, w[i : i + least(13, len(w)) - 1] as g
    from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)
),
sizes as (select distinct len(g) as k from grams),
windows as (
    select r, i, k, w[i : i + k - 1] as g from (
        select d.r, d.w, s.k, unnest(range(1, len(d.w) - s.k + 2)) as i from d, sizes s where len(d.w) >= s.k)
),
found as (select distinct v.r, v.i, v.k, x.item_id from windows v join grams x on v.g = x.g),
hit as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + k)) as j from found) group by r),
items as (
    select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
    from (select distinct r, item_id from found where item_id is not null) group by r
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
    cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit h on d.r = h.r left join items i on d.r = i.r
"""

SUBSTRING_DEDUP = f"""
with d as (
    select row_number() over (order by doc_id nulls last) as r, doc_id,
        regexp_extract_all(coalesce(text, ''), '{SPACED}') as w from documents
),
windows as (
    select r, i, array_to_string(w[i : i + 19], ' ') as g
    from (select r, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)
),
later as (select r, i from (select r, i, row_number() over (partition by g order by r, i) as k from windows) where k > 1),
gone as (select distinct r, unnest(range(i, i + 20)) as j from later),
words as (select r, unnest(w) as word, generate_subscripts(w, 1) as j from d),
kept as (
    select x.r, string_agg(x.word, ' ' order by x.j) as text, count(*) as n
    from words x anti join gone g on x.r = g.r and x.j = g.j group by x.r
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(k.n, 0) as bigint) as n_removed,
    sha256(coalesce(k.text, '')) as kept_sha256
from d left join kept k on d.r = k.r
"""

COLLOCATIONS = f"""
with p as (
    select coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents
),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
words as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
grams as (
    select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase
    from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, unnest(range(1, 6)) as s(m) where len(w) >= m)
),
f as (select lang, m, phrase, count(*) as f from grams group by lang, m, phrase having count(*) >= 100),
cuts as (
    select lang, m, phrase, f as a, k, array_to_string(string_split(phrase, ' ')[: k], ' ') as x,
        array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') as y
    from (select *, unnest(range(1, m)) as k from f where m > 1)
),
scored as (
    select c.*, l.f as l, r.f as r, n.n, cast((1000::hugeint * c.a * n.n) // (l.f::hugeint * r.f) as bigint) as score
    from cuts c join f l on c.lang = l.lang and c.x = l.phrase join f r on c.lang = r.lang and c.y = r.phrase
        join words n on c.lang = n.lang
),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (
    select * from best b where not exists (
        select 1 from f g where g.lang = b.lang and g.m > b.m and contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ')
            and 100 * g.f >= 100 * b.a)
)
select lang, rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= 2000
"""

_ROUND = """
used{i} as (
    select n.part, n.n.e as entry, i, cast(floor(cast(sum(p.x[i]) as double) / count(*)) as bigint) as c
    from near{j} n join parts p on n.r = p.r and n.part = p.part, unnest(range(1, len(p.x) + 1)) as s(i) group by n.part, n.n.e, i
),
book{i} as (
    select b.part, b.entry, coalesce(u.x, b.x) as x from book{j} b
        left join (select part, entry, list(c order by i) as x from used{i} group by part, entry) u on b.part = u.part and b.entry = u.entry
),
near{i} as (
    select r, p.part, min(struct_pack(d := list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) ** 2)), e := b.entry)) as n
    from parts p join book{i} b on p.part = b.part group by r, p.part
),"""

CODEBOOKS = """
with v as (
    select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
    from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
parts as (select r, p as part, x[len(x) // 16 * p + 1 : len(x) // 16 * (p + 1)] as x from v, unnest(range(16)) as s(p)),
book0 as (
    select part, entry, x from parts join (
        select r, row_number() over (order by vec_id) - 1 as entry from v where vec_id is not null qualify entry < 64) using (r)
),
near0 as (
    select r, p.part, min(struct_pack(d := list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) ** 2)), e := entry)) as n
    from parts p join book0 b on p.part = b.part group by r, p.part
),
""" + _ROUND.format(i=1, j=0) + _ROUND.format(i=2, j=1) + """
final as (
    select r, cast(sum(n.d) as bigint) as error, string_agg(lpad(lower(hex(n.e)), 2, '0'), '' order by part) as code from near2 group by r
),
digest as (
    select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from book2
),
sums as (select label, cast(sum(error) as bigint) as label_error from final join v using (r) group by label)
select v.vec_id, f.code, f.error, s.label_error, d.codebooks_sha256
from v join final f using (r) join sums s on v.label is not distinct from s.label, digest d
"""

ORACLES = {
    "op1_line_dedup": LINE_DEDUP,
    "op2_warc_revisits": WARC_ROUND_TRIP,
    "op5_decontamination": DECONTAMINATION,
    "op9_substring_dedup": SUBSTRING_DEDUP,
    "op12_codebooks": CODEBOOKS,
    "op13_collocations": COLLOCATIONS,
}
