"""SQL that the queries must equal, where SQL can express them."""

from __future__ import annotations

# A base32 digit is five bits: four of them to every five hexadecimal digits.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v{chunk} >> {shift}) & 31), 1)"
    for chunk in range(8)
    for shift in (15, 10, 5, 0)
)
_CHUNKS = ", ".join(f"cast('0x' || substr(h, {5 * chunk + 1}, 5) as integer) as v{chunk}" for chunk in range(8))

OP1 = f"""
with p as (
    select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h,
        row_number() over (partition by coalesce(html, '') order by page_id desc nulls last) as r,
        first_value(page_id) over (partition by coalesce(html, '') order by page_id desc nulls last) as last_page
    from pages
), d as (select *, {_CHUNKS} from p)
select page_id, octet_length(encode(payload)) as payload_bytes, {_BASE32} as payload_digest,
    case when r = 1 then 'response' else 'revisit' end as record_type,
    case when r = 1 then null else last_page end as refers_to
from d
"""

OP8 = r"""
with recursive docs as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as w
    from documents
), shingles as (
    select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ')
        else array_to_string(w[i:i + 4], ' ') end as s
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from docs where len(w) > 0)
), sizes as (select doc_id, count(*) as n from shingles group by 1),
pairs as (
    select a.doc_id as a, b.doc_id as b, count(*) as common
    from shingles a join shingles b on a.s = b.s and a.doc_id != b.doc_id group by 1, 2
), links as (
    select a, b from pairs join sizes x on a = x.doc_id join sizes y on b = y.doc_id
    where 100 * common >= 80 * (x.n + y.n - common)
), reach(doc_id, other) as (
    select doc_id, doc_id from documents
    union
    select r.doc_id, l.b from reach r join links l on r.other = l.a
), smallest as (select doc_id, min(other) as component_id from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id
from docs d join smallest using (doc_id) left join sizes using (doc_id)
"""


# CRC-32 by half bytes, the low one of each byte first. The remainders of
# the sixteen half bytes by the polynomial.
_CRC_STEPS = (
    "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,"
    " 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
)
_HALVES = "list_transform(range(1, len(h) + 1), lambda i: strpos('0123456789ABCDEF', h[i + (i % 2) * 2 - 1]) - 1)"
_CRC = (
    f"xor(list_reduce(list_transform({_HALVES}, lambda x: x::bigint), lambda c, x: "
    f"xor(c >> 4, ({_CRC_STEPS})[(xor(c, x) & 15) + 1]::bigint), 4294967295::bigint), 4294967295)"
)

OP12 = rf"""
with recursive runs as (
    select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from (
        select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as run from documents)
), counted as (
    select doc_id, run, count(*) as k, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as h from runs group by 1, 2
), hashed as (select run, k, {_CRC} as crc from counted
), slipped as (
    select k, case when crc % 97 = 0
        then substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) else run end as word from hashed
), words as (
    select word, cast(sum(k) as bigint) as n from slipped where length(word) >= 5 group by 1 having sum(k) >= 3
), shorter as (
    select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
    from (select word, unnest(range(1, length(word) + 1)) as i from words)
), near as (
    select a.word, b.word as other from shorter a join shorter b on a.i = b.i and a.rest = b.rest and a.word != b.word
    union select s.word, w.word from shorter s join words w on s.rest = w.word
    union select w.word, s.word from shorter s join words w on s.rest = w.word
), ranked as (
    select near.word, other, o.n as other_n, count(*) over (partition by near.word) as n_near,
        row_number() over (partition by near.word order by o.n desc, other) as place
    from near join words o on o.word = near.other
), forms as (
    select w.word, w.n, case when other_n >= 2 * w.n then other end as form, coalesce(n_near, 0) as n_near,
        case when other_n >= 2 * w.n then other_n end as form_n
    from words w left join ranked on ranked.word = w.word and place = 1
), followed(word, root) as (
    select word, word from forms
    union all
    select f.word, forms.form from followed f join forms on f.root = forms.word where forms.form is not null
), ends as (
    select followed.word, followed.root from followed join forms on followed.root = forms.word where forms.form is null
)
select word, form, root, n, n_near, form_n from forms join ends using (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op8_jaccard_join": OP8, "op12_spelling": OP12}
