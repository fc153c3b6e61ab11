"""DuckDB SQL of the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from . import license_scan, url_filter

_LOW = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW.format(x="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
with d as (select doc_id, {_WORDS} as ws from documents),
i as (select cast(item_id as varchar) as item, {_WORDS} as ws from benchmark where text is not null),
iw as (select distinct item, n, array_to_string(ws[s:s + n - 1], ' ') as g from (select item, ws, least(len(ws), 13) as n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) as s from i where len(ws) > 0)),
dw as (select doc_id, s, n, array_to_string(ws[s:s + n - 1], ' ') as g from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as s from d, (select distinct n from iw) where len(ws) >= n)),
hit as (select doc_id, s, n, item from dw join iw using (n, g)),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hit) group by doc_id),
f as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hit group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(ws), false) as contaminated
from d left join h using (doc_id) left join f using (doc_id)
"""

_CONTROLS = "regexp_extract_all({x}, '<\\\\*(?:s>|/s>|\\|role\\|>|\\|text\\|>)|\\[\\\\*/?INST\\]')"
_ESCAPED = "length({x}) + len(" + _CONTROLS + ")"

CHAT = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said, coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as loss,
 sum(20 + {_ESCAPED.format(x="role")} + {_ESCAPED.format(x="text")} + case when role = 'user' then 13 else 0 end) + 3 as chars from t group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, chars::bigint as formatted_chars from g
"""

_SPACED = "translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')"


def _alike(a: str, b: str) -> str:
    """How many first elements two lists have in common."""
    same = f"list_transform(list_zip({a}, {b}), lambda z: coalesce(z[1] = z[2], false))"
    return f"case when list_position({same}, false) > 0 then list_position({same}, false) - 1 else len({same}) end"


LINE_DEDUP = f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents where text <> ''),
w as (select doc_id, pos, line, len(list_filter(string_split({_SPACED}, ' '), lambda x: x <> '')) as n from l),
c as (select doc_id, pos, line, sum(n) over (partition by doc_id order by pos) as cum, row_number() over (partition by doc_id order by pos) - 1 as rk from w where n > 0),
g as (select doc_id, list(line order by rk) as ls, list(pos order by rk) as ps from c group by doc_id),
r as (select doc_id, rk as fin, cum, min(rk) over k as start, string_agg(line, chr(10)) over k as run from c window k as (partition by doc_id order by cum range between 49 preceding and current row)),
o as (select *, first_value(doc_id) over f as d0, first_value(start) over f as s0, first_value(fin) over f as f0 from r where cum >= 50 window f as (partition by run order by doc_id, start, fin rows between unbounded preceding and unbounded following)),
x as (select distinct doc_id, d0, start - s0 as shift, unnest(range(case when doc_id = d0 then greatest(start, f0 + 1) else start end, fin + 1)) as rk from o where not (doc_id = d0 and start = s0 and fin = f0)),
i as (select doc_id, d0, shift, min(rk) as lo, max(rk) as hi from (select *, rk - row_number() over (partition by doc_id, d0, shift order by rk) as island from x) group by doc_id, d0, shift, island),
e as (select i.*, a.ps as ps, {_alike("list_reverse(a.ls[:lo])", "list_reverse(b.ls[:lo - shift])")} as back, {_alike("a.ls[hi + 2:]", "b.ls[hi - shift + 2:]")} as ahead from i join g a on a.doc_id = i.doc_id join g b on b.doc_id = d0),
y as (select distinct doc_id, unnest(ps[lo - case when doc_id = d0 then least(back, greatest(0, lo - 1 - hi + shift)) else back end + 1:hi + ahead + 1]) as pos from e),
k as (select doc_id, string_agg(line, chr(10) order by pos) as text from l where (doc_id, pos) not in (select doc_id, pos from y) group by doc_id),
m as (select doc_id, count(*) as n, string_agg(cast(pos as varchar), ',' order by pos) as cut from y group by doc_id)
select d.doc_id as doc_id, case when m.n is null then d.text else coalesce(k.text, '') end as text, case when d.text <> '' then len(string_split(d.text, chr(10))) else 0 end::int as n_lines,
 (case when d.text <> '' then len(string_split(d.text, chr(10))) else 0 end - coalesce(m.n, 0))::int as kept_lines, coalesce(cut, '') as dropped_lines from documents d left join k using (doc_id) left join m using (doc_id)
"""

FILL_IN_MIDDLE = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
h as (select doc_id, t, length(t)::bigint as n, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
 case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substr(t, 1, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
 sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from p
"""

#: The crc32 of a string whose letters have one or two bytes: a table of 256 remainders, then one step a byte.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"
_BYTES = "flatten(list_transform(string_split({x}, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end))"
_CRC = f"xor(list_reduce(list_concat([4294967295::bigint], {_BYTES}), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295)"

SPELLING = f"""
with recursive r as (select doc_id, {_LOW.format(x="unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+'))")} as run from documents),
o as (select doc_id, run, count(*) as n from r where length(run) >= 6 group by doc_id, run),
h as (select run, n, {_CRC.format(x="coalesce(doc_id::varchar, '') || ':' || run")} as h from o, (select {_CRC_TABLE} as tbl)),
c as (select case when h % 199 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, sum(n) as n from h group by 1),
v as materialized (select word, n::bigint as n from c where length(word) >= 6 and n >= 5),
x as materialized (select word, i, word[:i] || word[i + 2:] as short from (select word, unnest(range(length(word))) as i from v)),
p as (select distinct a, b from (select x.word as a, y.word as b from x join x y on x.short = y.short and x.i = y.i and x.word <> y.word
 union all select x.word, v.word from x join v on v.word = x.short union all select v.word, x.word from x join v on v.word = x.short)),
b as (select a as word, count(*) as n_near, min_by(v.word, (-v.n, v.word)) as near, max(v.n) as near_n from p join v on v.word = p.b group by a),
f as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when near_n >= 5 * n then near end as form, case when near_n >= 5 * n then near_n end as form_n from v left join b using (word)),
w as (select word, word as at, form as next from f union all select w.word, f.word, f.form from w join f on f.word = w.next)
select word, form, w.at as root, n, n_near, form_n from f join w using (word) where w.next is null
"""


def sql() -> dict[str, str]:
    return {
        "op2_chat_format": CHAT,
        "op3_license_scan": license_scan.oracle_sql(),
        "op4_line_dedup": LINE_DEDUP,
        "op7_url_filter": url_filter.oracle_sql(),
        "op9_benchmark_decontamination": DECONTAMINATION,
        "op12_fill_in_middle": FILL_IN_MIDDLE,
        "op13_spelling_variants": SPELLING,
    }
