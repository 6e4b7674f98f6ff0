"""DuckDB SQL for the queries that it can express over whole tables."""

from __future__ import annotations

from ensemblecast.llm import line_dedup

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, {_WORDS} as ws from documents),
w as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as p from d),
g as (select r, p, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o || ' ' || lead(w, 4) over o as k from w window o as (partition by r order by p)),
rep as (select r, p from (select r, p, count(*) over (partition by r, k) as c from g where k is not null) where c > 1),
cov as (select r, count(distinct p + o) as n from rep cross join (select unnest(range(0, 5)) as o) s group by r),
l as (select r, count(*) as n, count(distinct line) as u from (select r, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
m as (select doc_id, t, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
 coalesce(l.n, 0) as n_lines, coalesce(l.n - l.u, 0) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words from d left join cov on d.r = cov.r left join l on d.r = l.r),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not (base_failed or 10 * n_symbols > 2 * n_words or 2 * n_dup_lines > n_lines or word_chars < 2 * n_words or word_chars > 15 * n_words
      or length(regexp_replace(t, '[^A-Z]', '', 'g')) / greatest(1, length(regexp_replace(t, '[^A-Za-z]', '', 'g'))) > 0.5) as kept from b
"""

JACCARD = f"""
with recursive d as (select row_number() over () as r, doc_id, {_WORDS} as ws from documents),
s as (select distinct r, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as k from d),
z as (select r, count(*) as n from s group by r),
p as (select a.r as x, b.r as y, count(*) as n from s a join s b on a.k = b.k and a.r < b.r group by all),
l as (select x, y from p join z a on a.r = x join z b on b.r = y where 5 * p.n >= 4 * (a.n + b.n - p.n)),
e as (select x, y from l union all select y, x from l),
reach as (select r as a, r as b from d union select reach.a, e.y from reach join e on reach.b = e.x)
select d.doc_id, min(o.doc_id) as class_id, (select count(*) from e where e.x = d.r) as n_links from d join reach on d.r = reach.a join d o on o.r = reach.b group by d.r, d.doc_id
"""

SUBSTRING = f"""
with d as (select row_number() over () as r, doc_id, coalesce(doc_id, 9223372036854775807) as o, {_WORDS} as ws from documents),
g as (select r, o, p, md5(array_to_string(ws[p:p + 49], ' ')) as k from (select r, o, ws, unnest(range(1, len(ws) - 48)) as p from d where len(ws) >= 50)),
h as (select r, p from (select r, p, o, min(o) over (partition by k) as first from g) where first < o),
c as (select distinct r, p + i as p from h cross join (select unnest(range(0, 50)) as i) s),
w as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as p from d),
k as (select w.r, string_agg(w, ' ' order by w.p) as body, count(*) as n from w anti join c on w.r = c.r and w.p = c.p group by w.r)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(body, '')) as kept_sha256 from d left join k on d.r = k.r
"""

FILL = """
with h as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
d as (select doc_id, t, length(t) as n, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from h),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
 case when n = 0 or h3 % 100 >= 90 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from d),
p as (select *, substring(t, 1, a) as prefix, substring(t, a + 1, b - a) as middle, substring(t, b + 1) as suffix from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
 sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
 sha256(t) as restored_sha256 from p
"""


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::varchar) || ':' || {f}::varchar, '-')" for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: crc32 of the digits of a doc_id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
 lambda c, b: list_reduce(range(0, 8), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)), xor(c, b)), 4294967295::bigint))"""

MERKLE = f"""
with recursive
d as (select doc_id, coalesce('=' || lang, '-') as tree, {_leaf("text")} as leaf,
 case when doc_id is null or {_CRC} % 3 = 0 then {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as other from documents),
l as (select *, row_number() over () as r, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as size from d),
up as (select tree, 0 as level, pos, leaf as digest, size from l
 union all select tree, level + 1, pos // 8, sha256(string_agg(digest, '' order by pos)), (size + 7) // 8 from up where size > 1 group by tree, level, pos // 8, size),
g as (select tree, level as height, digest as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as size from up where size = 1),
top as (select 0 as level, pos, subroot as digest, size from g
 union all select level + 1, pos // 8, sha256(string_agg(digest, '' order by pos)), (size + 7) // 8 from top where size > 1 group by level, pos // 8, size),
n as (select tree, level, pos, list(digest) over w as run from up where size > 1
 window w as (partition by tree, level, pos // 8 order by pos rows between unbounded preceding and unbounded following)),
t as (select level, pos, list(digest) over w as run from top where size > 1 window w as (partition by level, pos // 8 order by pos rows between unbounded preceding and unbounded following)),
p as (select l.r, n.level, (n.pos % 8)::int as slot, n.run from l join n on n.tree = l.tree and n.pos = l.pos // (8 ** n.level)::bigint
 union all select l.r, g.height + t.level, (t.pos % 8)::int, t.run from l join g on g.tree = l.tree join t on t.pos = g.pos // (8 ** t.level)::bigint),
s as (select r, level, coalesce(array_to_string(run[1:slot], ''), '') as before, coalesce(array_to_string(run[slot + 2:], ''), '') as after from p),
f as (select r, 0 as level, coalesce(other, leaf) as node from l
 union all select f.r, f.level + 1, sha256(before || node || after) from f join s on s.r = f.r and s.level = f.level),
e as (select r, arg_max(node, level) as folded from f group by r),
q as (select r, string_agg(before || after, '' order by level) as siblings from s group by r)
select doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) as proof_sha256, folded as folded_root, folded = root as verified
from l join g on g.tree = l.tree join e on e.r = l.r left join q on q.r = l.r cross join (select digest as root from top where size = 1) o
"""

SQL = {
    "op4_quality": QUALITY,
    "op6_line_dedup": line_dedup.passage_sql(),
    "op7_jaccard_join": JACCARD,
    "op8_substring_dedup": SUBSTRING,
    "op11_fill_in_middle": FILL,
    "op13_merkle": MERKLE,
}
