"""DuckDB SQL for the queries that SQL can express, over the whole tables.

op9 has none: a row for every byte is too slow on whole tables; its test is a plain version on a small fixture.
"""

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4 = f"""
with d as (select doc_id, {_WORDS} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as k from d, unnest(range(1, greatest(len(w) - 48, 1))) t(i)),
least_doc as (select k, min(doc_id) as first from win group by k),
gone as (select distinct doc_id, j from win join least_doc using (k), unnest(range(i, i + 50)) t(j) where doc_id > first),
word as (select doc_id, j, w[j] as x from d, unnest(range(1, len(w) + 1)) t(j)),
kept as (select doc_id, string_agg(x, ' ' order by j) as s, count(*) as n from word anti join gone using (doc_id, j) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(s, '')) as kept_sha256 from d left join kept using (doc_id)"""

OP5 = f"""
with d as (select doc_id, {_PLAIN} as w from documents),
b as (select cast(item_id as varchar) as item_id, {_PLAIN} as w from benchmark),
win as (select distinct item_id, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as k, least(13, len(w)) as n from b, unnest(range(1, greatest(1, len(w) - 12) + 1)) t(i) where len(w) > 0),
size as (select distinct n from win),
own as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as k from d, size, unnest(range(1, greatest(len(w) - n + 2, 1))) t(i)),
hit as (select o.doc_id, o.i, o.n, item_id from own o join win using (k, n)),
word as (select doc_id, count(distinct j) as n_hit from hit, unnest(range(i, i + n)) t(j) group by doc_id),
whose as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as s from hit group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join word using (doc_id) left join whose using (doc_id)"""

OP7 = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as k from d, unnest(range(1, greatest(1, len(w) - 3) + 1)) t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.k = b.k and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
reach as (select doc_id, doc_id as other from documents union select r.doc_id, l.b from reach r join link l on l.a = r.other),
top as (select doc_id, min(other) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id from top left join n using (doc_id)"""

_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP8 = f"""
with d as (select doc_id, coalesce('=' || source, '') as host, coalesce(text, '') as text, {_WORDS} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {_TRIM.format('x')} <> '') as lines from documents),
win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as k from d, unnest(range(1, greatest(len(w) - 6, 1))) t(i)),
again as (select doc_id, k from win group by doc_id, k having count(*) > 1),
rep as (select doc_id, count(distinct j) as n from win join again using (doc_id, k), unnest(range(i, i + 8)) t(j) group by doc_id),
once as (select host, text, min(doc_id) as doc_id from d group by host, text),
line as (select doc_id, host, i, translate(lower({_TRIM.format('lines[i]')}), '0123456789', '0000000000') as x, len(regexp_extract_all(lines[i], '[^\\x20\\x09-\\x0D]+')) as words from d, unnest(range(1, len(lines) + 1)) t(i)),
cnt as (select host, x, count(distinct doc_id) as docs from line semi join once using (doc_id) group by host, x),
hosts as (select host, count(*) as n from once group by host),
common as (select host, x from cnt join hosts using (host) where docs > 20 and docs > 0.001 * n),
gone as (select doc_id, sum(words) as gone from line semi join common using (host, x) group by doc_id),
f as (select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, len(w) - coalesce(gone, 0) as n_left from d left join rep using (doc_id) left join gone using (doc_id)),
g as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f)
select *, not base_failed and n_left >= 20 and n_left >= 0.3 * n_words as kept from g"""

OP12 = f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, i, lines[i] as x, translate({_TRIM.format('lines[i]')}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from d, unnest(range(1, len(lines) + 1)) t(i)),
f as (select k, max(doc_id) as holder from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5)
select doc_id, count(*) as n_lines, count(*) filter (where doc_id <> holder) as n_dropped, sha256(coalesce(string_agg(x, chr(10) order by i) filter (where holder is null or doc_id = holder), '')) as kept_sha256
from l left join f using (k) group by doc_id"""

ORACLES = {"op4_substring_dedup": OP4, "op5_decontaminate": OP5, "op7_jaccard_join": OP7, "op8_quality_rules": OP8, "op12_line_dedup": OP12}
