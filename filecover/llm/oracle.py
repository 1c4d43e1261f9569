"""The operators that SQL can express, as DuckDB SQL over the driver's tables, written independently of them."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
# Lower-cases A to Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _hash60(*parts: str) -> str:
    """60 bits of an md5, as a number."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15))::bigint"


def _twice(k: int) -> str:
    """Words in windows of k words that the text holds twice."""
    return f"""select doc_id, count(distinct p)::bigint as n from (
  select doc_id, unnest(range(i, i + {k})) as p from (
    select doc_id, i, count(*) over (partition by doc_id, g) as c from (
      select doc_id, i, array_to_string(w[i:i+{k - 1}], ' ') as g
      from (select doc_id, w, unnest(range(1, len(w) - {k} + 2)) as i from tok))) where c > 1) group by 1"""


REPETITION = f"""
with tok as (select doc_id, text, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
eight as ({_twice(8)}), six as ({_twice(6)}), long as ({_twice(101)}),
lines as (select doc_id, count(*) - count(distinct l) as n
          from (select doc_id, unnest(string_split(text, chr(10))) as l from tok)
          where regexp_matches(l, '{WORD}') group by 1),
base as (select t.*, coalesce(l.n, 0)::bigint as n_dup_lines, coalesce(e.n, 0)::bigint as n_repeat_words,
                coalesce(s.n, 0) as covered, g.n is not null as too_long
         from tok t left join eight e using (doc_id) left join six s using (doc_id)
         left join long g using (doc_id) left join lines l using (doc_id)),
judged as (select *, len(w) < 20 or 100 * n_repeat_words > 30 * len(w) as base_failed from base)
select doc_id, len(w)::bigint as n_words,
       coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
       length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
       n_dup_lines, n_repeat_words, base_failed,
       not base_failed and covered <= 0.3 * len(w) and not too_long as kept
from judged"""

SHARDS = f"""
with recursive bits(b, k, v) as (
  select unnest(range(256)), 0, unnest(range(256))::ubigint
  union all
  select b, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384::ubigint) else v // 2 end from bits where k < 8),
tab as (select list(v order by b) as t from bits where k = 8),
raw as (select doc_id, encode(coalesce(text, '')) as b from documents),
summed as (
  select doc_id, (octet_length(b) + 8)::bigint as size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::ubigint),
                         lambda a, x: xor(a // 256, t[((xor(a, x) % 256) + 1)::bigint]), 4294967295::ubigint),
             4294967295::ubigint)::bigint as text_crc32
  from raw, tab),
numbered as (
  select *, row_number() over (order by {_hash60("doc_id", "size", "text_crc32")} % 4096, doc_id, size, text_crc32) - 1 as no,
         count(*) over () as n from summed),
halves as (select *, greatest(ceil(sqrt(n))::bigint, 1) as a from numbered),
walk(no, n, a, b, l, r, i) as (
  select no, n, a, (n + a - 1) // a, no // ((n + a - 1) // a), no % ((n + a - 1) // a), 0 from halves
  union all
  select no, n, a, b,
         case when i = 6 then (l * b + r) // b when i % 2 = 0 then (l + {_hash60("17", "i + 1", "r")}) % a else l end,
         case when i = 6 then (l * b + r) % b when i % 2 = 1 then (r + {_hash60("17", "i + 1", "l")}) % b else r end,
         case when i = 6 then 0 else i + 1 end
  from walk where i < 6 or l * b + r >= n)
select h.doc_id, h.size, h.text_crc32, 'rows' as law, ((w.l * w.b + w.r) % 24)::int as shard,
       ((w.l * w.b + w.r) // 24)::bigint as slot, null::int as grown_shard
from halves h join walk w on w.no = h.no and w.i = 6 and w.l * w.b + w.r < w.n"""

NEAR = f"""
with recursive tok as (select doc_id, regexp_extract_all({_LOWER}, '{WORD}') as w from documents),
grams as (
  select doc_id, array_to_string(w[i:i+3], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from tok where len(w) > 0) group by all),
sizes as (select doc_id, count(*) as n from grams group by 1),
pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from grams x join grams y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
links as (
  select a, b from pairs join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, root) as (
  select doc_id, doc_id from documents
  union
  select b, root from reach join both_ways on a = doc_id),
least as (select doc_id, min(root) as component_id from reach group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from least left join sizes using (doc_id)"""

SUFFIX = """
with raw as (select doc_id, encode(coalesce(text, '')) as t from documents),
windows as (select doc_id, i, array_slice(t, i, i + 99) as g
            from (select doc_id, t, unnest(range(1, octet_length(t) - 98)) as i from raw)),
firsts as (select doc_id, i, first_value({'d': doc_id, 'i': i}) over (partition by g order by doc_id, i) as f from windows),
gone as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from firsts where f <> {'d': doc_id, 'i': i}),
runs as (select doc_id, i, before, sum(case when i - before <= 100 then 0 else 1 end) over (partition by doc_id order by i) as run
         from gone),
spans as (select doc_id, run, min(i) as a, max(i) + 99 as z from runs group by 1, 2),
edges as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as previous from spans),
kept as (
  select doc_id, a as place, hex(array_slice(t, previous + 1, a - 1)) as h from edges join raw using (doc_id) where a - 1 > previous
  union all
  select doc_id, 9223372036854775807, hex(array_slice(t, coalesce(z, 0) + 1, octet_length(t)))
  from raw left join (select doc_id, max(z) as z from spans group by 1) using (doc_id) where coalesce(z, 0) < octet_length(t)),
texts as (select doc_id, string_agg(h, '' order by place) as h from kept group by 1),
counts as (select doc_id, sum(z - a + 1) as removed, count(*) as n from spans group by 1)
select r.doc_id, octet_length(r.t)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans,
       sha256(coalesce(unhex(h), ''::blob)) as kept_sha256
from raw r left join counts using (doc_id) left join texts using (doc_id)"""

MIXING = f"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size from documents),
per_source as (select source, sum(size)::bigint as source_size from sized group by 1),
weighed as (select *, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w,
                   source_size * 2.0::double as most from per_source),
filled as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(most) over before, 0))
            / (sum(w) over () - coalesce(sum(w) over before, 0)) as level
  from weighed window before as (order by most / w, source nulls last rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size, case when most / w <= level then most else w * (
           select level from filled f where f.most / f.w > f.level order by f.most / f.w, f.source nulls last limit 1) end as target
  from filled),
placed as (
  select s.*, t.source_size, t.target, floor(t.target)::bigint as budget,
         (sum(size) over (partition by s.source order by {_hash60("7", "coalesce(doc_id::varchar, '-')", "size")}, doc_id, size
                          rows unbounded preceding) - size)::bigint as before
  from sized s join targets t on t.source is not distinct from s.source),
cut as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from placed)
select doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::bigint as taken
from cut"""

VECTORS = """
with recursive usable as (
  select vec_id, embedding::double[] as e from embeddings
  where len(embedding) > 0 and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (select x.vec_id as a, y.vec_id as b from usable x join usable y on x.vec_id < y.vec_id and list_cosine_similarity(x.e, y.e) >= 0.9),
links as (select a, b from pairs union all select b, a from pairs),
reach(a, b) as (select vec_id, vec_id from usable union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select a, min(b) as component_id from reach group by 1),
many as (select a, count(*) as n from links group by 1)
select e.vec_id, coalesce(m.n, 0)::bigint as n_links, coalesce(l.component_id, e.vec_id) as component_id,
       e.vec_id = coalesce(l.component_id, e.vec_id) as kept
from embeddings e left join many m on m.a = e.vec_id left join least l on l.a = e.vec_id"""

SPELLING = f"""
with recursive bits(b, k, v) as (
  select unnest(range(256)), 0, unnest(range(256))::ubigint
  union all
  select b, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384::ubigint) else v // 2 end from bits where k < 8),
tab as (select list(v order by b) as t from bits where k = 8),
runs as (
  select doc_id, w, count(*) as times
  from (select doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\u00C0-\u00FF]+')) as w from documents)
  where length(w) >= 5 group by all),
summed as (
  select w, times,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::varchar, '') || ':' || w)), '..'), lambda x: ('0x' || x)::ubigint),
                         lambda a, x: xor(a // 256, t[((xor(a, x) % 256) + 1)::bigint]), 4294967295::ubigint),
             4294967295::ubigint)::bigint as h
  from runs, tab),
spelt as (
  select case when h % 97 = 0 then w[:h % length(w)] || w[h % length(w) + 2:] else w end as word, times from summed),
words as (select word, sum(times)::bigint as n from spelt where length(word) >= 5 group by 1 having sum(times) >= 3),
cuts as (select word, n, i, w[:i - 1] || w[i + 1:] as rest from (select word, n, word as w, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select x.word, y.word as other, y.n as other_n from cuts x join cuts y on x.rest = y.rest and x.i = y.i and x.word <> y.word
  union select c.word, w.word, w.n from cuts c join words w on w.word = c.rest
  union select w.word, c.word, c.n from cuts c join words w on w.word = c.rest),
best as (
  select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n
  from (select distinct * from near) group by 1),
listed as (
  select w.word, w.n, coalesce(b.n_near, 0)::bigint as n_near, case when b.other_n >= 2 * w.n then b.other end as form,
         case when b.other_n >= 2 * w.n then b.other_n end as form_n
  from words w left join best b using (word)),
follow(word, here, i) as (
  select word, word, 0 from listed union all select f.word, l.form, i + 1 from follow f join listed l on l.word = f.here where l.form is not null),
roots as (select word, arg_max(here, i) as root from follow group by 1)
select l.word, l.form, r.root, l.n, l.n_near, l.form_n from listed l join roots r using (word)"""

ORACLE = {
    "op1_suffix_repetition": REPETITION,
    "op2_feistel_shards": SHARDS,
    "op4_near_duplicates": NEAR,
    "op6_suffix_dedup": SUFFIX,
    "op7_mixing": MIXING,
    "op11_embedding_near_duplicates": VECTORS,
    "op12_spelling_variants": SPELLING,
}
